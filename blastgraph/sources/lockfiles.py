"""Lockfiles of npm, yarn and pnpm as pins, in column expressions.

A file is one row. The JSON formats are opened one level at a time: maps come out as keys with
their values as JSON text, so odd entries drop out and never break a schema. A file whose parts all have their usual types
is read in one pass instead, to the same pins. The others are cut at
their unindented keys within the file's row, and the lines below a key are read there. Of YAML that is what these files are written in: a
key to a line, evenly indented, quoted or plain; what stands deeper than the keys that are asked for may be
anything. Malformed files have no pins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coordinates import from_module_path, split_coordinate
from ..storage import written

#: File names in order of precedence, further ones that are read, and the blocks of
#: a manifest that declare a direct pin.
PRECEDENCE = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock")
KINDS = {"package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm"}
DECLARING = ("dependencies", "devDependencies", "optionalDependencies")
TEXTS = "map<string,string>"
FILE = ("service", "path", "kind", "format_version")
#: The usual types of the parts of a JSON lockfile; ``odd`` is set where one has another, or the text is no JSON.
USUAL = "lockfileVersion string, packages map<string,struct<name:string,version:string,link:string," + ",".join(f"{b}:string" for b in DECLARING) + ">>, odd string"
MANIFEST = ", ".join(f"{b} {TEXTS}" for b in DECLARING) + ", odd string"
OBJECT = r"^\s*\{"


class UnknownLockfile(ValueError):
    """A file name that no parser knows."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, document of lockfiles below a folder, the one of highest precedence in each."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    return preferred(files)


def read_with_manifests(spark: SparkSession, path: str) -> DataFrame:
    """folder, path, document, manifest of the preferred lockfile of each folder below a path, with the
    package.json beside it (null: none)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    manifests = files.where("path like '%/package.json'").select(folder.alias("folder"), F.col("document").alias("manifest"))
    return preferred(files).withColumn("folder", folder).join(manifests, "folder", "left").select("folder", "path", "document", "manifest")


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def preferred(files: DataFrame) -> DataFrame:
    """The lockfile of highest precedence of each folder; path has forward slashes."""
    known = files.withColumn("path", F.translate("path", "\\", "/"))
    place = F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), base_name(F.col("path")))
    ranked = known.withColumn("place", place).where("place > 0").withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    first = Window.partitionBy("folder").orderBy("place")
    return ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "place", "folder")


def kind_of(path: str) -> str:
    """The package manager whose lockfile has this name; UnknownLockfile where none has."""
    base = path.replace("\\", "/").rpartition("/")[2]
    if base not in KINDS:
        raise UnknownLockfile(path)
    return KINDS[base]


def _kind() -> Column:
    known = reduce(lambda when, k: when.when(base_name(F.col("path")) == k, KINDS[k]), KINDS, F.when(F.lit(False), ""))
    return known.otherwise(F.raise_error(F.concat(F.lit("UnknownLockfile: "), F.col("path"))))


def _keys(json_text: Column, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(json_text, path)), F.array().cast("array<string>"))


def _entries(json_text: Column, path: str = "$") -> Column:
    return F.coalesce(F.from_json(F.get_json_object(json_text, path), TEXTS), F.create_map().cast(TEXTS))


def declared_names(manifest: Column) -> Column:
    """Names that a manifest declares; null without a readable manifest, which isn't the same as none."""
    found = F.array_distinct(F.concat(*[_keys(manifest, f"$.{block}") for block in DECLARING]))
    text = F.when(F.json_object_keys(manifest).isNotNull(), found)
    usual = lambda m: F.array_distinct(F.concat(*[F.coalesce(F.map_keys(m[block]), F.array().cast("array<string>")) for block in DECLARING]))
    opened = F.from_json(manifest, MANIFEST, {"columnNameOfCorruptRecord": "odd"})
    return _once(opened, lambda m: F.when(m["odd"].isNotNull() | ~manifest.rlike(OBJECT), text).when(manifest.isNotNull(), usual(m)))


def _direct(name: Column) -> Column:
    return F.coalesce(F.array_contains(F.col("declared"), name), F.lit(False))


def npm_flat(files: DataFrame) -> DataFrame:
    """Pins of the flat ``packages`` map of versions 2 and 3, keyed by install path. Links to
    workspaces aren't pins; only what is installed at the top can be direct."""
    own = F.coalesce("declared", declared_names(F.try_element_at("packages", F.lit(""))))
    opened = files.where(F.size("packages") > 0).select(*FILE, own.alias("declared"), "packages")  # once for a file, not for each of its entries
    each = opened.select(*FILE, "declared", F.explode("packages").alias("at", "entry")).where("at <> ''")
    linked = F.coalesce(F.get_json_object("entry", "$.link"), F.lit("")).isin("", "false")
    name = F.coalesce(F.nullif(F.get_json_object("entry", "$.name"), F.lit("")), from_module_path(F.col("at")))
    inner = each.where(linked).withColumn("name", name).withColumn("top", F.regexp_count("at", F.lit("node_modules/")) == 1)
    return inner.select(*FILE, "name", F.get_json_object("entry", "$.version").alias("version"), (F.col("top") & _direct(F.col("name"))).alias("direct"))


def npm_usual(opened: Column, declared: Column) -> Column:
    """The pins of ``npm_flat`` as an array of name, version, direct, of a file that was read by ``USUAL``."""
    own = F.try_element_at(opened["packages"], F.lit(""))
    names = F.array_distinct(F.concat(*[F.coalesce(F.json_object_keys(own[block]), F.array().cast("array<string>")) for block in DECLARING]))
    direct = F.coalesce(declared, F.when(own.isNotNull(), names), F.array().cast("array<string>"))

    def pin(e: Column, direct: Column) -> Column:
        at, name = e["key"], F.coalesce(F.nullif(e["value"]["name"], F.lit("")), from_module_path(e["key"]))
        top = F.contains(at, F.lit("node_modules/")) & (F.substring_index(at, "node_modules/", 2) == at)
        return _once(name, lambda n: F.struct(n.alias("name"), e["value"]["version"].alias("version"), (top & F.array_contains(direct, n)).alias("direct")))

    entries = F.filter(F.map_entries(opened["packages"]), lambda e: (e["key"] != "") & F.coalesce(e["value"]["link"], F.lit("")).isin("", "false"))
    return _once(direct, lambda d: F.transform(entries, lambda e: pin(e, d)))


def npm_nested(files: DataFrame) -> DataFrame:
    """Pins of the nested tree of version 1, level by level; only the first level can be direct."""
    closed = files.where(F.size("packages") == 0)
    level = closed.select(*FILE, "declared", F.get_json_object("body", "$.dependencies").alias("tree"), F.lit(True).alias("top")).where("tree is not null")
    found = []
    while True:
        named = level.select(*FILE, "declared", "top", F.explode(_entries(F.col("tree"))).alias("name", "entry"))
        level = written(named.select(
            *FILE, "declared", "name", F.get_json_object("entry", "$.version").alias("version"), (F.col("top") & _direct(F.col("name"))).alias("direct"),
            F.get_json_object("entry", "$.dependencies").alias("tree"), F.lit(False).alias("top"),
        ), "npm-tree")
        if level.isEmpty():
            break
        found.append(level.select(*FILE, "name", "version", "direct"))
        level = level.where("tree is not null")
    return reduce(DataFrame.unionByName, found) if found else level.select(*FILE, "name", "version", "direct")


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _merged(entries: Column, key: str, *fields: str) -> Column:
    """Entries of a file, one for each key, its fields from the first that has them. No package manager repeats
    a key; only where one does are entries compared with each other. To be taken apart with ``explode_outer``: for
    ``explode`` Spark infers a filter on the size, which reads every file a second time and more."""

    def first(k: Column, field: str) -> Column:
        return F.get(F.transform(F.filter(entries, lambda e: (e[key] == k) & e[field].isNotNull()), lambda e: e[field]), F.lit(0)).alias(field)

    keys = F.array_distinct(F.transform(entries, lambda e: e[key]))
    return F.when(F.size(keys) < F.size(entries), F.transform(keys, lambda k: F.struct(k.alias(key), *[first(k, f) for f in fields]))).otherwise(entries)


#: A header of a classic yarn.lock and the rest of its line; where the next one begins; a version below it.
_HEADER = r"([^\s#].*):[^\S\n]*(?:\n|\z)"
_NEXT_HEADER = rf"\r?\n(?={_HEADER})"
_VERSION = r'\n[^\S\n]+"?version"?(?::|[^\S\n])[^\S\n]*"?([^"\s]+)"?[^\S\n]*(?:\n|\z)'


def yarn_classic(files: DataFrame) -> DataFrame:
    """Pins of a classic yarn.lock: unindented lines that end in a colon are headers, each a list of
    specs; the first indented version below binds to all of them."""
    entry = lambda b: F.struct(F.regexp_extract(b, f"^{_HEADER}", 1).alias("header"), F.regexp_extract(b, _VERSION, 1).alias("version"))
    entries = F.filter(F.transform(F.split("document", _NEXT_HEADER), entry), lambda e: (e["header"] != "") & (e["version"] != ""))
    opened = files.select(*FILE, "declared", entries.alias("entries"))
    each = opened.select(*FILE, "declared", F.explode_outer(_merged(F.col("entries"), "header", "version")).alias("e"))
    named = each.select(*FILE, "declared", "e.version", F.explode_outer(F.transform(F.split("e.header", ","), split_coordinate)).alias("c")).withColumn("name", F.col("c.name"))
    return named.select(*FILE, "name", "version", _direct(F.col("name")).alias("direct"))


#: A line of YAML behind its indentation: its key, quoted or up to the first colon before white space, and its value.
_LINE = r"""(?:\? )?('(?:[^'\n]|'')*'|"(?:[^"\\\n]|\\.)*"|[^'"\s:#][^#\n]*?)(?:[^\S\n]*(?:\n|\z)|:(?:[^\S\n]+(.*?))?[^\S\n]*(?:\n|\z))"""
_NEXT_KEY = rf"\r?\n(?={_LINE})"
#: The indentation of a line that is neither empty nor a comment.
_INDENT = r"(?:^|\n)( ++)(?![^\S\n]*(?:#|\n|\z))"


def _unquoted(text: Column) -> Column:
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(text.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).when(text.startswith('"'), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(text)


def _key(line: Column) -> Column:
    return _once(F.regexp_extract(F.ltrim(line), f"^{_LINE}", 1), _unquoted)


def _value(line: Column) -> Column:
    return _once(F.regexp_extract(F.ltrim(line), f"^{_LINE}", 2), _unquoted)


def _depth(line: Column) -> Column:
    """From 0, in steps of the file's smallest indentation."""
    return F.floor((F.length(line) - F.length(F.ltrim(line))) / F.col("step"))


def yaml_blocks(files: DataFrame) -> DataFrame:
    """``files`` with blocks, an array for each: top, the key of an unindented line, value, what stands behind it, and
    lines, those that follow up to the next one. A file is cut where it lies: its lines never leave its row."""
    steps = F.array_min(F.transform(F.regexp_extract_all("document", F.lit(_INDENT), F.lit(1)), lambda i: F.length(i)))
    lines = lambda b: F.filter(F.split(b, "\n"), lambda line: ~line.rlike(r"^\s*(#|$)"))
    block = lambda b: F.struct(_key(b).alias("top"), _value(b).alias("value"), lines(b).alias("lines"))
    cut = F.transform(F.split("document", _NEXT_KEY), lambda b: F.when(b.startswith(" "), F.concat(F.lit("\n"), b)).otherwise(b))
    blocks = F.filter(F.transform(cut, block), lambda b: b["top"] != "")
    return files.select("*", F.coalesce(steps, F.lit(1)).alias("step"), blocks.alias("blocks"))


def yarn_berry(files: DataFrame) -> DataFrame:
    """Pins of a newer yarn.lock: keys are lists of specs; workspaces aren't pins."""

    def value(block: Column, key: str) -> Column:
        found = F.filter(block["lines"], lambda line: F.contains(line, F.lit(key)) & (_depth(line) == 1) & (_key(line) == key))
        return _once(F.get(found, F.lit(0)), _value)

    whose = [c for c in FILE if c != "format_version"]
    entry = lambda b: F.struct(b["top"].alias("specs"), value(b, "version").alias("version"), value(b, "resolution").alias("resolution"))
    read_files = yaml_blocks(files).select(*whose, "declared", F.transform("blocks", entry).alias("entries"))
    once = read_files.select(*whose, "declared", _merged(F.col("entries"), "specs", "version", "resolution").alias("entries"))
    form = F.get(F.filter("entries", lambda e: e["specs"] == "__metadata"), F.lit(0))["version"]
    each = once.select(*whose, "declared", F.coalesce(form, F.lit("")).alias("format_version"), F.explode_outer("entries").alias("e")).select(*FILE, "declared", "e.*")
    real = each.where((F.col("specs") != "__metadata") & ~F.contains(F.concat("specs", F.coalesce("resolution", F.lit(""))), F.lit("workspace:")))
    named = real.select(*FILE, "declared", "version", F.explode_outer(F.transform(F.split("specs", ","), split_coordinate)).alias("c")).withColumn("name", F.col("c.name"))
    return named.select(*FILE, "name", "version", _direct(F.col("name")).alias("direct"))


def pnpm(files: DataFrame) -> DataFrame:
    """Pins of a pnpm-lock.yaml: the keys of packages and snapshots are coordinates. Direct is what
    the manifest, else the file's own importers, declare, in any version."""

    def below(*tops: str) -> Column:
        """Keys right below these."""
        found = F.transform(F.filter("blocks", lambda b: b["top"].isin(*tops)), lambda b: F.transform(F.filter(b["lines"], lambda line: _depth(line) == 1), _key))
        return F.filter(F.flatten(found), lambda k: k != "")

    def importer(seen: Column, line: Column) -> Column:
        second = F.when((_depth(line) == 2) & (_key(line) != ""), _key(line)).otherwise(seen["second"])
        own = F.when((_depth(line) == 3) & seen["second"].isin(*DECLARING) & (_key(line) != ""), F.array_append(seen["own"], _key(line))).otherwise(seen["own"])
        return F.struct(second.alias("second"), own.alias("own"))

    none = F.struct(F.lit("").alias("second"), F.array().cast("array<string>").alias("own"))
    imported = F.flatten(F.transform(F.filter("blocks", lambda b: b["top"] == "importers"), lambda b: F.aggregate(b["lines"], none, importer)["own"]))
    form = F.array_max(F.transform(F.filter("blocks", lambda b: b["top"] == "lockfileVersion"), lambda b: b["value"]))
    whose = [c for c in FILE if c != "format_version"]
    whole = yaml_blocks(files).select(
        *whose, "declared", F.coalesce(form, F.lit("")).alias("format_version"), F.array_distinct(F.concat(imported, below(*DECLARING))).alias("own"), F.array_distinct(below("packages", "snapshots")).alias("keys")
    )
    each = whole.select(*FILE, F.coalesce("declared", "own").alias("declared"), F.explode_outer(F.transform("keys", split_coordinate)).alias("c"))
    return each.select(*FILE, "c.name", "c.version", _direct(F.col("c.name")).alias("direct"))


def pins(files: DataFrame) -> DataFrame:
    """files: service, path, document, manifest (null: none). A row for each (name, version) of a
    lockfile, direct if any of its entries is: service, path, kind, format_version, name, version,
    direct. A file name that no format has fails the job. A JSON lockfile is read out of its text once, and written."""
    named = files.select("service", "path", "document", _kind().alias("kind"), declared_names(F.col("manifest")).alias("declared"))
    read = named.withColumn("f", F.when(F.col("kind") == "npm", F.from_json("document", USUAL, {"columnNameOfCorruptRecord": "odd"})))
    flat = F.col("f.odd").isNull() & F.col("document").rlike(OBJECT) & (F.size("f.packages") > 0)
    judged = read.select("service", "path", "kind", "declared", "document", F.when(flat, F.col("f")).alias("f"))
    opened = written(judged.select(
        "service", "path", "kind", "declared", F.when(F.col("f").isNull(), F.col("document")).alias("document"), F.coalesce("f.lockfileVersion", F.lit("")).alias("format_version"),
        F.when(F.col("f").isNotNull(), npm_usual(F.col("f"), F.col("declared"))).alias("pins"),
    ), "lockfiles")
    berry = (F.col("kind") == "yarn") & F.contains(F.col("document"), F.lit("__metadata:"))
    parts = [opened.where("pins is not null").select(*FILE, F.explode_outer("pins").alias("p")).select(*FILE, "p.*")]
    json_files = opened.where("kind = 'npm' and document is not null").withColumn("body", F.col("document"))
    npm = json_files.withColumns({"format_version": F.coalesce(F.get_json_object("body", "$.lockfileVersion"), F.lit("")), "packages": _entries(F.col("body"), "$.packages")})
    parts += [npm_flat(npm), npm_nested(npm)]
    parts.append(yarn_classic(opened.where((F.col("kind") == "yarn") & ~berry).withColumn("format_version", F.lit("1"))))
    parts += [yarn_berry(opened.where(berry).drop("format_version")), pnpm(opened.where("kind = 'pnpm'").drop("format_version"))]
    found = reduce(DataFrame.unionByName, parts).where("coalesce(name, '') <> '' and coalesce(version, '') <> ''")
    return found.groupBy(*FILE, "name", "version").agg(F.bool_or("direct").alias("direct"))
