"""Documents made from the projected tables, so that parsers and ingest run on whole tables: package
metadata, lockfiles of every format, advisories; and the same facts in SQL, straight from the tables.

A part's line numbers 1 to 7 become ``VERSIONS``, prereleases among them; dependencies declare
``RANGES``, of which ``FITS`` says by hand which line numbers each one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .oracle import BASE, OPEN_END, name
from .sources.projection import Projection, package_name

VERSIONS = ("1.0.0-beta.1", "1.0.0", "1.1.0", "1.1.5", "2.0.0-rc.1", "2.0.0", "2.1.0")
RANGES = ("^1.0.0", "~1.1.0", "1.0.0 - 1.1.0", ">=1.0.0-beta.1 <2.0.0", "*", "^2.0.0-rc.1", "1.x || 2.1.0", "^9.0.0", "latest")
FITS = {0: (2, 3, 4), 1: (3, 4), 2: (2, 3), 3: (1, 2, 3, 4), 4: (2, 3, 4, 6, 7), 5: (5, 6, 7), 6: (2, 3, 4, 7), 7: (), 8: ()}
KEPT, WINDOWS = 4, 5


def _at(values: tuple[str, ...], place: Column) -> Column:
    """The value at a place from 0."""
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def _stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def releases(p: Projection) -> DataFrame:
    """part, ln, package, version, published_at, publisher."""
    ln = F.substring_index(F.substring_index("version", ".", 2), ".", -1).cast("int")
    rows = p.raw_releases.select("part", ln.alias("ln"), "package", "published_at", F.concat(F.lit("s"), F.col("publisher").cast("string")).alias("publisher"))
    return rows.withColumn("version", _at(VERSIONS, F.col("ln") - 1))


def packuments(p: Projection) -> DataFrame:
    """document: the metadata of every part that has a release."""

    def depends(on: Column, spec: Column) -> Column:
        return F.create_map(package_name(on), _at(RANGES, spec % len(RANGES)))

    part, ln = F.col("part"), F.col("ln")
    unknown = F.create_map(F.concat(F.lit("ghost"), part.cast("string")), F.lit("^1.0.0"))
    half = depends(F.floor(part / 2), part)
    body = F.struct(
        F.when(part % 7 == 0, F.map_concat(half, unknown)).otherwise(half).alias("dependencies"),
        depends(F.floor(part / 3), part + ln).alias("optionalDependencies"),
        F.when(part % 4 == 0, depends(F.floor(part / 5), part + 1)).alias("devDependencies"),
        F.struct(F.when(ln % 2 == 1, F.concat(F.lit("sha512-"), part, F.lit("-"), ln)).alias("integrity"), F.concat(F.lit("x"), part, F.lit("-"), ln).alias("shasum")).alias("dist"),
        F.when(ln == 3, "use another").alias("deprecated"), F.struct(F.col("publisher").alias("name")).alias("_npmUser"),
    )
    times = F.map_from_entries(F.collect_list(F.struct("version", _stamp(F.col("published_at")))))
    whole = releases(p).groupBy("part", "package").agg(times.alias("times"), F.map_from_entries(F.collect_list(F.struct("version", body))).alias("versions"), F.min("publisher").alias("owner"))
    times = F.map_concat("times", F.create_map(F.lit("created"), F.lit("2001-01-01T00:00:00Z"), F.lit("unpublished"), F.lit("some day")))
    owner = F.when(part % 2 == 0, F.to_json(F.struct(F.col("owner").alias("name"), F.concat("owner", F.lit("@x.org")).alias("email")))).otherwise(
        F.concat(F.lit('"'), "owner", F.lit(" <"), "owner", F.lit('@x.org>"'))
    )
    pieces = F.concat(F.lit('{"name":"'), "package", F.lit('","maintainers":['), owner, F.lit('],"time":'), F.to_json(times), F.lit(',"versions":'), F.to_json("versions"), F.lit("}"))
    return whole.select(pieces.alias("document"))


def _entries(p: Projection) -> DataFrame:
    """An order's line items as entries of its lockfile: source, ln, name, version, declared; top:
    whether it is the first entry of its name. Line items are dealt by order once, for all that is gathered by it."""
    least = F.bool_or(F.col("l_returnflag") == "A") & ~F.bool_or(F.col("l_returnflag") < "A")  # min(l_returnflag) is A: the least of texts would take a sort
    rows = p.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition(p.tasks, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), least.alias("declared"))
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey", "part")) == F.col("l_linenumber")
    return rows.select(
        F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("ln"), package_name(F.col("part")).alias("name"), _at(VERSIONS, F.col("l_linenumber") - 1).alias("version"),
        "declared", first.alias("top"),
    )


def _files(p: Projection, path: str | Column, document: Column, manifest: Column) -> DataFrame:
    """service, path, document, manifest, committed_at: a lockfile for each order. ``document`` reads
    ``items``, its entries by line number; ``manifest`` the ``names`` that are declared."""
    found = _entries(p).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("ln", "name", "version", "top"))).alias("items"), F.sort_array(F.collect_set(F.when(F.col("declared"), F.col("name")))).alias("names")
    )
    owners = p.lockfiles.select(F.col("key").cast("long").alias("source"), "service", "committed_at")
    return found.join(owners, "source").select(
        "service", F.concat(F.lit("orders/"), F.col("source").cast("string"), F.lit("/"), F.lit(path)).alias("path"), document.alias("document"), manifest.alias("manifest"), "committed_at"
    )


def _block(names: Column) -> Column:
    """A manifest's block with the names as keys, as JSON text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('":"^1"'))), ","), F.lit("}"))


def _joined(entry, between: str = ",") -> Column:
    return F.array_join(F.transform("items", entry), between)


def manifest() -> Column:
    return F.concat(F.lit('{"devDependencies":'), _block(F.col("names")), F.lit("}"))


def _npm_text() -> Column:
    place = lambda i: F.when(i["top"], "node_modules/").otherwise(F.concat(F.lit("node_modules/host"), i["ln"].cast("string"), F.lit("/node_modules/")))
    entries = _joined(lambda i: F.concat(F.lit(',"'), place(i), i["name"], F.lit('":{"version":"'), i["version"], F.lit('"}')), "")
    return F.concat(F.lit('{"lockfileVersion":3,"packages":{"":{"dependencies":'), _block(F.col("names")), F.lit('},"node_modules/own":{"link":true,"version":"1.0.0"}'), entries, F.lit("}}"))


def npm(p: Projection) -> DataFrame:
    """Flat package-lock.json files that declare their direct dependencies themselves."""
    return _files(p, "package-lock.json", _npm_text(), F.lit(None).cast("string"))


def npm_nested(p: Projection) -> DataFrame:
    """Trees of version 1: each entry holds the next one."""
    def wrap(inner: Column, i: Column) -> Column:
        below = F.when(inner == "", "").otherwise(F.concat(F.lit(',"dependencies":'), inner))
        return F.concat(F.lit('{"'), i["name"], F.lit('":{"version":"'), i["version"], F.lit('"'), below, F.lit("}}"))

    tree = F.aggregate(F.reverse("items"), F.lit(""), wrap)
    return _files(p, "package-lock.json", F.concat(F.lit('{"lockfileVersion":1,"dependencies":'), tree, F.lit("}")), manifest())


def _yarn_text() -> Column:
    entry = _joined(lambda i: F.concat(F.lit('"'), i["name"], F.lit('@^1.0.0", "'), i["name"], F.lit("@"), i["version"], F.lit('":\n  version "'), i["version"], F.lit('"\n  dependencies:\n    other "^7"\n')), "\n")
    return F.concat(F.lit("# yarn lockfile v1\n\n"), entry)


def yarn(p: Projection) -> DataFrame:
    """Classic yarn.lock files with two specs to a header."""
    return _files(p, "yarn.lock", _yarn_text(), manifest())


def berry(p: Projection) -> DataFrame:
    entry = _joined(lambda i: F.concat(F.lit('"'), i["name"], F.lit("@npm:^1.0.0, "), i["name"], F.lit("@npm:"), i["version"], F.lit('":\n  version: "'), i["version"], F.lit('"\n')), "")
    head = F.lit('__metadata:\n  version: 6\n"own@workspace:.":\n  version: 0.0.0-use.local\n')
    return _files(p, "yarn.lock", F.concat(head, entry), manifest())


def pnpm(p: Projection) -> DataFrame:
    """Keys in packages without, in snapshots with peers behind them."""
    packages = F.concat(F.lit("packages:\n  plain@0.0.1: {}\n"), _joined(lambda i: F.when(i["ln"] % 2 == 1, F.concat(F.lit("  '"), i["name"], F.lit("@"), i["version"], F.lit("': {}\n"))).otherwise(""), ""))
    snapshots = F.concat(F.lit("snapshots:\n  plain@0.0.1: {}\n"), _joined(lambda i: F.when(i["ln"] % 2 == 0, F.concat(F.lit("  '"), i["name"], F.lit("@"), i["version"], F.lit("(peer@1.0.0)': {}\n"))).otherwise(""), ""))
    return _files(p, "pnpm-lock.yaml", F.concat(F.lit("lockfileVersion: '9.0'\n"), packages, snapshots), manifest())


def lockfiles(p: Projection) -> DataFrame:
    """A file of npm or yarn for each order."""
    even = F.col("source") % 2 == 0
    path = F.when(even, "package-lock.json").otherwise("yarn.lock")
    return _files(p, path, F.when(even, _npm_text()).otherwise(_yarn_text()), F.when(~even, manifest()))


def advisories(p: Projection) -> DataFrame:
    """value: an advisory for every error event. Some are withdrawn, of another ecosystem, or cut off."""
    parts = p.table("part").agg(F.count(F.lit(1)).alias("parts"))
    rows = p.table("events").where("event_type = 'error'").crossJoin(F.broadcast(parts)).withColumn("k", F.from_json("props", "k int")["k"])  # one row
    number, k = F.col("event_id"), F.col("k")
    events = F.array(F.create_map(F.lit("introduced"), _at(VERSIONS, k % 3)), F.create_map(F.lit("fixed"), _at(VERSIONS, 2 + k % 5)))
    rated = F.struct(F.when(F.col("value") < 50, "moderate").otherwise("High").alias("severity"), F.array(F.lit("CWE-1"), F.lit("CWE-2")).alias("cwe_ids"))
    scored = F.array(F.create_map(F.lit("type"), F.lit("X")), F.create_map(F.lit("type"), F.lit("CVSS_V3"), F.lit("score"), F.concat(F.lit("CVSS:"), number)))
    affected = F.struct(
        F.struct(F.when(number % 13 == 0, "PyPI").otherwise("NPM").alias("ecosystem"), package_name(number % F.col("parts")).alias("name")).alias("package"),
        F.array(F.struct(F.lit("GIT").alias("type"), F.array(F.create_map(F.lit("introduced"), F.lit("abc"))).alias("events")), F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges"),
    )
    document = F.to_json(F.struct(
        F.concat(F.lit("A-"), number).alias("id"), F.when(number % 5 == 0, "  ").otherwise(F.concat(F.lit("defect "), number)).alias("summary"),
        F.concat(F.lit("\n first of "), number, F.lit(" \nsecond")).alias("details"), F.array(F.concat(F.lit("CVE-"), number)).alias("aliases"),
        _stamp(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("published"), F.when(number % 11 == 0, "2020-01-01T00:00:00Z").alias("withdrawn"),
        F.when(number % 3 != 0, rated).alias("database_specific"), F.when(number % 3 == 0, scored).alias("severity"), F.array(affected).alias("affected"),
    ))
    # Through ``explode_outer`` a text is made once, not again for each filter on it.
    return rows.select(F.explode_outer(F.array(F.when(number % 17 == 0, F.left(document, F.lit(20))).otherwise(document))).alias("value"))


_VERSION = "['" + "','".join(VERSIONS) + "']"
_RANGE = "['" + "','".join(RANGES) + "']"
_FIT = ", ".join(f"({r}, {ln})" for r, lns in FITS.items() for ln in lns)

#: The same releases, declarations, windows, edges, pins and advisories from the tables themselves.
SQL = BASE.replace("$SHARE", "40") + f"""mrel AS (
    SELECT part, ln, package, {_VERSION}[ln] AS version, package || '@' || {_VERSION}[ln] AS key, published_at, 's' || publisher AS publisher FROM rel),
kept AS (SELECT * FROM mrel QUALIFY row_number() OVER (PARTITION BY part ORDER BY published_at DESC, version DESC) <= {KEPT}),
fits AS (SELECT * FROM (VALUES {_FIT}) AS t(r, ln)),
mdecl AS (
    SELECT key AS source, package, version, published_at, part // 2 AS dep, part % {len(RANGES)} AS r, 'runtime' AS kind FROM mrel
    UNION ALL SELECT key, package, version, published_at, part // 3, (part + ln) % {len(RANGES)}, 'optional' FROM mrel
    UNION ALL SELECT key, package, version, published_at, part // 5, (part + 1) % {len(RANGES)}, 'dev' FROM mrel WHERE part % 4 = 0),
facts AS (SELECT * FROM mdecl WHERE dep IN (SELECT part FROM mrel) AND source IN (SELECT key FROM kept)),
mrise AS (
    SELECT m.*, f.r, max(m.ln) OVER (PARTITION BY m.part, f.r ORDER BY published_at, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM mrel m JOIN fits f USING (ln)),
mwin AS (
    SELECT part, r, key, version, published_at AS valid_from, lead(published_at, 1, {OPEN_END}) OVER (PARTITION BY part, r ORDER BY published_at, version) AS valid_to
    FROM mrise WHERE best IS NULL OR ln > best),
mraw AS (
    SELECT CASE kind WHEN 'dev' THEN 'DEV_DEPENDS_ON' ELSE 'DEPENDS_ON' END AS rel_type, f.source, w.key AS target, {_RANGE}[f.r + 1] AS range, w.version AS resolved_to, f.kind,
        greatest(w.valid_from, f.published_at) AS valid_from, w.valid_to
    FROM facts f JOIN mwin w ON w.part = f.dep AND w.r = f.r WHERE greatest(w.valid_from, f.published_at) < w.valid_to
    QUALIFY row_number() OVER (PARTITION BY f.source, f.dep, f.r, f.kind ORDER BY w.valid_to DESC, greatest(w.valid_from, f.published_at) DESC) <= {WINDOWS}),
mdep AS (
    SELECT * FROM mraw WHERE target IN (SELECT key FROM kept)
    QUALIFY row_number() OVER (PARTITION BY rel_type, source, target ORDER BY CASE kind WHEN 'runtime' THEN 0 WHEN 'optional' THEN 2 ELSE 3 END, valid_from) = 1),
item AS (
    SELECT l_orderkey AS source, l_linenumber AS ln, {name('min(l_partkey)')} AS name, {_VERSION}[l_linenumber] AS version, min(l_returnflag) = 'A' AS declared,
        min(l_linenumber) OVER (PARTITION BY l_orderkey, min(l_partkey)) = l_linenumber AS top FROM lineitem GROUP BY l_orderkey, l_linenumber),
item_of AS (SELECT i.*, l.service, bool_or(declared) OVER (PARTITION BY source, name) AS named, ln = min(ln) OVER (PARTITION BY source) AS outermost FROM item i JOIN lock l ON l.key = CAST(source AS VARCHAR)),
madv AS (
    SELECT 'A-' || event_id AS osv_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'CVSS:' || event_id WHEN value < 50 THEN 'MODERATE' ELSE 'HIGH' END AS severity,
        CAST(floor(epoch(ts)) AS BIGINT) AS published_at, CASE WHEN event_id % 5 = 0 THEN 'first of ' || event_id || ' ' ELSE 'defect ' || event_id END AS summary,
        CASE WHEN event_id % 3 <> 0 THEN 'CWE-1,CWE-2' ELSE '' END AS cwe, 'CVE-' || event_id AS aliases, event_id % (SELECT count(*) FROM part) AS part,
        CAST(json_extract(props, '$.k') AS INTEGER) AS k
    FROM events WHERE event_type = 'error'),
stands AS (SELECT * FROM madv WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0),
maffects AS (
    SELECT osv_id, r.key AS target, r.package, r.version, {_VERSION}[1 + k % 3] AS introduced, {_VERSION}[3 + k % 5] AS fixed_in, 'range' AS range_source
    FROM stands s JOIN kept r USING (part) WHERE r.ln >= 1 + k % 3 AND r.ln < 3 + k % 5),
mpins AS (
    SELECT service, 'orders/' || source || CASE WHEN source % 2 = 0 THEN '/package-lock.json' ELSE '/yarn.lock' END AS path, name, version,
        CASE WHEN source % 2 = 0 THEN top AND named ELSE named END AS direct FROM item_of)
"""
