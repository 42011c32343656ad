"""Package metadata documents: JSON with maps whose keys are versions and dependency names.

The maps are read as JSON text and parsed one level at a time, so heterogeneous values never
break a fixed schema. Everything is native; malformed parts are dropped, not raised. ``opened`` reads a
document whose parts all have their usual types in one pass, for all tables that are made of it; the
others stay text, and are read level by level beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import times

#: Dependency blocks of a manifest and the kind that each declares.
BLOCKS = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
NOT_VERSIONS = ("created", "modified")
STRINGS = "map<string,string>"
#: The usual types of a document's parts; ``odd`` is set where one has another, or the text is no JSON.
BODY = "struct<dist:struct<integrity:string,shasum:string>,deprecated:string,_npmUser:struct<name:string>," + ",".join(f"{b}:{STRINGS}" for b in BLOCKS) + ">"
USUAL = f"name string, time {STRINGS}, versions map<string,{BODY}>, maintainers array<string>, odd string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """document: one whole JSON text per file, gzip included."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def _map(document: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(document, path), STRINGS), F.create_map().cast(STRINGS))


def _quoted(value: Column) -> Column:
    """Whether a raw JSON value was a string: from_json gives strings bare, others as JSON text."""
    return ~value.rlike(r'^(?:\{|\[|-?\d+(?:\.\d+)?$|true$|false$|null$)')


def opened(documents: DataFrame) -> DataFrame:
    """What the functions below take in place of documents, to be written: package, times, bodies and maintainers of
    documents of the usual types, each parsed once; document, the text of the others."""
    read = documents.select("document", F.from_json("document", USUAL, {"columnNameOfCorruptRecord": "odd"}).alias("d"))
    odd = F.col("d.odd").isNotNull() | ~F.col("document").rlike(r"^\s*\{")
    usual = read.select(F.when(odd, F.col("document")).alias("document"), F.when(~odd, F.col("d")).alias("d"))
    stamps = F.transform(F.map_entries("d.time"), lambda e: F.struct(e["key"].alias("version"), times.epoch(e["value"]).alias("published_at")))
    known = F.filter(stamps, lambda t: ~t["version"].isin(*NOT_VERSIONS) & t["published_at"].isNotNull())
    return usual.select("document", F.col("d.name").alias("package"), known.alias("times"), F.col("d.versions").alias("bodies"), F.col("d.maintainers").alias("maintainers"))


def _either(documents: DataFrame, usual: Callable[[DataFrame], DataFrame], text: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of documents: those that were opened, and those that are text."""
    texts = text(documents.where("document is not null").select("document"))
    return usual(documents).unionByName(texts) if "bodies" in documents.columns else texts


def version_times(documents: DataFrame) -> DataFrame:
    """package, version, published_at of a document's time map; created, modified and what is no
    time are left out."""
    return _either(documents, lambda d: d.select("package", F.explode("times").alias("t")).select("package", "t.*"), _version_times)


def _version_times(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.get_json_object("document", "$.name").alias("package"), F.explode(_map(F.col("document"), "$.time")).alias("version", "stamp"))
    parsed = rows.where(~F.col("version").isin(*NOT_VERSIONS)).withColumn("published_at", times.epoch(F.col("stamp")))
    return parsed.where("published_at is not null").select("package", "version", "published_at")


def _versions(documents: DataFrame) -> DataFrame:
    name = F.get_json_object("document", "$.name")
    return documents.where(F.coalesce(name, F.lit("")) != "").select(name.alias("package"), F.explode(_map(F.col("document"), "$.versions")).alias("version", "body"))


def _bodies(documents: DataFrame) -> DataFrame:
    """package, version, body of opened documents."""
    return documents.where("package <> ''").select("package", F.explode("bodies").alias("version", "body"))


def releases(documents: DataFrame) -> DataFrame:
    """key, package, version, published_at (0: unknown), integrity, deprecated, publisher."""

    def usual(d: DataFrame) -> DataFrame:
        integrity = F.coalesce(F.nullif("body.dist.integrity", F.lit("")), "body.dist.shasum", F.lit(""))
        return _bodies(d).where("body is not null").select(
            F.concat_ws("@", "package", "version").alias("key"), "package", "version", integrity.alias("integrity"),
            F.coalesce(F.length("body.deprecated") > 0, F.lit(False)).alias("deprecated"), F.coalesce("body._npmUser.name", F.lit("")).alias("publisher"),
        )

    rows = _either(documents, usual, _releases)
    return rows.join(version_times(documents), ["package", "version"], "left").select(
        "key", "package", "version", F.coalesce("published_at", F.lit(0)).cast("bigint").alias("published_at"), "integrity", "deprecated", "publisher"
    )


def _releases(documents: DataFrame) -> DataFrame:
    def text(path: str) -> Column:
        return F.coalesce(F.get_json_object("body", path), F.lit(""))

    integrity = F.coalesce(F.nullif(text("$.dist.integrity"), F.lit("")), text("$.dist.shasum"))
    return _versions(documents).where("body like '{%'").select(
        F.concat_ws("@", "package", "version").alias("key"), "package", "version", integrity.alias("integrity"),
        (F.length(text("$.deprecated")) > 0).alias("deprecated"), text("$._npmUser.name").alias("publisher"),
    )


def dependencies(documents: DataFrame) -> DataFrame:
    """package, version, dependency, range, kind of every declared dependency with a text range."""
    usual = lambda d: _declared(_bodies(d), lambda block: F.col(f"body.{block}"))
    return _either(documents, usual, lambda d: _declared(_versions(d), lambda block: _map(F.col("body"), f"$.{block}")))


def _declared(rows: DataFrame, entries: Callable[[str], Column]) -> DataFrame:
    blocks = F.array(*[F.struct(F.lit(kind).alias("kind"), entries(block).alias("entries")) for block, kind in BLOCKS.items()])
    each = rows.select("package", "version", F.explode(blocks).alias("b")).select("package", "version", "b.kind", F.explode("b.entries").alias("dependency", "range"))
    return each.where(_quoted(F.col("range"))).select("package", "version", "dependency", "range", "kind")


def maintainers(documents: DataFrame) -> DataFrame:
    """package, username, email; entries are objects, or text like "name <address>"."""
    entries = F.from_json(F.get_json_object("document", "$.maintainers"), "array<string>")
    texts = lambda d: d.select(F.get_json_object("document", "$.name").alias("package"), F.explode(entries).alias("m"))
    rows = _either(documents, lambda d: d.select("package", F.explode("maintainers").alias("m")), texts)
    objects = F.col("m").startswith("{")
    username = F.when(objects, F.get_json_object("m", "$.name")).otherwise(F.trim(F.substring_index("m", "<", 1)))
    email = F.when(objects, F.get_json_object("m", "$.email")).otherwise(F.regexp_extract("m", "<([^>]*)>", 1))
    return rows.select("package", username.alias("username"), F.coalesce(email, F.lit("")).alias("email")).where("username <> ''")


def packages(documents: DataFrame) -> DataFrame:
    """name, ecosystem, first_published (0: no time known)."""
    texts = lambda d: d.select(F.get_json_object("document", "$.name").alias("name"))
    names = _either(documents, lambda d: d.select(F.col("package").alias("name")), texts).where("name <> ''").distinct()
    first = version_times(documents).groupBy(F.col("package").alias("name")).agg(F.min("published_at").alias("first"))
    return names.join(first, "name", "left").select("name", F.lit("npm").alias("ecosystem"), F.coalesce("first", F.lit(0)).cast("bigint").alias("first_published"))


def recent(releases_: DataFrame, keep: int = S.VERSIONS_KEPT) -> DataFrame:
    """The last ``keep`` releases of each package by time of publication; all of them for keep <= 0."""
    if keep <= 0:
        return releases_
    newest = Window.partitionBy("package").orderBy(F.desc("published_at"), F.desc("version"))
    return releases_.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")
