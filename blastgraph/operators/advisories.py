"""Advisories: parsing documents, folding events into intervals, matching releases.

Intervals compare by plain version order, prereleases included: introduced inclusive, fixed
exclusive, last affected inclusive; "0", empty and unreadable bounds are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semver, times

#: Ratings that count as a severity, kinds of range with versions.
RATINGS = ("LOW", "MODERATE", "MEDIUM", "HIGH", "CRITICAL")
RANGE_KINDS = ("SEMVER", "ECOSYSTEM")
EVENT = "struct<introduced:string,fixed:string,last_affected:string>"
DOCUMENT = f"""id string, summary string, details string, aliases array<string>, published string, withdrawn string,
    database_specific struct<severity:string,cwe_ids:array<string>>, severity array<struct<type:string,score:string>>,
    affected array<struct<package:struct<ecosystem:string,name:string>,
        ranges:array<struct<type:string,events:array<{EVENT}>>>,versions:array<string>>>"""
INTERVALS = f"array<{EVENT}>"


def fold_events(events: Column) -> Column:
    """Events in order as intervals: an introduction opens one, a fix or a last affected version
    closes it; what is still open at the end or at the next introduction stays open."""
    none = F.lit("")

    def interval(start: Column, fixed: Column, last: Column) -> Column:
        return F.struct(start.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))

    def step(acc: Column, e: Column) -> Column:
        has = acc["open"].isNotNull()
        opens, closes = e["introduced"].isNotNull(), e["fixed"].isNotNull() | e["last_affected"].isNotNull()
        kept = F.when(
            has & (opens | closes),
            F.concat(acc["done"], F.array(interval(acc["open"], F.when(~opens, F.coalesce(e["fixed"], none)).otherwise(none), F.when(~opens & e["fixed"].isNull(), F.coalesce(e["last_affected"], none)).otherwise(none)))),
        ).otherwise(acc["done"])
        return F.struct(F.when(opens, e["introduced"]).when(closes, F.lit(None)).otherwise(acc["open"]).alias("open"), kept.alias("done"))

    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(INTERVALS).alias("done"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(interval(acc["open"], none, none)))).otherwise(acc["done"])

    return F.coalesce(F.aggregate(events, start, step, finish), F.array().cast(INTERVALS))


def unfixed(intervals: Column) -> Column:
    """Whether some interval names no version that fixes it."""
    return F.exists(intervals, lambda i: F.coalesce(i["fixed"], F.lit("")) == "")


def malformed(value: Column) -> Column:
    """Whether a text is no JSON."""
    return F.try_parse_json(value).isNull()


def read_documents(texts: DataFrame) -> DataFrame:
    """texts: value. Those that are JSON objects, as documents (``DOCUMENT``), each read once: filters don't go below ``explode_outer``."""
    objects = texts.where("ltrim(value) like '{%'").where(~malformed(F.col("value")))
    return objects.select(F.explode_outer(F.array(F.from_json("value", DOCUMENT))).alias("d")).select("d.*")


def parse(documents: DataFrame) -> DataFrame:
    """Documents (``DOCUMENT``) that stand and affect npm packages, a row for each package:
    osv_id, severity, published_at, summary, cwe, aliases, package, intervals, versions."""
    kept = documents.where("coalesce(withdrawn, '') = '' and coalesce(id, '') <> ''")
    rating = F.upper("database_specific.severity")
    score = F.get(F.filter(F.col("severity.score"), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))  # the first entry that has one
    severity = F.when(rating.isin(*RATINGS), rating).otherwise(F.coalesce(score, F.lit("UNKNOWN")))

    def stripped(name: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"^\s+|\s+$", "")

    headline = F.substring(F.substring_index(stripped("details"), "\n", 1), 1, 300)
    rows = kept.select(
        F.col("id").alias("osv_id"), severity.alias("severity"), times.epoch_or_unknown(F.col("published")).alias("published_at"),
        F.coalesce(F.nullif(stripped("summary"), F.lit("")), headline).alias("summary"),
        F.array_join(F.coalesce("database_specific.cwe_ids", F.array().cast("array<string>")), ",").alias("cwe"),
        F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ",").alias("aliases"), F.explode("affected").alias("a"),
    )
    npm = rows.where("lower(a.package.ecosystem) = 'npm' and coalesce(a.package.name, '') <> ''")
    usable = F.filter(F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:array<{EVENT}>>>")), lambda r: r["type"].isin(*RANGE_KINDS))
    out = npm.select(
        "osv_id", "severity", "published_at", "summary", "cwe", "aliases", F.col("a.package.name").alias("package"),
        F.flatten(F.transform(usable, lambda r: fold_events(r["events"]))).alias("intervals"),
        F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"),
    )
    return out.where("size(intervals) > 0 or size(versions) > 0")


def covers(key: Column, interval: Column) -> Column:
    """Whether an interval of bound keys (low, high, last; null: open) holds a version key."""
    return (
        key.isNotNull()
        & (interval["low"].isNull() | (key >= interval["low"]))
        & (interval["high"].isNull() | (key < interval["high"]))
        & (interval["last"].isNull() | (key <= interval["last"]))
    )


def affected_releases(advisories: DataFrame, releases: DataFrame) -> DataFrame:
    """advisories: osv_id, package, intervals, versions. releases: package, version, key. One row
    for each advisory and release: osv_id, target, package, version, introduced, fixed_in,
    range_source ("range" by the first interval that covers, else "enumerated")."""

    def bound(x: Column) -> Column:
        return F.when((x == "0") | (x == ""), F.lit(None)).otherwise(semver.version_key(x))

    bounds = advisories.select("osv_id", "package", "versions", F.transform("intervals", lambda i: F.struct(
        i["introduced"].alias("introduced"), F.coalesce(i["fixed"], F.lit("")).alias("fixed"), bound(i["introduced"]).alias("low"),
        bound(i["fixed"]).alias("high"), bound(i["last_affected"]).alias("last"))).alias("intervals"))
    release = F.struct("version", F.col("key").alias("target"), semver.version_key(F.col("version")).alias("k"))
    known = releases.groupBy("package").agg(F.collect_list(release).alias("known"))

    def judged(r: Column) -> Column:
        hit = F.get(F.filter("intervals", lambda i: covers(r["k"], i)), F.lit(0))
        return F.struct(r["version"].alias("version"), r["target"].alias("target"), hit.alias("hit"), F.array_contains("versions", r["version"]).alias("listed"))

    met = F.filter(F.transform("known", judged), lambda m: m["hit"].isNotNull() | m["listed"])
    found = bounds.join(known, "package").select("osv_id", "package", F.explode(met).alias("m")).select("osv_id", "package", "m.*")
    rows = found.select(
        "osv_id", "target", "package", "version", F.coalesce("hit.introduced", F.lit("")).alias("introduced"), F.coalesce("hit.fixed", F.lit("")).alias("fixed_in"),
        F.when(F.col("hit").isNotNull(), "range").otherwise("enumerated").alias("range_source"),
    )
    first = Window.partitionBy("osv_id", "target").orderBy(F.desc("range_source"), "introduced", "fixed_in")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
