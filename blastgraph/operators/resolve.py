"""Ranges to time windows: which release a range meant, and when.

A range is resolved once for each distinct (package, range), then joined to the declarations. The
timeline is windowed by package, so a package's releases are the most a task holds together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semver
from .ranks import dealt


def parsed_ranges(requests: DataFrame) -> DataFrame:
    """range, parsed of the distinct range strings; parsed is null where it is no range."""
    return requests.select("range").distinct().withColumn("parsed", semver.parsed_range(F.col("range")))


def resolution_windows(timeline: DataFrame, requests: DataFrame, candidates: int = S.CANDIDATE_VERSIONS) -> DataFrame:
    """timeline: package, version, published_at. requests: package, range. One row for each
    window: package, range, version, valid_from, valid_to.

    Of a package's latest ``candidates`` releases those in the range that beat every earlier one
    open a window; it closes when the next such release is published.
    """
    newest = Window.partitionBy("package").orderBy(F.desc("published_at"), F.desc("version"))
    recent = timeline.select("package", "version", "published_at").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= candidates)
    candidate = F.struct("version", "published_at", semver.version_key(F.col("version")).alias("key"))
    listed = recent.groupBy("package").agg(F.collect_list(candidate).alias("listed"))  # at most ``candidates`` to a package
    wanted = requests.select("package", "range").distinct().join(parsed_ranges(requests), "range")  # no release satisfies what is no range; a filter here would parse every row
    fits = F.filter("listed", lambda c: semver.satisfies(c["key"], F.col("parsed")))
    fitting = wanted.join(listed, "package").select("package", "range", F.explode(fits).alias("c")).select("package", "range", "c.*")
    order = Window.partitionBy("package", "range").orderBy("published_at", "version")
    best = F.max("key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    risers = fitting.withColumn("best", best).where("best is null or key > best")
    return risers.select(
        "package", "range", "version", F.col("published_at").alias("valid_from"),
        F.lead("published_at", 1, S.OPEN_END).over(order).alias("valid_to"),
    )


def dependency_edges(declared: DataFrame, windows: DataFrame, keep: int = S.WINDOWS_PER_DEPENDENCY, tasks: int | None = None) -> DataFrame:
    """declared: source, published_at, dependency, range, kind, and any ordinal. One row per
    declaration and window that is open at or after its publication, the last ``keep`` of them:
    rel_type, source, target, range, resolved_to, kind, valid_from, valid_to, ordinal. tasks: see ``dealt``."""
    ordinal = F.col("ordinal") if "ordinal" in declared.columns else F.lit(0)
    facts = declared.select("source", "published_at", F.col("dependency").alias("package"), "range", "kind", ordinal.alias("ordinal"))
    both = ["package", "range"]
    open_yet = dealt(facts, tasks, *both).join(dealt(windows, tasks, *both), both).withColumn("valid_from", F.greatest("valid_from", "published_at")).where("valid_from < valid_to")
    last = Window.partitionBy("source", "package", "range", "kind", "ordinal").orderBy(F.desc("valid_to"), F.desc("valid_from"))
    kept = open_yet.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= keep)
    return kept.select(
        relationship_for(F.col("kind")).alias("rel_type"), "source", F.concat_ws("@", "package", "version").alias("target"), "range",
        F.col("version").alias("resolved_to"), "kind", "valid_from", "valid_to", "ordinal",
    )


def relationship_for(kind):
    return F.when(kind == "dev", S.DEV_DEPENDS_ON).otherwise(S.DEPENDS_ON)


def resolve_counters(requests: DataFrame) -> DataFrame:
    """One row: ranges asked for, and those that are no ranges (git, file, aliases, tags)."""
    parsed = parsed_ranges(requests)
    rows = requests.join(parsed, "range", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("declared"), F.sum(F.col("parsed").isNull().cast("bigint")).alias("not_ranges"),
    )
