"""What is bad: the releases of an advisory, or of a package in a version range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..graph import Graph


class NothingKnown(LookupError):
    """Nothing in the graph answers to an advisory, a package or a range."""


def releases_of(graph: Graph, package: str) -> DataFrame:
    return graph.releases.where(F.col("package") == package).select("key", "package", "version", "published_at")


def bad_by_range(graph: Graph, package: str, spec: str = "*") -> DataFrame:
    """key, package, version, published_at, fixed_in of a package's releases in a range."""
    keyed = releases_of(graph, package).withColumn("k", semver.version_key(F.col("version")))
    return keyed.where(semver.in_range(F.col("k"), spec)).select("key", "package", "version", "published_at", F.lit("").alias("fixed_in"))


def bad_by_advisory(graph: Graph, osv_id: str) -> DataFrame:
    """key, package, version, published_at, fixed_in of what an advisory affects."""
    hit = graph.affects.where(F.col("osv_id") == osv_id).select(F.col("target").alias("key"), "fixed_in")
    return hit.join(graph.releases, "key").select("key", "package", "version", "published_at", "fixed_in")


def header(graph: Graph, osv_id: str) -> DataFrame:
    """summary, severity, published_at of an advisory."""
    return graph.advisories.where(F.col("osv_id") == osv_id).select("osv_id", "summary", "severity", "published_at")


def answer(graph: Graph, osv_id: str) -> DataFrame:
    """``summary`` of what an advisory affects under its header: osv_id, summary, severity, published_at, and
    unfixed, whether it names no fix at all for the package."""
    found = summary(bad_by_advisory(graph, osv_id))
    return header(graph, osv_id).join(F.broadcast(found)).withColumn("unfixed", F.col("fixed_in") == "")  # one row and those of one advisory


def known(bad: DataFrame, what: str) -> DataFrame:
    """``bad`` itself, or NothingKnown where it is empty."""
    if bad.isEmpty():
        raise NothingKnown(what)
    return bad


def summary(bad: DataFrame) -> DataFrame:
    """A row for each package: versions (sorted as text), fixes, introduced_at (0: unknown), releases."""
    return bad.groupBy("package").agg(
        F.array_join(F.sort_array(F.collect_set("version")), ",").alias("versions"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("fixed_in") != "", F.col("fixed_in")))), ",").alias("fixed_in"),
        F.coalesce(F.min(F.when(F.col("published_at") > 0, F.col("published_at"))), F.lit(0)).cast("bigint").alias("introduced_at"),
        F.countDistinct("key").alias("releases"),
    )
