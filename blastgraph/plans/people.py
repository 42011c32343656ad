"""Maintainer pivot, typosquat radar, overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import names


def maintainers_of(graph: Graph, package: str) -> DataFrame:
    return graph.can_publish.where(F.col("package") == package).select("maintainer").distinct()


def pivot(graph: Graph, package: str, limit: int = 50) -> DataFrame:
    """Other packages of a package's maintainers: package, dependents, accounts."""
    accounts = maintainers_of(graph, package)
    others = graph.can_publish.where(F.col("package") != package).join(accounts, "maintainer", "left_semi")
    grouped = others.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set("maintainer")), ",").alias("accounts"))
    return grouped.join(graph.dependents(), "package").select("package", "dependents", "accounts").orderBy(F.desc("dependents"), "package").limit(limit)


def pivot_totals(siblings: DataFrame) -> DataFrame:
    """One row over the siblings shown: siblings, dependents."""
    return siblings.agg(F.count(F.lit(1)).alias("siblings"), F.coalesce(F.sum("dependents"), F.lit(0)).cast("bigint").alias("dependents"))


def owners(graph: Graph) -> DataFrame:
    """package, owners (sorted, comma-joined)."""
    return graph.can_publish.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set("maintainer")), ",").alias("owners"))


def typosquat(graph: Graph, popular_at: int = 25, max_distance: int = 1, limit: int = 50) -> DataFrame:
    """Suspects, unrelated owners first, then the widest gap in popularity, name, resembled name."""
    found = names.suspects(graph.dependents(), graph.can_publish, popular_at, max_distance)
    return found.orderBy("shares_maintainer", "ratio", "name", "resembles").limit(limit)


def top_packages(graph: Graph, n: int = 12) -> DataFrame:
    return graph.dependents().orderBy(F.desc("dependents"), "package").limit(n)


def latest_advisories(graph: Graph, n: int = 200) -> DataFrame:
    return graph.advisories.select("osv_id", "severity", "published_at", "summary").orderBy(F.desc("published_at"), "osv_id").limit(n)
