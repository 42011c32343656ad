"""Blast radius: which services reach a bad release, by which chains, when; and reach beyond them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.coordinates import package_of
from ..functions.times import closed
from ..graph import Graph
from ..operators import traverse
from ..storage import written


def leading(graph: Graph, bad: DataFrame, hops: int = S.BLAST_HOPS - 2) -> tuple[DataFrame, DataFrame]:
    """The dependencies that lead to the bad releases within so many hops, and the links between their packages."""
    return graph.leading(bad.select("key").distinct(), hops)


def built(edges: DataFrame, include_build: bool) -> DataFrame:
    return edges if include_build else edges.where(F.col("rel_type") == S.DEPENDS_ON)


def paths(graph: Graph, bad: DataFrame, as_of: int | None = None, include_build: bool = True, max_hops: int = S.BLAST_HOPS, links: bool = False) -> DataFrame:
    """Every live chain from a service to a bad release. bad: key. Columns: service, lockfile,
    target, entry, hops, valid_from, valid_to, direct, build_time, chain; links where asked for."""
    edges, _ = leading(graph, bad, max_hops - 2)
    prefix = traverse.prefixes(bad.select("key").distinct(), built(edges, include_build), max_hops - 2, as_of, links)
    return traverse.service_paths(prefix, graph.pins, graph.lockfiles)


def ways(graph: Graph, bad: DataFrame, as_of: int | None = None, include_build: bool = True, max_hops: int = S.BLAST_HOPS, led: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The chains of ``paths``, counted instead of built: service, target, entry, hops, direct, build_time, ways.
    led: ``leading`` to the bad releases where it is known already."""
    edges, links = leading(graph, bad, max_hops - 2) if led is None else led
    loops = written(traverse.looping(links), "loops")
    counted = traverse.ways(bad.select("key").distinct(), built(edges, include_build), max_hops - 2, as_of, loops)
    return traverse.service_ways(counted, graph.pins, graph.lockfiles)


def text(chain: str = "chain") -> Column:
    return F.array_join(chain, " > ")


def shown(found: DataFrame, *more: str) -> DataFrame:
    """Paths for output: the chain as text, an open window's end as null, and ``more`` columns."""
    return found.select(
        "service", "target", "entry", F.col("hops").cast("bigint").alias("hops"), text().alias("chain"), "valid_from",
        closed(F.col("valid_to"), S.OPEN_END).alias("valid_to"), "direct", "build_time", *more,
    )


def truncated(found: DataFrame, cap: int = S.BLAST_PATHS) -> DataFrame:
    """The first ``cap`` paths by hops, service, target and chain. Their ``truncated`` says
    whether there are more."""
    order = ("hops", "service", "target", "text")
    first = found.withColumn("text", text()).orderBy(*order).limit(cap + 1)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most ``cap`` + 1 rows
    most = F.max("_n").over(Window.partitionBy())
    return ranked.withColumn("truncated", most > cap).where(F.col("_n") <= cap).drop("_n", "text")


def first_paths(graph: Graph, bad: DataFrame, as_of: int | None = None, include_build: bool = True, max_hops: int = S.BLAST_HOPS, cap: int = S.BLAST_PATHS) -> DataFrame:
    """``truncated`` paths without the others: short chains come first, so growing them stops at the hop at
    which there are ``cap`` and one more."""
    found: list[DataFrame] = []
    missing = cap + 1
    edges, _ = leading(graph, bad, max_hops - 2)
    for level in traverse.prefix_levels(bad.select("key").distinct(), built(edges, include_build), max_hops - 2, as_of):
        here = traverse.service_paths(level, graph.pins, graph.lockfiles).withColumn("text", text())
        found.append(written(here.orderBy("service", "target", "text").limit(missing).drop("text"), "first-paths"))
        missing -= found[-1].count()
        if not missing:
            break
    return truncated(reduce(DataFrame.unionByName, found), cap)


def open_ended() -> Column:
    """Whether a path's window has no end yet."""
    return F.col("valid_to") >= S.OPEN_END


def shortened(found: DataFrame, asked: int = S.BLAST_HOPS) -> DataFrame:
    """One row over counted chains: depth reached, and whether it is less than was asked for."""
    depth = F.coalesce(F.max("hops"), F.lit(0)).cast("bigint")
    return found.agg(depth.alias("depth")).withColumn("shortened", (F.col("depth") > 0) & (F.col("depth") < asked))


def radius(found: DataFrame) -> DataFrame:
    """One row over counted chains: paths, services, deepest."""
    return found.agg(
        F.coalesce(F.sum("ways"), F.lit(0)).cast("bigint").alias("paths"), F.countDistinct("service").alias("services"), F.max("hops").cast("bigint").alias("deepest")
    )


def services(graph: Graph, found: DataFrame) -> DataFrame:
    """A row for each exposed service, from counted chains: criticality, shortest, paths, targets,
    entries, direct, runtime."""

    def listed(column: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(column)), ",")

    rows = found.groupBy("service").agg(
        F.min("hops").cast("bigint").alias("shortest"), F.sum("ways").alias("paths"), listed("target").alias("targets"), listed("entry").alias("entries"),
        F.bool_or("direct").alias("direct"), F.bool_or(~F.col("build_time")).alias("runtime"),
    )
    criticality = F.coalesce(F.nullif("criticality", F.lit("")), F.lit("unknown"))
    return rows.join(graph.services.select(F.col("name").alias("service"), criticality.alias("criticality")), "service")


def first_chains(found: DataFrame, each: int) -> DataFrame:
    """service, rank, hops, target, chain: the first ``each`` chains of every service by hops,
    target and chain; the rest is cut before it is gathered."""
    rows = found.select("service", "hops", "target", text().alias("chain"))
    rank = F.row_number().over(Window.partitionBy("service").orderBy("hops", "target", "chain"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= each).select("service", "rank", "hops", "target", "chain")


def _runtime_at(graph: Graph, as_of: int | None) -> DataFrame:
    """Runtime dependencies, those that hold at a moment where one is given. Without one, windows
    that never met count too, as reach asks what could be pulled in at all."""
    edges = graph.dependencies.where(F.col("rel_type") == S.DEPENDS_ON)
    return edges if as_of is None else edges.where(traverse.live(F.col("valid_from"), F.col("valid_to"), as_of))


def _spread(graph: Graph, bad: DataFrame, as_of: int | None, max_hops: int) -> tuple[DataFrame, int]:
    found, longest = traverse.spread(bad.select("key").distinct(), _runtime_at(graph, as_of), max_hops)
    return found.where("hops > 0"), longest


def reach(graph: Graph, bad: DataFrame, as_of: int | None = None, max_hops: int = S.REACH_HOPS) -> DataFrame:
    """One row: releases and packages reached besides the bad ones, and the longest chain. Nothing
    is capped, so unlike a list of paths it is never cut short."""
    found, longest = _spread(graph, bad, as_of, max_hops)
    others = found.select("head").distinct().join(bad.select(F.col("key").alias("head")), "head", "left_anti")
    named = found.select(package_of(F.col("head")).alias("package")).distinct().join(bad.select("package").distinct(), "package", "left_anti")
    counted = others.select(F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(named.select(F.lit(0).alias("r"), F.lit(1).alias("p")))
    return counted.agg(
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("releases"), F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("packages")
    ).withColumn("max_depth", F.lit(longest).cast("bigint"))


def reach_packages(graph: Graph, bad: DataFrame, as_of: int | None = None, max_hops: int = S.REACH_HOPS) -> DataFrame:
    """The packages reached and the fewest hops to each."""
    found, _ = _spread(graph, bad, as_of, max_hops)
    named = found.select(package_of(F.col("head")).alias("package"), "hops")
    return named.join(bad.select("package").distinct(), "package", "left_anti").groupBy("package").agg(F.min("hops").cast("bigint").alias("hops"))
