"""Evaluation: recent incidents, blast radius against baselines, scores.

All incidents are answered together. A release's label is the set of incidents that it belongs to, so one
backward traversal counts the chains of all of them, and one forward walk, which starts at what
services pin and knows no incident until it meets a bad release, checks it service by service.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.coordinates import package_of
from ..functions.distance import osa
from ..graph import Graph
from ..operators import traverse
from ..storage import written


def incidents(graph: Graph, limit: int = 20) -> DataFrame:
    """The latest advisories that affect a release: osv_id, severity, published_at. Of the latest
    ``4 * limit`` affected releases the advisories are taken in order, each once."""
    hits = graph.affects.join(graph.advisories.select("osv_id", "severity", "published_at"), "osv_id")
    latest = hits.select("osv_id", "severity", "published_at", "target").orderBy(F.desc("published_at"), "osv_id", "target").limit(4 * limit)
    once = latest.groupBy("osv_id", "severity", "published_at").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return once.orderBy(F.desc("published_at"), "osv_id").limit(limit)


@dataclass
class Labels:
    """releases: head, label. cases: label, case; the sets of cases that a label names."""

    releases: DataFrame
    cases: DataFrame

    @classmethod
    def of(cls, bad: DataFrame) -> Labels:
        """bad: case, key. A label for each distinct set of cases that some release belongs to."""
        sets = bad.groupBy(F.col("key").alias("head")).agg(F.array_sort(F.collect_set("case")).alias("set"))  # at most one for each case
        named = written(sets.withColumn("label", F.sha2(F.to_json("set"), 256)), "labels")
        return cls(named.select("head", "label"), written(named.select("label", F.explode("set").alias("case")).distinct(), "label-cases"))


#: Wrong names that are compared with every name at once.
NAMES_AT_ONCE = 1_000


def _nearest(pairs: list[tuple[str, str]], ceiling: int, limit: int):
    """Of batches of names (package): for each case the ``limit`` of a task that are nearest to one of its
    wrong names and none of them themselves."""
    of: dict[str, list[str]] = {}
    for case, wrong in pairs:
        of.setdefault(case, []).append(wrong)

    def run(frames):
        held: dict[str, pd.DataFrame] = {}
        for frame in frames:
            names = frame["package"].tolist()
            for case, wrong in of.items():
                least = None
                for w in wrong:
                    d = osa(names, [w] * len(names), ceiling)
                    least = d if least is None else np.minimum(least, d)
                rows = pd.DataFrame({"package": names, "distance": least})
                rows = rows[~rows["package"].isin(wrong)]
                both = pd.concat([held[case], rows]) if case in held else rows
                held[case] = both.sort_values(["distance", "package"]).head(limit)
        for case, rows in held.items():
            yield rows.assign(case=case)[["case", "package", "distance"]].astype({"distance": "int64"})

    return run


def by_name_similarity(packages: DataFrame, bad: DataFrame, ceiling: int = 12, limit: int = 25) -> DataFrame:
    """packages: package. bad: case, package. case, package, distance: for each case the names nearest to
    one of its packages', all those further than the ceiling alike. Every name is measured, in blocks
    of wrong names of a fixed size; a task passes on ``limit`` names for each case."""
    wrong = bad.select("case", "package").distinct().orderBy("case", "package")
    names = packages.select("package").where("package <> ''").distinct()
    best: DataFrame | None = None
    block: list[tuple[str, str]] = []

    def measured(pairs: list[tuple[str, str]]) -> DataFrame:
        return written(names.mapInPandas(_nearest(pairs, ceiling, limit), "case string, package string, distance long"), "nearest")

    for r in wrong.toLocalIterator():
        if len(block) >= NAMES_AT_ONCE and block[-1][0] != r.case:  # a case's names stay together
            best = measured(block) if best is None else best.unionByName(measured(block))
            block = []
        block.append((r.case, r.package))
    if block:
        best = measured(block) if best is None else best.unionByName(measured(block))
    if best is None:
        return bad.select("case", "package", F.lit(0).cast("long").alias("distance")).limit(0)
    place = F.row_number().over(Window.partitionBy("case").orderBy("distance", "package"))
    return best.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


@dataclass
class Walks:
    """services: case, service, paths (at most the cap). releases: case, release on their chains."""

    services: DataFrame
    releases: DataFrame


def _sources(graph: Graph, near: DataFrame) -> DataFrame:
    """entry, source, pins: the releases that a service's lockfiles pin, and in how many places; of those in near (head)."""
    pins = graph.pins.select(F.col("source").alias("key"), F.col("target").alias("entry")).join(near.select(F.col("head").alias("entry")), "entry", "left_semi")
    return pins.join(graph.lockfiles.select("key", F.col("service").alias("source")), "key").groupBy("entry", "source").agg(F.count(F.lit(1)).alias("pins"))


def service_by_service(graph: Graph, bad: DataFrame, cap: int = S.BASELINE_PATHS, max_hops: int = S.BLAST_HOPS) -> Walks:
    """What asking for each service alone would show: a walk forward from what it pins, along dependencies
    whose windows meet, to the bad releases; shortest chains first, no further than the hop at which the service has
    ``cap`` chains. bad: case, key. Services that share a pinned release share its walk, and a walk leaves out what no bad
    release can be reached from."""
    labels = Labels.of(bad)
    near = traverse.nearness(labels.releases, graph.dependencies, max_hops - 2)
    sources = written(_sources(graph, near), "sources")
    entries = sources.select(F.col("entry").alias("key")).distinct()
    hits, passed = traverse.forward(entries, graph.dependencies, labels.releases, max_hops - 2, sources, cap, graph.loops(), near)
    met = written(hits.join(sources, "entry").join(labels.cases, "label").groupBy("case", "source", "hops").agg(F.sum(F.col("ways") * F.col("pins")).alias("n")), "met")
    found = met.groupBy("case", F.col("source").alias("service")).agg(F.least(F.sum("n"), F.lit(cap)).cast("bigint").alias("paths"))
    return Walks(found, passed.join(labels.cases, "label").select("case", "release").distinct())


def exposed(graph: Graph, bad: DataFrame, max_hops: int = S.BLAST_HOPS) -> DataFrame:
    """case, service of the services that the batched plan says are exposed: one backward traversal for
    the cases of all labels. bad: case, key."""
    labels = Labels.of(bad)
    counted = traverse.ways(labels.releases.withColumnRenamed("head", "key"), graph.dependencies, max_hops - 2, loops=graph.loops())
    found = traverse.service_ways(counted, graph.pins, graph.lockfiles).select(F.col("target").alias("label"), "service").distinct()
    return found.join(labels.cases, "label").select("case", "service").distinct()


def scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected, found: case, item. A row for each case: matched, missed, invented, precision,
    recall, agrees; shares of nothing count as 1."""
    both = expected.select("case", "item").distinct().withColumn("e", F.lit(1)).join(
        found.select("case", "item").distinct().withColumn("f", F.lit(1)), ["case", "item"], "full"
    )
    counts = both.groupBy("case").agg(
        F.count(F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), 1)).alias("matched"), F.count(F.when(F.col("f").isNull(), 1)).alias("missed"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("invented"),
    )
    m = F.col("matched").cast("double")
    return counts.select(
        "case", "matched", "missed", "invented", F.coalesce(F.try_divide(m, F.col("matched") + F.col("invented")), F.lit(1.0)).alias("precision"),
        F.coalesce(F.try_divide(m, F.col("matched") + F.col("missed")), F.lit(1.0)).alias("recall"), ((F.col("missed") == 0) & (F.col("invented") == 0)).alias("agrees"),
    )


def evaluate(graph: Graph, limit: int = 20) -> DataFrame:
    """A row for each recent incident: osv_id, severity, exposed (services by the batched plan), agrees (whether the
    walks service by service say the same of every service), and how well name similarity names the packages on the
    walks' chains: matched, missed, invented, precision, recall."""
    cases = written(incidents(graph, limit), "incidents")
    hit = graph.affects.select(F.col("osv_id").alias("case"), F.col("target").alias("key"), "package").distinct()
    bad = written(hit.join(cases.select(F.col("osv_id").alias("case")), "case", "left_semi"), "bad")
    ours = written(exposed(graph, bad), "exposed")
    walks = service_by_service(graph, bad)
    same = scores(walks.services.select("case", F.col("service").alias("item")), ours.select("case", F.col("service").alias("item"))).select("case", "agrees")
    implicated = walks.releases.select("case", package_of(F.col("release")).alias("item")).distinct()
    ranking = by_name_similarity(graph.packages.select(F.col("name").alias("package")), bad)
    judged = scores(implicated, ranking.select("case", F.col("package").alias("item"))).drop("agrees")
    counted = ours.groupBy("case").agg(F.count(F.lit(1)).alias("exposed"))
    rows = cases.withColumnRenamed("osv_id", "case").join(counted, "case", "left").join(same, "case", "left").join(judged, "case", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("matched", "missed", "invented")]
    return rows.select(
        F.col("case").alias("osv_id"), "severity", F.coalesce("exposed", F.lit(0)).alias("exposed"), F.coalesce("agrees", F.lit(True)).alias("agrees"), *zero,
        F.coalesce("precision", F.lit(1.0)).alias("precision"), F.coalesce("recall", F.lit(1.0)).alias("recall"),
    )


def timings(graph: Graph, limit: int = 20) -> tuple[float, float]:
    """Milliseconds of the batched plan and of the walks service by service, each for all recent incidents."""
    cases = incidents(graph, limit).select("osv_id")
    bad = written(graph.affects.join(cases, "osv_id", "left_semi").select(F.col("osv_id").alias("case"), F.col("target").alias("key")).distinct(), "bad")
    out = []
    for question in (lambda: exposed(graph, bad), lambda: service_by_service(graph, bad).services):
        began = time.perf_counter()
        question().write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - began) * 1e3)
    return out[0], out[1]


def report(graph: Graph, limit: int = 20) -> DataFrame:
    """``evaluate`` with blast_ms and baseline_ms, what all incidents took together, and their quotient as speedup."""
    plan, walks = timings(graph, limit)
    return evaluate(graph, limit).select("*", F.lit(plan).alias("blast_ms"), F.lit(walks).alias("baseline_ms"), F.lit(walks / plan).alias("speedup"))


def summary(cases: DataFrame, speedup: str | None = None) -> DataFrame:
    """One row over ``evaluate``'s cases: cases, agreement (1 for none), and the mean similarity_precision and
    similarity_recall of exposed cases (0 for none). speedup: a column of the cases, of which the upper median is
    given as median_speedup (0 for none)."""
    exposed_ = F.col("exposed") > 0
    middle = [] if speedup is None else [F.coalesce(F.get(F.sort_array(F.collect_list(speedup)), F.floor(F.count(F.lit(1)) / 2).cast("int")), F.lit(0.0)).alias("median_speedup")]  # of at most ``limit`` cases
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(F.col("agrees").cast("double")), F.lit(1.0)).alias("agreement"), *middle,
        F.coalesce(F.avg(F.when(exposed_, F.col("precision"))), F.lit(0.0)).alias("similarity_precision"),
        F.coalesce(F.avg(F.when(exposed_, F.col("recall"))), F.lit(0.0)).alias("similarity_recall"),
    )
