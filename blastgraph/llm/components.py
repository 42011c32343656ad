"""Connected components of a link table, by randomised contraction.

In each round every vertex points to the neighbour (or itself) with the smallest hash of that
round, and the links are rewritten to what their ends point to; self links and repeats go. A
constant share of the vertices disappears per round in expectation, whatever the shape of the
graph, so chains and stars alike take O(log n) rounds (Bögeholz, Brand and Todor, "In-database
connected component analysis", 2020). Links, pointers and labels stay in tables; the driver only
learns whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _order(vertex, seed: int):
    return F.struct(F.xxhash64(vertex, F.lit(seed)).alias("h"), vertex.alias("v"))


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, no nulls). One row per linked vertex: v, root; one root per component."""
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.distinct(), "cc-links")
    pointers: list[DataFrame] = []
    seed = 0
    while not links.isEmpty():
        seed += 1
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_order(F.col("b"), seed)).alias("n"))
        own = _order(F.col("a"), seed)
        pointer = written(best.select(F.col("a").alias("v"), F.least("n", own)["v"].alias("p")), "cc-pointers")
        pointers.append(pointer)
        left = links.join(pointer.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        both_ends = left.join(pointer.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        moved = both_ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        old, links = links, written(moved.distinct(), "cc-links")
        dropped(old)
    if not pointers:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    # Vertices that later rounds still know move on; the others keep the root they have.
    labels = pointers[-1].select("v", F.col("p").alias("root"))
    for pointer in reversed(pointers[:-1]):
        later = labels.select(F.col("v").alias("p"), F.col("root").alias("later"))
        labels = written(
            pointer.join(later, "p", "left").select("v", F.coalesce("later", "p").alias("root")), "cc-labels"
        )
    return labels
