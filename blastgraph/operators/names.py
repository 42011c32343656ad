"""Names that imitate popular ones.

The comparison is three equi-joins instead of all pairs: scoped copies by the bare name,
punctuation tricks by the stripped name, and edits by shared deletion variants (two names within
k edits share a form with at most k characters deleted), each pair then verified. Forms of names are
never broadcast: what Spark knows of their size is that of the names.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import distance
from .ranks import partitions


def stripped(name: Column) -> Column:
    return F.regexp_replace(name, "[-_.]", "")


def deletions(name: Column, k: int) -> Column:
    """The name and its forms with up to k characters deleted; native for one."""
    if k == 1:
        each = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))
        return F.when(F.length(name) > 0, F.array_distinct(F.concat(F.array(name), each))).otherwise(F.array(name))

    @F.pandas_udf("array<string>")
    def forms(names: pd.Series) -> pd.Series:
        def of(x: str) -> list[str]:
            return sorted({"".join(c for i, c in enumerate(x) if i not in out) for n in range(k + 1) for out in map(set, combinations(range(len(x)), min(n, len(x))))})

        return names.map(of)

    return forms(name)


def one_edit(names: DataFrame) -> DataFrame:
    """names: name. a, b of all different names that one edit turns into each other, both ways round. Names of one
    length meet by the place that differs and what is left without it, others by the shorter one, swaps by the swapped
    name: a pair meets once, and only pairs of one edit do."""
    each = names.select("name").repartition(partitions(names.sparkSession), "name").distinct()  # a name makes many forms
    at, length = F.col("at"), F.length("name")
    placed = each.where(length > 0).select("name", F.explode(F.sequence(F.lit(1), length)).alias("at"))
    left = placed.select("name", "at", F.concat(F.substr("name", F.lit(1), at - 1), F.substr("name", at + 1)).alias("form"))
    changed = left.withColumnRenamed("name", "a").join(left.withColumnRenamed("name", "b").hint("merge"), ["at", "form"]).where("a <> b").select("a", "b")
    # In a run of equal characters any place leaves the same: the last one stands for it.
    one, two = F.substr("name", at, F.lit(1)), F.substr("name", at + 1, F.lit(1))
    shorter = left.where(one != two).select(F.col("name").alias("a"), F.col("form").alias("b"), F.lit(True).alias("shorter"))
    turned = F.concat(F.substr("name", F.lit(1), at - 1), two, one, F.substr("name", at + 2))
    swapped = left.where((at < length) & (one != two)).select(F.col("name").alias("a"), turned.alias("b"), F.lit(False).alias("shorter"))
    known = shorter.unionByName(swapped).join(each.select(F.col("name").alias("b")).hint("merge"), "b")
    back = known.where("shorter").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return changed.unionByName(known.select("a", "b")).unionByName(back)


def suspects(packages: DataFrame, owners: DataFrame, popular_at: int = 25, max_distance: int = 1) -> DataFrame:
    """packages: package, dependents. owners: package, maintainer. One row for each suspect pair:
    name, resembles, trick, distance, dependents, target_dependents, shares_maintainer, ratio."""
    names = packages.where("package <> ''")
    popular = names.where(F.col("dependents") >= popular_at).select(F.col("package").alias("resembles"), F.col("dependents").alias("target_dependents"))
    rest = names.where(F.col("dependents") < popular_at).select(F.col("package").alias("name"), "dependents")
    scoped = rest.where("name like '@%'").withColumn("k", F.substring_index("name", "/", -1)).join(popular.withColumn("k", F.col("resembles")), "k")
    punct = rest.withColumn("k", stripped(F.col("name"))).join(popular.withColumn("k", stripped(F.col("resembles"))), "k")
    near = rest.withColumn("k", F.explode(deletions(F.col("name"), max_distance))).join(
        popular.withColumn("k", F.explode(deletions(F.col("resembles"), max_distance))).hint("merge"), "k"
    )
    columns = ("name", "resembles", "dependents", "target_dependents")
    edits = near.select(*columns).distinct().withColumn("d", distance(F.col("name"), F.col("resembles"), max_distance)).where(F.col("d") <= max_distance)
    label = F.when(F.col("d") == 1, "one edit").otherwise(F.concat(F.col("d").cast("string"), F.lit(" edits")))
    found = (
        scoped.select(*columns, F.lit(0).alias("rank"), F.lit("scoped copy").alias("trick"), F.lit(0).alias("distance"))
        .unionByName(punct.select(*columns, F.lit(1).alias("rank"), F.lit("punctuation").alias("trick"), F.lit(0).alias("distance")))
        .unionByName(edits.select(*columns, F.lit(2).alias("rank"), label.alias("trick"), F.col("d").alias("distance")))
        .where("dependents < target_dependents and name <> resembles")
    )
    best = found.groupBy(*columns).agg(F.min(F.struct("rank", "trick", "distance")).alias("best"))
    shared = (
        owners.select(F.col("package").alias("name"), "maintainer")
        .join(best.select("name", "resembles"), "name")
        .join(owners.select(F.col("package").alias("resembles"), "maintainer"), ["resembles", "maintainer"], "left_semi")
        .select("name", "resembles").distinct().withColumn("shares", F.lit(True))
    )
    ratio = F.coalesce(F.try_divide(F.col("dependents").cast("double"), F.col("target_dependents")), F.lit(0.0))
    return best.join(shared, ["name", "resembles"], "left").select(
        "name", "resembles", F.col("best.trick").alias("trick"), F.col("best.distance").alias("distance"), "dependents", "target_dependents",
        F.coalesce("shares", F.lit(False)).alias("shares_maintainer"), ratio.alias("ratio"),
    )
