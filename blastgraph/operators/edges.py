"""Upserts and edge hygiene: last writer, known endpoints, precedence of kinds, counts of dependents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.coordinates import package_of
from .ranks import dealt


def last_written(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row per key, the one written last."""
    keys = [key] if isinstance(key, str) else key
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` added or in place of those with the same key."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def known_endpoints(edges: DataFrame, sources: DataFrame, targets: DataFrame, key: str = "key", tasks: int | None = None) -> DataFrame:
    """Edges both of whose ends exist. tasks: see ``dealt``."""
    ends = edges
    for end, known in (("source", sources), ("target", targets)):
        ends = dealt(ends, tasks, end).join(dealt(known.select(F.col(key).alias(end)), tasks, end), end, "left_semi")
    return ends


def unwritten_targets(edges: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """Edges whose target doesn't exist."""
    return edges.join(targets.select(F.col(key).alias("target")), "target", "left_anti")


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in S.KIND_ORDER]), kind), F.lit(99))


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each (type, source, target): the strongest kind, then the first declared."""
    order = Window.partitionBy("rel_type", "source", "target").orderBy(kind_rank(F.col("kind")), "ordinal", "valid_from")
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def declared_pins(pins: DataFrame) -> DataFrame:
    """One row for each (lockfile, name, version): direct if any of its entries is."""
    return pins.groupBy("source", "package", "version").agg(F.bool_or("direct").alias("direct"))


def dependent_counts(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """package, dependents: distinct packages with a release that depends on one of its releases,
    itself not counted; every known package has a row."""
    pairs = edges.select(package_of(F.col("source")).alias("dependent"), package_of(F.col("target")).alias("package")).where("dependent <> package")
    counts = pairs.distinct().groupBy("package").agg(F.count(F.lit(1)).alias("dependents"))
    return packages.select(F.col("name").alias("package")).join(counts, "package", "left").select("package", F.coalesce("dependents", F.lit(0)).cast("bigint").alias("dependents"))
