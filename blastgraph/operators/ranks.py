"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written


def partitions(spark: SparkSession) -> int:
    """Tasks to deal rows to by hand."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` by these keys to so many tasks, which Spark doesn't join again as it does those of its own exchanges; None: left to Spark."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


def ranked(rows: DataFrame, *order: Column, name: str, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``rows`` as a table with ``_rank``, their place from 0 in the given order. Ranges of the order are
    sorted apart, and only the sizes of the ranges meet, a row for each. What the order leaves open
    is laid down once, by the table."""
    laid = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    laid = write(laid.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(starts), "_part").withColumn("_rank", place).drop("_part", "_start", "_at")
