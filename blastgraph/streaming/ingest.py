"""Incremental ingest: new advisory documents become AFFECTS edges as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import advisories


def advisory_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Advisory documents of JSON-lines files that appear in a folder."""
    return spark.readStream.schema(advisories.DOCUMENT).json(folder)


def write_affects(stream: DataFrame, releases: DataFrame, target: str, checkpoint: str):
    """Matches each micro-batch against the releases and writes it under its batch number, so a
    batch that is run again replaces itself. Starts the query; runs until the input is used up."""

    def one(batch: DataFrame, number: int) -> None:
        advisories.affected_releases(advisories.parse(batch), releases).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
