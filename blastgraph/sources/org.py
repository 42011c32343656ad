"""Organisation manifests: which services there are and where their lockfiles lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

MANIFEST = "org string, description string, services array<struct<name:string,repo:string,criticality:string,path:string,committed_at:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """org, name, repo, criticality, path, committed_at of every service; a commit time is an ISO
    stamp or epoch seconds, else the file's own time."""
    files = spark.read.schema(MANIFEST).json(path, multiLine=True).select("org", F.explode("services").alias("s"), F.col("_metadata.file_modification_time").alias("t"))
    committed = F.coalesce(times.epoch(F.col("s.committed_at")), F.col("s.committed_at").try_cast("bigint"), F.unix_timestamp("t"))
    return files.select(
        "org", "s.name", F.coalesce("s.repo", F.lit("")).alias("repo"), F.coalesce(F.nullif("s.criticality", F.lit("")), F.lit("unknown")).alias("criticality"),
        F.coalesce("s.path", "s.name").alias("path"), committed.alias("committed_at"),
    )
