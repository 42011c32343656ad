"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this process where it is unset on a single machine."""
    global _LOCAL
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="blastgraph-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return f"file://{_LOCAL}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def path_of(df: DataFrame) -> str | None:
    """The folder of a table that ``written`` gave, None for any other DataFrame."""
    return getattr(df, "_written_to", None)


def round_trip(spark: SparkSession) -> DataFrame:
    """One row on the shared folder: whether a table that is written can be read back (readable), is gone
    once it is deleted (deletable), and how many milliseconds that took. What fails is false, and raises nothing."""
    began = time.perf_counter()
    readable = deletable = False
    path = f"{shared_folder(spark)}/probe-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        spark.range(1).withColumn("mark", F.lit(path)).write.parquet(path)
        readable = [r.mark for r in spark.read.parquet(path).collect()] == [path]
        system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        deletable = bool(system.delete(there, True)) and not system.exists(there)
    except Exception as e:  # whatever the store answers
        print(f"probe: {e}", file=sys.stderr)
    return spark.createDataFrame([(readable, deletable, readable and deletable, (time.perf_counter() - began) * 1e3)], "readable boolean, deletable boolean, healthy boolean, elapsed_ms double")
