"""Helpers that the operators share: column picking, scratch tables, text rules."""

from __future__ import annotations

import gc
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import ranks
from ..operators.ranks import partitions  # noqa: F401
from ..storage import shared_folder

#: The white space that every contract names: blank, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"
#: Upper bound of an Arrow batch that a Python worker holds at once.
ARROW_BATCH_BYTES = 16 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there,
    so a lost executor costs one task's read and never a recomputation of what lies before."""
    out = storage.written(df, name, "zstd")
    for scope in _SCOPES.get():
        scope.add(out)
    return out


def delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def dropped(df: DataFrame) -> None:
    """Deletes the table of ``written`` that ``df`` is; nothing may read it any more."""
    path = storage.path_of(df)
    if path:
        delete(df.sparkSession, path)


class Scratch:
    """The tables that ``written`` makes inside a ``with`` block of this thread. ``clear`` deletes them all but
    those that the given results still read; tables of other queries in the session are never touched."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._before = spark, [], None

    def add(self, df: DataFrame) -> None:
        self.paths.append(storage.path_of(df))

    def __enter__(self) -> Scratch:
        self._before = _SCOPES.set((*_SCOPES.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.reset(self._before)

    def clear(self, *but: DataFrame) -> None:
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in but for f in df.inputFiles()}
        for path in [p for p in self.paths if p.rsplit("/", 1)[-1] not in read]:
            delete(self.spark, path)
            self.paths.remove(path)
        free_shuffles(self.spark)


_SCOPES: ContextVar[tuple[Scratch, ...]] = ContextVar("scopes", default=())


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are gone: it does so when the JVM, and before
    it Python, notice that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def places(columns: list[str], *names: str) -> list[int]:
    """Where the named columns are: an exact name first, else the first that equals it but for case."""
    out = []
    for name in names:
        found = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"column {name!r} is missing; there are {columns}")
        out.append(found[0])
    return out


def numbered_columns(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by position, so that no two clash, and the new names of the
    named ones. ``toDF`` with the old names turns it back."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, [f"c{i}" for i in places(df.columns, *names)]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by ``places``, so other columns with clashing names never
    make it ambiguous."""
    plain, found = numbered_columns(df, *names)
    return plain.select(*[F.col(c).alias(n) for c, n in zip(found, names)])


def with_rid(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long ``_rid`` for each row, fixed by writing the table.

    Repeated rows and null or repeated ids stay separate rows under it.
    """
    return written(df.withColumn("_rid", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """``operators.ranks.ranked`` with its table tracked by scope."""
    return ranks.ranked(rows, *order, name=name, write=written)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def arrow_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch brings to a Python worker, so very long texts stay in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
