"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

``run`` applies the stages in order; each is written as Parquet in the shared folder and read
again as the next one's documents. All but the last return the columns of ``documents``. Every
stage finds the columns it needs by an exact name, else by one that equals it but for case; null
texts count as empty ones, repeated rows as rows; an empty table passes through all stages and
gives an empty result.
"""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from blastgraph.llm import exact_dedup, mixing, packing, similar, simhash, toxicity
from blastgraph.llm.common import Scratch, scratch_path

#: For each thread and folder of tables: stage, when its result was given, and its intermediate tables.
_made: dict[tuple[int, str], list[tuple[int, float, Scratch]]] = {}


def _written_at(docs: DataFrame) -> float:
    """When the last file of a table was written; the beginning of time for one without files."""
    spark, latest = docs.sparkSession, 0.0
    for file in docs.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        latest = max(latest, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() / 1e3)
    return latest


@contextmanager
def _scratch(stage: int, docs: DataFrame, sf_dir: str):
    """Keeps track of a stage's intermediate tables. Those of an earlier stage of this thread over the same
    folder go once its result can't be needed: ``docs`` was written after it was given, and reads none of them."""
    mine = _made.setdefault((threading.get_ident(), sf_dir), [])
    written_at = _written_at(docs)
    for entry in [e for e in mine if e[0] < stage and e[1] <= written_at]:
        entry[2].clear(docs)
        mine.remove(entry)
    with Scratch(docs.sparkSession) as tables:
        yield
    mine.append((stage, time.time(), tables))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on the labelled documents doesn't reject; an empty text is
    scored as one. Labels without an id or a value are left out, and null ids have none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with _scratch(0, docs, sf_dir):
        return toxicity.drop_toxic(docs, toxicity.train(source, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id, ids before null."""
    with _scratch(1, docs, sf_dir):
        return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of fingerprints or of five-word shingles at least 0.8 similar join,
    the one with the smallest id, ids before null."""
    with _scratch(2, docs, sf_dir):
        return similar.similar_dedup(docs, more=simhash.row_links)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words never, a null source is a
    source of its own."""
    with _scratch(3, docs, sf_dir):
        return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    with _scratch(4, docs, sf_dir):
        return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, a trained model and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
