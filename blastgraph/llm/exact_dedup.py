"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their leading bytes, then each group that still holds two or more by
the following bytes, and so on until a group is a single document or its texts have ended.
The digit of round r is ``FIRST * GROWTH**r`` bytes wide, so a text of L bytes takes
O(log L) rounds. Group keys are the bytes themselves: no digest decides equality.

A round is one partial-then-final count per (group, digit) and one join that gives the rows of
groups of two or more their new group. The count shuffles a row per key and task, whatever the
size of a hot group; the join reads two shuffled inputs, so adaptive skew handling splits a hot
group over tasks. Single documents leave after the round that isolates them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, numbered_columns, pick, text_or_empty, with_rid, written

FIRST = 256
GROWTH = 16


def normalised(name: str = "text"):
    """Each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(text_or_empty(name), WHITE, " ")


def _split(rows: DataFrame) -> DataFrame:
    """rows: _rid, doc_id, bytes. One row per member of a group of two or more equal texts:
    _rid, n, keep_rid, keep_id."""
    width = FIRST
    done: list[DataFrame] = []
    rows = rows.select("_rid", "doc_id", F.lit(0).cast("long").alias("g"), F.col("bytes").alias("rest"))
    keys = ["g", "digit", "ended"]
    while True:
        dealt = rows.select(
            "_rid", "doc_id", "g", "rest",
            F.substring("rest", 1, width).alias("digit"),
            (F.octet_length("rest") <= width).alias("ended"),
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid")).alias("first")
        groups = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
        groups = written(
            groups.select(*keys, "n", F.col("first._rid").alias("keep_rid"), F.col("first.doc_id").alias("keep_id")),
            "radix-groups",
        )
        members = written(
            dealt.join(groups, keys).select(
                "_rid", "doc_id", F.col("keep_rid").alias("g"), "n", "keep_rid", "keep_id", "ended",
                F.when(~F.col("ended"), F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
            ),
            "radix-members",
        )
        done.append(members.where("ended").select("_rid", "n", "keep_rid", "keep_id"))
        rows = members.where("not ended").select("_rid", "doc_id", "g", "rest")
        if rows.isEmpty():
            break
        width *= GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest doc_id stays, ids
    before null; of rows that share that id exactly one stays. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = with_rid(
        pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")),
        "radix-input",
    )
    copies = _split(rows.select("_rid", "doc_id", F.col("norm").cast("binary").alias("bytes")))
    return (
        rows.select("_rid", "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
        .join(copies, "_rid", "left")
        .select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("_rid") == F.col("keep_rid"), F.lit(True)).alias("kept"),
            "text_sha256",
        )
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: the rows and columns that stay, unchanged. Columns are found, and
    null, empty and repeated rows count, as in ``duplicate_groups``, so the same rows stay; an empty
    table stays empty."""
    whole, (doc_id, text) = numbered_columns(docs, "doc_id", "text")
    rows = with_rid(whole, "radix-input")
    copies = _split(
        rows.select("_rid", F.col(doc_id).cast("long").alias("doc_id"), normalised(text).cast("binary").alias("bytes"))
    )
    gone = copies.where("_rid <> keep_rid").select("_rid")
    return rows.join(gone, "_rid", "left_anti").drop("_rid").toDF(*docs.columns)
