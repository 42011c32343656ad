"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Documents are tokenised once and cut every ``SEQUENCE`` tokens; only the pieces' lengths and
checksums go on. Documents are dealt at random, by row, to groups of about ``GROUP_TOKENS`` tokens,
so no source, run of copies or repeated row gathers in one group; each group is packed on its own.
A group holds a few thousand pieces, and at most those of one longest document more: a text of two
gigabytes, the most a row can hold, has some hundred thousand. Full pieces take a sequence each. The
others go, longest first, to the first open sequence with room, which a tournament tree over the
sequences' free room finds in O(log n).
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, pick, text_or_empty, written
from .tokens import END_ID, encode, vocabulary_path

SEQUENCE = 4096
#: A group holds about so many tokens: 512 sequences, a few thousand pieces.
GROUP_TOKENS = 512 * SEQUENCE
SEED = 7041
PIECES = "_rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of sequences in a complete binary tree whose inner nodes hold the larger child."""

    def __init__(self, leaves: int, room: int):
        self.size = 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.best = [room] * (2 * self.size)

    def first_with(self, need: int) -> int:
        """The first sequence with room for ``need``; the tree has as many leaves as pieces, so there is one."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < need:
                node += 1
        return node - self.size

    def take(self, leaf: int, used: int) -> int:
        """Takes room; returns the offset of what was placed, counted from the full room."""
        best, node = self.best, leaf + self.size
        best[node] -= used
        left = best[node]
        while node > 1:
            node //= 2
            larger = max(best[2 * node], best[2 * node + 1])
            if best[node] == larger:
                break
            best[node] = larger
        return left


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, for lengths in decreasing order, 1..room."""
    full = sum(1 for n in lengths if n == room)
    bins, offsets = list(range(full)), [0] * full
    tree = Tournament(len(lengths) - full, room)
    for n in lengths[full:]:
        leaf = tree.first_with(n)
        left = tree.take(leaf, n)
        bins.append(full + leaf)
        offsets.append(room - left - n)
    return bins, offsets


def _pieces(path: str, room: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("_rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = memoryview(encode(text, path, END_ID))
                n = len(ids) // 4
                for start in range(0, n, room):
                    part = ids[4 * start : 4 * (start + room)]
                    for name, value in zip(out, (rid, doc_id, start, len(part) // 4, zlib.crc32(part), n)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def _packed(room: int):
    def run(key, pieces):
        pieces = pieces.sort_by([("length", "descending"), ("_rid", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(pieces["length"].to_pylist(), room)
        first = key[0].as_py() << 32
        pieces = pieces.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        pieces = pieces.append_column("sequence_id", pa.array([first | b for b in bins], pa.int64()))
        return pieces.append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, path: str | None = None, room: int = SEQUENCE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. Null and repeated ids and repeated
    rows are packed as rows of their own; other columns are ignored; an empty table gives an
    empty result. A sequence id is unique over all groups. Which documents share a group follows
    from their places in the input, so another file layout packs the same pieces in other company.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    path = path or vocabulary_path()
    texts = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = written(texts.mapInArrow(_pieces(path, room), PIECES), "pack-pieces")
    tokens = pieces.agg(F.sum("length").alias("n")).first().n or 0
    groups = max(1, -(-tokens // group_tokens))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("_rid", F.lit(SEED)), F.lit(groups)))
    return dealt.groupBy("pack").applyInArrow(_packed(room), PACKED)
