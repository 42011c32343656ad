"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints of 64 bits link when they differ in at most ``RADIUS`` = 4 bits. A fingerprint is
cut into three segments (22, 21 and 21 bits) that are read as words of the perfect binary Golay
code of length 23. ``near(s)`` is the set of codewords within distance 4 of a segment, one or
six of them: any two words at distance <= 2 share one (the codeword nearest to a word halfway
between them is within 1 + 3 of both). Pigeonhole over the segment errors e1 + e2 + e3 <= 4:

* no segment has more than two errors: the segments share a codeword each, so a triple of
  codeword indices (36 bits) is common;
* else one has three or four, and of the other two one has none and the other at most one:
  the bits of the first and a codeword index of the second are common (33 bits or more).

So every linked pair meets under a common key, and keys are long enough that chance meetings
stay rare as the corpus grows. Only distinct fingerprints get keys. Rows of a key arrive sorted
and are joined in numpy, verified by their distance; a key's links are given as a spanning
forest, never as all pairs. Keys of more than ``IN_BLOCK`` fingerprints (a large family of near
copies) take another exact way without pairs: each fingerprint sends its ball of radius 2 (2,081
centres) through an aggregate, and all that share a centre link to its smallest one: they are
within 4 of each other, and any two within 4 share a centre.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, numbered_columns, pick, text_or_empty, with_rid, written
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
IN_BLOCK = 4096
#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: Shingles whose bits are counted at once.
SHINGLE_BLOCK = 1 << 16
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text over its word shingles, repeats included; no words: 0."""
    norm = b" ".join(WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)))
    if not norm:
        return 0
    raw = np.frombuffer(norm, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    count = len(gaps) + 1
    if count <= words:
        return xxhash.xxh64_intdigest(norm, SEED)
    starts = np.concatenate([[0], gaps[: count - words] + 1]).tolist()
    ends = np.concatenate([gaps[words - 1 :], [len(norm)]]).tolist()
    ones, digest, n = np.zeros(64, np.int64), xxhash.xxh64_digest, len(starts)
    for at in range(0, n, SHINGLE_BLOCK):
        part = b"".join([digest(norm[a:b], SEED) for a, b in zip(starts[at : at + SHINGLE_BLOCK], ends[at : at + SHINGLE_BLOCK])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        known: dict[str, int] = {}
        for x in batch.column(1).to_pylist():
            if x not in known:
                known[x] = fingerprint(x)
        fps = np.array([known[x] for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


@lru_cache(1)
def remainders() -> np.ndarray:
    """Remainder by the generator polynomial of every value of a word's upper 12 bits."""
    r = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def syndromes(words: np.ndarray) -> np.ndarray:
    return (remainders()[words >> 11] ^ words) & 0x7FF


@lru_cache(1)
def golay() -> np.ndarray:
    """For each of the 2,048 syndromes the error patterns that lead from a word to the codewords
    within distance 4: one, or six where the nearest is at distance 3 (else the one repeated)."""
    patterns = [sum(1 << b for b in places) for weight in range(5) for places in combinations(range(23), weight)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for s, pattern in zip(syndromes(np.array(patterns, np.int64)).tolist(), patterns):
        found[s].append(pattern)
    return np.array([x + x[:1] * (6 - len(x)) for x in found], np.int64)


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (upper 12 bits) of the codewords within 4 of each word, six columns, and whether
    a column is its first showing."""
    errors = golay()[syndromes(words)]
    own = np.ones(errors.shape, bool)
    own[:, 1:] = errors[:, 1:] != errors[:, :1]
    return (words[:, None] ^ errors) >> 11, own


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (uint64): row of the fingerprint and key."""
    parts = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
    near = [near_codewords(p) for p in parts]
    (a, oa), (b, ob), (c, oc) = near
    rows, out = [], []
    key = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    own = oa[:, :, None, None] & ob[:, None, :, None] & oc[:, None, None, :]
    r = np.broadcast_to(np.arange(len(fps))[:, None, None, None], own.shape)
    rows.append(r[own])
    out.append(key[own])
    kind = 1
    for exact in range(3):
        for loose in range(3):
            if loose != exact:
                index, own = near[loose]
                key = (np.int64(kind) << 40) | (parts[exact][:, None] << 12) | index
                rows.append(np.broadcast_to(np.arange(len(fps))[:, None], own.shape)[own])
                out.append(key[own])
                kind += 1
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 2000):
            part = fps[at : at + 2000]
            rows, key = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], ["key", "fp"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links within RADIUS that join a set of distinct fingerprints as all its links would:
    a breadth-first forest, one pass of distances for each fingerprint."""
    left, links = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = distance(left, at) <= RADIUS
            if hit.any():
                found, left = left[hit], left[~hit]
                links += [(int(at.view(np.int64)), int(x)) for x in found.view(np.int64)]
                front += list(found)
    return links


def _links(in_block: int):
    """Of rows (key, fp) in order of the key: links (a, b), or (fp, null) for keys over ``in_block``."""

    def run(batches):
        key: int | None = None
        held: list[np.ndarray] = []
        size, large = 0, False

        def table(links, single=()):
            return pa.RecordBatch.from_pydict({
                "a": pa.array([x[0] for x in links] + list(single), pa.int64()),
                "b": pa.array([x[1] for x in links] + [None] * len(single), pa.int64()),
            })

        def ended():
            return forest(np.concatenate(held).view(np.uint64)) if size > 1 and not large else []

        for batch in batches:
            k, fp = (batch.column(i).to_numpy() for i in range(2))
            if not len(k):
                continue
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            # Runs of one that neither open nor end the batch have no partner; runs of two need one distance.
            inner = np.ones(len(starts), bool)
            inner[0] = inner[-1] = False
            n, links, single = ends - starts, [], []
            two = np.flatnonzero(inner & (n == 2))
            a, b = fp[starts[two]], fp[starts[two] + 1]
            ok = distance(a.view(np.uint64), b.view(np.uint64)) <= RADIUS
            links += zip(a[ok].tolist(), b[ok].tolist())
            for i in np.flatnonzero(~inner | (n > 2)):
                part, here = fp[starts[i] : ends[i]], int(k[starts[i]])
                if here != key:
                    links += ended()
                    key, held, size, large = here, [], 0, False
                size += len(part)
                held.append(part)
                if size > in_block:
                    single += [int(x) for p in held for x in p]
                    held, large = [], True
            yield table(links, single)
        yield table(ended())

    return run


def _centres(batches):
    """Each fingerprint with every word within 2 of it."""
    bits = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    flips = np.array(bits, np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 64):
            part = fps[at : at + 64]
            centre = (part.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(np.repeat(part, len(flips)))], ["centre", "fp"])


def fingerprint_links(fps: DataFrame, in_block: int = IN_BLOCK) -> DataFrame:
    """fps: fp (long, distinct). Links a, b between fingerprints within RADIUS that join them as
    all such links would."""
    spark = fps.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = fps.mapInArrow(_keyed, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    found = written(keyed.mapInArrow(_links(in_block), "a long, b long").distinct(), "simhash-links")
    plain = found.where("b is not null")
    crowded = found.where("b is null").select("a")
    if crowded.isEmpty():
        return plain
    balls = crowded.repartition(n).mapInArrow(_centres, "centre long, fp long")
    stars = balls.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    ball_links = written(
        balls.join(stars.select("centre", "b"), "centre").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct(),
        "simhash-stars",
    )
    return plain.unionByName(ball_links)


def _grouped(docs: DataFrame) -> DataFrame:
    """docs: _rid, doc_id, text. _rid, doc_id, fp, root, where root is any name of the component."""
    fps = written(docs.select("_rid", "text").mapInArrow(_fingerprints_rid, "_rid long, fp long"), "simhash-fps")
    roots = components(fingerprint_links(written(fps.select("fp").distinct(), "simhash-distinct")))
    return fps.join(written(roots.select(F.col("v").alias("fp"), "root"), "simhash-roots"), "fp", "left").select(
        "_rid", "fp", F.coalesce("root", "fp").alias("root")
    )


def _fingerprints_rid(batches):
    for batch in _fingerprints(batches):
        yield batch.rename_columns(["_rid", "fp"])


def row_links(texts: DataFrame) -> DataFrame:
    """texts: _rid, text. Links a, b between rows that join them as all links of their fingerprints would."""
    texts = texts.select("_rid", text_or_empty().alias("text"))
    fps = written(texts.mapInArrow(_fingerprints_rid, "_rid long, fp long"), "simhash-fps")
    least = written(fps.groupBy("fp").agg(F.min("_rid").alias("least")), "simhash-distinct")
    same = fps.join(least, "fp").where("_rid <> least").select(F.col("_rid").alias("a"), F.col("least").alias("b"))
    links = fingerprint_links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab")
    return same.unionByName(links.join(a, "a").join(b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most RADIUS bits reach, itself
    included; null ids are never the smallest unless the component has no other. Null and empty
    texts have fingerprint zero, linked like any other. Repeated rows stay rows; other columns
    are ignored; an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    fps = written(texts.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash-fps")
    smallest = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(fingerprint_links(smallest.select("fp")))
    named = smallest.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named, "simhash-named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = written(named.select("fp", "root").join(ids, "root").select("fp", "component_id"), "simhash-members")
    return fps.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, its smallest doc_id (null last): all columns,
    unchanged. Columns are found, and null, empty and repeated rows linked, as in
    ``near_duplicates``; an empty table stays empty."""
    arrow_limits(docs.sparkSession)
    whole, (doc_id, text) = numbered_columns(docs, "doc_id", "text")
    rows = with_rid(whole, "simhash-input")
    grouped = _grouped(rows.select("_rid", text_or_empty(text).alias("text")))
    grouped = grouped.join(rows.select("_rid", F.col(doc_id).cast("long").alias("doc_id")), "_rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid")).alias("first")
    stays = grouped.groupBy("root").agg(first).select(F.col("first._rid").alias("_rid"))
    return rows.join(stays, "_rid", "left_semi").drop("_rid").toDF(*docs.columns)
