"""Target-distribution importance resampling with hashed n-grams by CRC combination.

Features are the runs of 1 to ``max_n`` words of a text, hashed to buckets by the CRC-32 of their
bytes. CRC-32 is linear over GF(2): appending n bytes to a message multiplies its CRC, as a vector of
32 bits, by the n-th power of one 32 x 32 matrix. So each word's CRC is computed once, and the CRC of
"a b c" follows from those of its words, shifted by the lengths of what comes behind; no n-gram is
ever built. Powers of the matrix for lengths 1, 2, 4 ... are kept as four tables of 256 entries,
and whole arrays are shifted at once, bit by bit of their lengths.

The hashed features of each document are written once. Buckets are summed over all documents and
over all target texts (a row per bucket and task, then per bucket); the driver gets a number for
each bucket, ``buckets`` in all, never more. Scores add a Gumbel draw from a hash of the
document's id, so the highest scores are a sample without replacement in proportion to the weights; the
ranks come from sorted ranges, and the number drawn from one count.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, numbered_columns, pick, ranked, text_or_empty, with_rid, written
from .simhash import LOWER

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Percent of the documents with enough words that are drawn.
DRAWN = 10
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words of a lower-cased text in UTF-8: digits, letters and all beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text whose words are listed at once.
PIECE = 1 << 20
FEATURES = "_rid long, doc_id long, n_words long, n_features long, ids binary, times binary"


def _tables(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, as four tables of 256 products."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ columns[8 * byte + bit]
    return out


def _times(tables: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    parts = [tables[i][(vectors >> np.uint32(8 * i)) & np.uint32(255)] for i in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


@lru_cache(1)
def length_shifts() -> list[np.ndarray]:
    """Tables of the matrices that append 1, 2, 4, ... 2**31 zero bytes to a message."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    for _ in range(3):  # one bit, two, four, then a byte
        columns = _times(_tables(columns), columns)
    out = []
    for _ in range(32):
        out.append(_tables(columns))
        columns = _times(out[-1], columns)
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs as messages of these lengths behind them see them."""
    crcs, left, k = crcs.copy(), lengths.copy(), 0
    while left.any():
        odd = (left & 1).astype(bool)
        crcs[odd] = _times(length_shifts()[k], crcs[odd])
        left >>= 1
        k += 1
    return crcs


def word_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length in bytes of each word of a whole lower-cased text, in order."""
    crcs, lengths, at = [], [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            border = NO_WORD.search(text, end)
            end = border.start() if border else len(text)
        words = WORDS.findall(text, at, end)
        crcs.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        at = end
    return (np.concatenate(crcs), np.concatenate(lengths)) if crcs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, max_n: int) -> np.ndarray:
    """CRCs of all runs of 1 to max_n words joined by one blank."""
    blank, out, runs = np.uint32(zlib.crc32(b" ")), [crcs], crcs
    for n in range(2, min(max_n, len(crcs)) + 1):
        ahead = shifted(runs[:-1], np.ones(len(runs) - 1, np.int64)) ^ blank
        runs = shifted(ahead, lengths[n - 1 :]) ^ crcs[n - 1 :]
        out.append(runs)
    return np.concatenate(out)


def _featured(max_n: int, buckets: int):
    def run(batches):
        for batch in batches:  # _rid, doc_id, text as bytes
            words, sizes, ids, times = [], [], [], []
            for text in batch.column(2).to_pylist():
                crcs, lengths = word_crcs(text.translate(LOWER))
                found = ngram_crcs(crcs, lengths, max_n)
                own, n = np.unique(found % np.uint32(buckets), return_counts=True)
                words.append(len(crcs))
                sizes.append(len(found))
                ids.append(own.astype("<u4").tobytes())
                times.append(n.astype("<u4").tobytes())
            made = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["_rid", "doc_id", "n_words", "n_features", "ids", "times"])

    return run


def features(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """texts: _rid, doc_id, text. A table of each text's numbers of words and features, and of its
    buckets in order with the number of features in each."""
    arrow_limits(texts.sparkSession)
    raw = texts.select("_rid", "doc_id", text_or_empty().cast("binary").alias("text"))
    return written(raw.mapInArrow(_featured(max_n, buckets), FEATURES), "importance-features")


def _summed(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids, times in zip(*(batch.column(i).to_pylist() for i in range(2))):
                total[np.frombuffer(ids, "<u4")] += np.frombuffer(times, "<u4")
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket over all texts: the tasks' sums, summed; ``buckets`` rows at most reach the driver."""
    sums = found.select("ids", "times").mapInArrow(_summed(buckets), "bucket long, n long")
    counts = [0] * buckets
    for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds to a document's weight, in thousandths of a nat."""
    buckets = len(corpus)
    s_all, t_all = float(sum(corpus) + buckets), float(sum(target) + buckets)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)]


def _weighed(gain: list[int]):
    def run(batches):
        per_bucket = np.array(gain, np.int64)
        for batch in batches:  # _rid, doc_id, n_words, n_features, ids, times
            sums = [
                int(per_bucket[np.frombuffer(ids, "<u4")] @ np.frombuffer(times, "<u4").astype(np.int64))
                for ids, times in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            weights = [x // n if n else 0 for x, n in zip(sums, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, pa.int64())], ["_rid", "doc_id", "n_words", "n_features", "weight"])

    return run


def _drawn(texts: DataFrame, target: DataFrame, max_n: int, buckets: int, seed: int, min_words: int, drawn: int) -> DataFrame:
    """texts: _rid, doc_id, text. _rid, doc_id, n_features, weight, score, rank."""
    found = features(texts, max_n, buckets)
    wanted = features(pick(target, "text").select(F.lit(0).cast("long").alias("_rid"), F.lit(0).cast("long").alias("doc_id"), "text"), max_n, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weighed = found.mapInArrow(_weighed(gain), "_rid long, doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("fit", F.col("n_words") >= min_words)
    placed = ranked(scored, F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_rid"), name="importance-ranked")
    size = found.where(F.col("n_words") >= min_words).count() * drawn // 100
    rank = F.when(F.col("_rank") < F.lit(size), F.col("_rank") + 1).cast("long")
    return placed.select("_rid", "doc_id", "n_features", "weight", "score", rank.alias("rank"))


def importance(
    docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, drawn: int = DRAWN
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    ``target``: the table whose texts show the wanted distribution. Null and empty texts have no
    features and weight 0, on either side; a null doc_id is hashed as an empty string and comes last
    among equal scores. Repeated rows are rows, with the same score. Other columns are ignored; an
    empty table gives an empty result, an empty target counts nothing for it.
    """
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _drawn(rows, target, max_n, buckets, seed, min_words, drawn).drop("_rid")


def importance_sample(
    docs: DataFrame, target: DataFrame, max_n: int = 2, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, drawn: int = DRAWN
) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns unchanged; rows count as in ``importance``."""
    whole, (doc_id, text) = numbered_columns(docs, "doc_id", "text")
    rows = with_rid(whole, "importance-input")
    texts = rows.select("_rid", F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stays = _drawn(texts, target, max_n, buckets, seed, min_words, drawn).where("rank is not null").select("_rid")
    return rows.join(stays, "_rid", "left_semi").drop("_rid").toDF(*docs.columns)


#: CRC-32 in DuckDB's SQL: the table of a byte's remainders, and the sum over a column of hex digits.
CRC_TABLE_SQL = f"""bits AS (
        SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {POLYNOMIAL}) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
    ), tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def crc_sql(hexed: str) -> str:
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || substr({hexed}, i, 2))::BIGINT),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


#: The query's rows in DuckDB's SQL.
ORACLE_SQL = rf"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    texts AS (
        SELECT row_number() OVER () AS rid, doc_id, 1 AS side, text FROM documents
        UNION ALL SELECT NULL, NULL, 2, text FROM benchmark
    ), words AS (
        SELECT rid, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
    ), vocabulary AS (
        SELECT word, hex(encode(word)) AS hexed FROM (SELECT DISTINCT word FROM words)
    ), hashed AS (
        SELECT word, {crc_sql("hexed")} % {BUCKETS} AS bucket
        FROM vocabulary, tab
    ), found AS (SELECT rid, side, bucket FROM words JOIN hashed USING (word)),
    counts AS (
        SELECT bucket, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM found GROUP BY bucket
    ), gain AS (
        SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT count(*) FROM found WHERE side = 1) + {BUCKETS})::DOUBLE
            / ((s + 1)::DOUBLE * ((SELECT count(*) FROM found WHERE side = 2) + {BUCKETS})::DOUBLE))) AS gain FROM counts
    ), weights AS (
        SELECT rid, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE side = 1 GROUP BY rid
    ), scored AS (
        SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((
            ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM texts LEFT JOIN weights USING (rid) WHERE side = 1
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place FROM scored
    )
    SELECT doc_id, n_features, weight, score,
        CASE WHEN n_features >= {MIN_WORDS} AND place <= (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) * {DRAWN} // 100 THEN place END AS rank
    FROM placed"""
