"""Near copies by shingle similarity, found through Golay keys of a wide SimHash.

The four-bit links of ``simhash`` only join texts that are all but equal: at a Jaccard similarity
of 0.8 some 15 % of a fingerprint's bits differ. Here the fingerprint has ``WORDS64`` words of 64
bits over five-word shingles; each gives two segments of 23 bits, and two neighbouring segments
make a key of two codeword indices, several for each (``simhash.near_codewords``). Rows that meet
under a key and agree in the first 128 bits about as well as similar texts do are met; a key gives
a spanning forest of them, never all pairs. The components of what all keys give are families: any
two rows that met are in the same one.

A family is then compared in place. Its rows come together with their whole fingerprints and sets of
shingles; pairs that differ in too many bits are passed over, the others are compared exactly, and
whoever is joined already is passed over too. What leaves the task are verified links, fewer than
the family has rows. A family of more than ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of shingles is
first joined along its spanning forest, so a large group of near copies becomes one component at
linear cost; only what that leaves apart is compared, block against block, and rows of the family's
largest component never with one another.

Verification makes every link right. Finding is probabilistic: a pair of similarity 0.8 meets
with the probability that the README states, more similar pairs with more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, free_shuffles, numbered_columns, text_or_empty, with_rid, written
from .components import components
from .simhash import LOWER, SEED, SHINGLE_BLOCK, WORDS, distance, near_codewords

SHINGLE = 5
SIMILAR = 0.8
WORDS64 = 6
SEGMENT = 23
#: Differing bits up to which candidates go on: of the first 128, and of the whole fingerprint.
NEAR128, NEAR_WIDE = 36, 84
#: Rows of a key that are held at once, and rows that are compared with others at once.
IN_BLOCK, AROUND = 2048, 256
#: Rows of a key up to which keys of one size are looked at together.
FEW = 9
#: Rows, and bytes of shingle hashes, of a block of a family.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
#: Pairs of neighbouring segments, and how many of them have their keys on disk at once.
SLOTS, AT_ONCE = 2 * WORDS64, 2
#: Odd multipliers that mix one shingle hash into more words.
MIXERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
FPS = [f"f{i}" for i in range(WORDS64)]
WIDE = "_rid long, " + ", ".join(f"{f} long" for f in FPS)


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle of a whole text in order, repeats included; fewer words: one for all; none: empty."""
    norm = b" ".join(WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)))
    if not norm:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) + 1 <= words:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    starts = np.concatenate([[0], gaps[: len(gaps) + 1 - words] + 1]).tolist()
    ends = np.concatenate([gaps[words - 1 :], [len(norm)]]).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(norm[a:b], SEED) for a, b in zip(starts, ends)]), ">u8").astype(np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS64 words of SimHash from the hashes of a text's shingles."""
    out = np.zeros(WORDS64, np.uint64)
    for k, mixer in enumerate(MIXERS[:WORDS64]):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), SHINGLE_BLOCK):
            h = hashes[at : at + SHINGLE_BLOCK] * np.uint64(mixer)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(MIXERS[0])
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes)).view(np.uint64)[0]
    return out


def _fingerprinted(batches):
    for batch in batches:
        rids, rows = [], []
        for rid, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            hashes = np.unique(shingle_hashes(text))  # a set, as the similarity is one of sets
            if len(hashes):
                rids.append(rid)
                rows.append(wide_fingerprint(hashes).view(np.int64))
        table = np.array(rows, np.int64).reshape(-1, WORDS64)
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), *(pa.array(table[:, i]) for i in range(WORDS64))], ["_rid", *(f"f{i}" for i in range(WORDS64))])


def wide_keys(table: np.ndarray, slots: range = range(SLOTS)) -> tuple[np.ndarray, np.ndarray]:
    """Row and key for the named pairs of neighbouring segments of fingerprints (rows x WORDS64, uint64)."""
    mask = np.uint64((1 << SEGMENT) - 1)
    segments = {i % SLOTS for t in slots for i in (t, t + 1)}
    near = {i: near_codewords(((table[:, i // 2] >> np.uint64(i % 2 * SEGMENT)) & mask).astype(np.int64)) for i in segments}
    rows, keys = [], []
    for t in slots:
        (a, own_a), (b, own_b) = near[t], near[(t + 1) % SLOTS]
        own = own_a[:, :, None] & own_b[:, None, :]
        key = (np.int64(t) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        rows.append(np.broadcast_to(np.arange(len(table))[:, None, None], own.shape)[own])
        keys.append(key[own])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(slots: range):
    """Rows (_rid, label, f0 ...): key, _rid, label, f0, f1 for every key of the slots."""

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for at in range(0, len(columns[0]), 1000):
                table = np.column_stack([c[at : at + 1000] for c in columns[2:]]).view(np.uint64)
                rows, key = wide_keys(table, slots)
                carried = [pa.array(c[at : at + 1000][rows]) for c in columns[:4]]
                yield pa.RecordBatch.from_arrays([pa.array(key), *carried], ["key", "_rid", "label", "f0", "f1"])

    return run


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the first 128 bits; the last axis holds the two words."""
    return distance(x, y).astype(np.int16).sum(-1)


def _spanning(rows: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between near rows (_rid, label) that join them as all near pairs would: a forest, breadth first."""
    left, links = np.arange(len(rows)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = apart(fps[left], fps[at]) <= NEAR128
            if hit.any():
                found, left = left[hit], left[~hit]
                links.append((np.tile(rows[at], (len(found), 1)), rows[found]))
                front += found.tolist()
    return links


def _met(batches):
    """Rows (key, _rid, label, f0, f1) in order of the key, then of the fingerprint: links that join
    the near rows of each key, from a row a to one behind it, b, so a key links to each b a few times
    at most. Rows of one label are joined already, so no link between them is given. A key of more
    than IN_BLOCK rows is joined whole, near or not."""
    held: list[tuple[np.ndarray, ...]] = []
    key, size, before = None, 0, None

    def ended(links: list, whole: bool) -> None:
        nonlocal before
        if not held:
            return
        rows, fps = map(np.concatenate, zip(*held))
        if whole and before is None:
            links += _spanning(rows, fps)
            return
        rest = rows[1:] if before is None else rows
        links.append((np.tile(rows[0] if before is None else before, (len(rest), 1)), rest))
        before = rows[0]

    def table(links: list):
        x, y = map(np.concatenate, zip(*links)) if links else (np.zeros((0, 2), np.int64),) * 2
        apart_yet = x[:, 1] != y[:, 1]
        pairs = np.unique(np.column_stack([x[apart_yet, 0], y[apart_yet, 0]]), axis=0)
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    for batch in batches:
        k = batch.column(0).to_numpy()
        row = np.column_stack([batch.column(i).to_numpy() for i in (1, 2)])  # _rid, label
        fp = np.column_stack([batch.column(i).to_numpy() for i in (3, 4)]).view(np.uint64)
        if not len(k):
            continue
        links: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        later = np.ones(len(starts), bool)  # keys that open or end the batch, and those with many near pairs
        later[1:-1] = False
        n = ends - starts
        later |= n > FEW
        for m in range(2, FEW + 1):
            at = starts[~later & (n == m)]
            if not len(at):
                continue
            near = [(i, j, apart(fp[at + i], fp[at + j]) <= NEAR128) for i, j in combinations(range(m), 2)]
            many = sum(ok for *_, ok in near) > m
            links += [(row[at[ok & ~many] + i], row[at[ok & ~many] + j]) for i, j, ok in near]
            later[np.searchsorted(starts, at[many])] = True
        for i in np.flatnonzero(later):
            if int(k[starts[i]]) != key:
                ended(links, True)
                key, held, size, before = int(k[starts[i]]), [], 0, None
            for at in range(starts[i], ends[i], IN_BLOCK):
                part = slice(at, min(at + IN_BLOCK, ends[i]))
                held.append((row[part], fp[part]))
                size += part.stop - part.start
                if size > IN_BLOCK:
                    ended(links, False)
                    held, size = [], 0
        yield table(links)
    links = []
    ended(links, True)
    yield table(links)


class Family:
    """Rows of a family, or of two of its blocks, with what compares them. Components known so far
    are roots; a link that is found makes two of them one."""

    def __init__(self, block: np.ndarray, root: np.ndarray, rid: np.ndarray, fps: np.ndarray, sets: list[bytes]):
        # Roots of few rows first: a root of most rows is then only met by the others, never by itself.
        _, place, size = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((rid, place, size[place]))
        self.block, self.rid, self.fps, self.root = block[order], rid[order], fps[order], place[order]
        sets = [np.frombuffer(sets[i], np.uint64) for i in order]
        self.size = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        distinct, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def similarity(self, x: int, others: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a row's set of shingles with those of others."""
        mine = self.codes[self.starts[x] : self.ends[x]]
        self.mark[mine] = True
        if 4 * self.size[others].sum() > len(self.codes):
            both = np.add.reduceat(self.mark[self.codes], self.starts, dtype=np.int64)[others]
        else:
            theirs = self.mark[np.concatenate([self.codes[self.starts[y] : self.ends[y]] for y in others])]
            both = np.add.reduceat(theirs, np.cumsum(self.size[others]) - self.size[others], dtype=np.int64)
        self.mark[mine] = False
        return both / (self.size[x] + self.size[others] - both)

    def links(self, similar: float, across: bool) -> list[tuple[int, int]]:
        """Verified links that join the rows as all similar pairs would (``across``: pairs of
        different blocks)."""
        out, n = [], len(self.rid)
        for start in range(0, n, AROUND):
            if (self.root[start:] == self.root[start]).all():
                break  # what is left is one component
            end = min(start + AROUND, n)
            near = apart(self.fps[start:end, None, :2], self.fps[None, start:, :2]) <= NEAR128
            for x in range(start, end):
                others = start + np.flatnonzero(near[x - start])
                others = others[(others > x) & (self.root[others] != self.root[x])]
                if across:
                    others = others[self.block[others] != self.block[x]]
                others = others[apart(self.fps[others], self.fps[x]) <= NEAR_WIDE]
                if not len(others):
                    continue
                for y in others[self.similarity(x, others) >= similar].tolist():
                    if self.root[y] != self.root[x]:
                        out.append((int(self.rid[x]), int(self.rid[y])))
                        self.root[self.root == self.root[y]] = self.root[x]
        return out


def _compared(similar: float):
    """Rows (family, i, j, block, root, _rid, shingles, f0 ...) in order of the first three, where i and
    j name two blocks of a family or twice the same: verified links a, b."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        group = None

        def ended():
            if not held:
                return []
            rows = pa.Table.from_batches(held).combine_chunks()
            fps = np.column_stack([rows[f].to_numpy() for f in FPS]).view(np.uint64)
            family = Family(*(rows[c].to_numpy() for c in ("block", "root", "_rid")), fps, rows["shingles"].to_pylist())
            return family.links(similar, group[1] != group[2])

        def table(links):
            x, y = (np.array([k[i] for k in links], np.int64) for i in range(2))
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            links = []
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (here := tuple(int(c[at]) for c in columns)) != group:
                    links += ended()
                    group, held = here, []
                held.append(batch.slice(at, to - at))
            yield table(links)
        yield table(ended())

    return run


def _shingled(batches):
    for batch in batches:  # _rid, text, family
        sets = [np.unique(shingle_hashes(x)).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], ["_rid", "family", "shingles"])


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _verified(similar: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = [i for i in range(len(a)) if jaccard(x[i], y[i]) >= similar]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in ok], pa.int64()), "b": pa.array([b[i] for i in ok], pa.int64())})

    return run


def _contracted(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met: a, b. For every b the link to its smallest a; and links of that one to b's other ones.
    Both together join rows as ``met`` does, with far fewer links where many keys join the same
    rows. A b has a bounded number of links, some for each of its keys."""
    least = F.min("a").over(Window.partitionBy("b"))
    others = met.select(least.alias("a"), F.col("a").alias("b")).where("a <> b").distinct()
    return met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), others


def _families(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_rid, family of all rows that the links join, and a star of links for each row."""
    stars, others = _contracted(met)
    stars = written(stars, "similar-stars")
    return components(stars.unionByName(others)).select(F.col("v").alias("_rid"), F.col("root").alias("family")), stars


def _joined(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs that are so similar."""
    one = sets.select(F.col("_rid").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("_rid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_verified(similar), "a long, b long"), "similar-joined")


def _in_blocks(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows: family, _rid and more, of large families. Each row with its root by the links, its block,
    and the pairs of blocks (i, j) it is compared in: blocks of all but the largest component with
    every block. Families that the links join whole are gone."""
    named = rows.join(components(links).withColumnRenamed("v", "_rid"), "_rid", "left").withColumn("root", F.coalesce("root", "_rid"))
    named = written(named, "similar-named")
    by_root = named.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    largest = by_root.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))

    def needed(n, size):
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES))

    rest = F.col("root") != F.col("largest")
    sums = [F.coalesce(F.sum(F.when(rest if few else ~rest, F.col(c))), F.lit(0)) for few in (True, False) for c in ("n", "bytes")]
    counted = by_root.join(largest, "family").groupBy("family", "largest").agg(*[s.alias(name) for s, name in zip(sums, ("few_n", "few_bytes", "most_n", "most_bytes"))])
    blocks = counted.where("few_n > 0").select("family", "largest", needed(F.col("few_n"), F.col("few_bytes")).alias("few"), needed(F.col("most_n"), F.col("most_bytes")).alias("most"))
    dealt = named.join(blocks, "family")
    place = F.when(rest, F.pmod(F.xxhash64("_rid"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("_rid"), F.greatest("most", F.lit(1))))
    dealt = dealt.withColumn("block", place.cast("int"))
    with_all = F.sequence(F.lit(0), (F.col("few") + F.col("most") - 1).cast("int"))
    with_few = F.sequence(F.lit(0), (F.col("few") - 1).cast("int"))
    each = dealt.withColumn("other", F.explode(F.when(F.col("block") < F.col("few"), with_all).otherwise(with_few)))
    return each.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "family", "block", "root", "_rid")


def similar_links(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """texts: _rid, text. Links a, b between rows whose shingle sets are at least so similar, which
    join rows as all such links between rows that meet under a key would. The same rows are joined
    whatever the layout of the table."""
    spark = texts.sparkSession
    texts = texts.select("_rid", text_or_empty().alias("text"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = written(texts.mapInArrow(_fingerprinted, WIDE), "similar-fps")
    labelled = wide.withColumn("label", F.col("_rid"))
    met: list[DataFrame] = []
    for t in range(0, SLOTS, AT_ONCE):
        keyed = labelled.select("_rid", "label", *FPS).mapInArrow(_keyed(range(t, t + AT_ONCE)), "key long, _rid long, label long, f0 long, f1 long")
        keyed = keyed.repartition(n, "key").sortWithinPartitions("key", "f0", "f1", "_rid")
        met.append(written(keyed.mapInArrow(_met, "a long, b long").distinct(), "similar-met"))
        del keyed
        free_shuffles(spark)
        if not t:  # most families show in the first slots; later ones give only what joins different ones
            families = _families(met[0])[0].withColumnRenamed("family", "label")
            labelled = written(wide.join(families, "_rid", "left").withColumn("label", F.coalesce("label", "_rid")), "similar-labelled")
    families, stars = _families(reduce(DataFrame.unionByName, met).distinct())
    sets = written(texts.join(families, "_rid").mapInArrow(_shingled, "_rid long, family long, shingles binary"), "similar-sets")
    free_shuffles(spark)
    rows = sets.select("_rid", "family", F.octet_length("shingles").cast("long").alias("bytes"))
    total = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    large = written(total.where((F.col("n") > BLOCK_ROWS) | (F.col("bytes") > 2 * BLOCK_BYTES)).select("family"), "similar-large")
    columns = ["family", "i", "j", "block", "root", "_rid", "shingles", *FPS]

    def compared(dealt: DataFrame) -> DataFrame:
        whole = dealt.join(wide, "_rid").select(*columns).repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j", "_rid")
        return written(whole.mapInArrow(_compared(similar), "a long, b long"), "similar-links")

    once = sets.join(large, "family", "left_anti").withColumn("root", F.col("_rid"))
    links = compared(once.select("family", *[F.lit(0).alias(c) for c in ("i", "j", "block")], "root", "_rid", "shingles"))
    if large.isEmpty():
        return links
    along = stars.join(rows.join(large, "family", "left_semi").select(F.col("_rid").alias("a")), "a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    joined = _joined(along, sets, similar)
    dealt = _in_blocks(rows.join(large, "family", "left_semi"), joined)
    return links.unionByName(joined).unionByName(compared(dealt.join(sets.select("_rid", "shingles"), "_rid")))


def similar_dedup(docs: DataFrame, similar: float = SIMILAR, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with one row of each group of similar texts, its smallest doc_id (null last): all
    columns, unchanged. Columns are found by ``common.places``. Null, empty and blank texts have no
    shingles and all stay, unless ``more`` links them; repeated rows are one group; an empty table
    stays empty. ``more`` gives further links a, b between the same rows (_rid, text), which join
    groups like these."""
    spark = docs.sparkSession
    arrow_limits(spark)
    whole, (doc_id, text) = numbered_columns(docs, "doc_id", "text")
    rows = with_rid(whole, "similar-input")
    texts = rows.select("_rid", F.col(text).alias("text"))
    known = None
    if more:
        with Scratch(spark) as made:
            known = written(more(texts), "similar-known")
        made.clear(known)
    links = similar_links(texts, similar)
    roots = components(links.unionByName(known) if known else links)
    grouped = rows.select("_rid", F.col(doc_id).cast("long").alias("doc_id")).join(roots.withColumnRenamed("v", "_rid"), "_rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid")).alias("first")
    stays = grouped.groupBy("root").agg(first).select(F.col("first._rid").alias("_rid"))
    gone = written(grouped.select("_rid").join(stays, "_rid", "left_anti"), "similar-gone")
    return rows.join(gone, "_rid", "left_anti").drop("_rid").toDF(*docs.columns)
