"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

Equal sets of shingles are one class, named by 96 bits of a digest and its size; only classes are
compared. A class has a bitmap: the parity of its shingles in each of ``4 n`` to ``8 n`` hashed bits.
Differing bits of two bitmaps never outnumber the differing shingles, so the sizes and one bit count
bound the overlap from above; bitmaps of different widths are folded to the smaller one first.
Pairs that pass the bound are settled by intersecting the sorted arrays of 64-bit shingle hashes.

* Which pairs meet is exact: by the prefix filter, two sets that are similar enough share one of their first
  ``n - ceil(s n) + 1`` shingles in any order common to all. The order here puts shingles of rarely
  hit cells of a table of ``CELLS`` counters first; it is counted over all documents, and what many
  documents have in common (lines, passages) comes last and is in few prefixes. A pair is looked at
  only where what is left of both sets from their first common shingle on is enough.
* First, classes that share a minimum hash are each compared with one of them, which joins large
  groups of near copies at linear cost. Prefix keys whose classes are all joined by then are done with.
* The classes of another key are a tile, cut into size bands (a factor of ``100 / s``, so partners are
  in neighbouring bands) and blocks of bounded rows and bytes where it is large; every two blocks that can
  hold partners are compared once. A first round passes bitmaps and keeps the classes that have a
  partner within the bound; only those get their sets in the second, which gives the links that join them.

A shingle's hash mixes the hashes of its words in 64 bits. Texts are read anew where sets are needed, all
names follow from contents, so a lost task costs its own work. Nothing is capped or sampled:
components are those of all links.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, dropped, free_shuffles, numbered_columns, partitions, pick, text_or_empty, with_rid, written
from .components import components
from .simhash import LOWER, distance
from .similar import MIXERS, SHINGLE

#: Percent of the union that the intersection holds at least.
SIMILAR = 80
#: Counters of the table that orders shingles, and counters of a row in which they travel.
CELLS, CHUNK = 1 << 20, 1 << 14
CELL_SHIFT = np.uint64(64 - 20)
#: Minimum hashes of a class.
MINS = 4
#: Rows, and bytes of shingle hashes, of a block of a tile.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
#: Classes whose keys a task remembers to have given, so that copies give none again.
SEEN = 200_000
#: Bytes of a text for which powers are kept, and their odd base.
PIECE, BASE = 1 << 16, MIXERS[3]
#: Rows of a key that are looked at together; those of larger keys all go on.
KEY_ROWS, LAGS = 4096, 16
DESCRIBED = "doc_id long, a long, b long, mins array<long>, bits binary, chunk int, cells binary"


def least_overlap(a, b, similar: int = SIMILAR):
    """Common shingles that sets of sizes a and b need."""
    return -(-similar * (a + b) // (100 + similar))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIXERS[1])
    return h ^ (h >> np.uint64(29))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte; which bytes are no white space; powers of BASE and of its inverse."""
    values = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIXERS[2])))
    powers, back = np.full(PIECE, BASE, np.uint64), np.full(PIECE, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    return values, np.array([b not in b" \t\n\v\f\r" for b in range(256)]), powers, back


def word_hashes(low: bytes) -> np.ndarray:
    """64-bit hash of each word of a whole text, in order: a polynomial over the values of its bytes, read
    off the text's running sums."""
    values, wordly, powers, back = _tables()
    raw = np.frombuffer(low, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    word = np.concatenate([[False], wordly[raw], [False]])
    starts, ends = np.flatnonzero(word[1:] != word[:-1]).reshape(-1, 2).T
    sums = np.zeros(len(raw) + 1, np.uint64)
    for block, at in enumerate(range(0, len(raw), PIECE)):
        part = values[raw[at : at + PIECE]]
        part *= powers[: len(part)]
        part *= np.uint64(pow(BASE, PIECE * block, 1 << 64))
        np.cumsum(part, out=sums[at + 1 : at + 1 + len(part)])
        sums[at + 1 : at + 1 + len(part)] += sums[at]
    far = np.array([pow(BASE, -PIECE * block, 1 << 64) for block in range(len(raw) // PIECE + 1)], np.uint64)
    h = (sums[ends] - sums[starts]) * back[starts % PIECE] * far[starts // PIECE]
    return _mixed(h + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a whole text in UTF-8, in ascending order; fewer words: one for all; none: empty."""
    h = word_hashes(text.translate(LOWER))
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(out) + j]) * np.uint64(MIXERS[0])
        out ^= out >> np.uint64(31)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def named(hashes: np.ndarray) -> tuple[int, int]:
    """A set's name: 64 bits of a digest, and its size before 32 more."""
    x = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (x >> 64) - (1 << 63), len(hashes) << 32 | x & 0xFFFFFFFF


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap in 64-bit words, a power of two of them."""
    width = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (last axis) at a smaller width: what lies on the same bit is added modulo two."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def bound(x: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of a set's overlap with others, from bitmaps of one width and sizes."""
    return (n + sizes - distance(others, x).astype(np.int64).sum(-1)) // 2


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common entries of two sorted arrays of distinct entries."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def _described(words: int):
    """(doc_id, text): each text's class, minimum hashes and bitmap; at the end the task's counters."""

    def run(batches):
        cells = np.zeros(CELLS, np.uint32)
        kinds = {"doc_id": pa.int64(), "a": pa.int64(), "b": pa.int64(), "mins": pa.list_(pa.int64()), "bits": pa.binary(), "chunk": pa.int32(), "cells": pa.binary()}

        def table(rows):
            columns = zip(*rows) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

        for batch in batches:
            out, hit = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingle_set(text, words)
                if not len(own):
                    out.append((doc_id, None, None, None, None, None, None))
                    continue
                a, b = named(own)
                mins = [int((own * np.uint64(m) ^ own >> np.uint64(29)).min().view(np.int64)) for m in MIXERS[:MINS]]
                out.append((doc_id, a, b, mins, signature(own).tobytes(), None, None))
                hit.append(own >> CELL_SHIFT)
            if hit:
                cells += np.bincount(np.concatenate(hit).astype(np.int64), minlength=CELLS).astype(np.uint32)
            yield table(out)
        yield table([(None, None, None, None, None, i // CHUNK, cells[i : i + CHUNK].tobytes()) for i in range(0, CELLS, CHUNK)])

    return run


def _cell_sums(batches):
    """(chunk, cells) in order: sums."""
    chunk, total = None, None
    for batch in batches:
        out = []
        for i, cells in zip(*(c.to_pylist() for c in batch.columns)):
            if i != chunk:
                if total is not None:
                    out.append((chunk, total.tobytes()))
                chunk, total = i, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(cells, np.uint32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([x[0] for x in out], pa.int32()), "cells": pa.array([x[1] for x in out], pa.binary())})
    out = [(chunk, total.tobytes())] if total is not None else []
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([x[0] for x in out], pa.int32()), "cells": pa.array([x[1] for x in out], pa.binary())})


def _cells(found: DataFrame) -> np.ndarray:
    """The counters over all documents: CELLS numbers."""
    parts = found.where("chunk is not null").select("chunk", "cells")
    sums = parts.repartition(partitions(found.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(_cell_sums, "chunk int, cells binary")
    out = np.zeros(CELLS, np.int64)
    for r in sums.collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.int64)
    return out


def prefix(hashes: np.ndarray, cells: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """The shingles of a set of which similar sets have one in common: its first ones in the order of all."""
    length = len(hashes) - -(-similar * len(hashes) // 100) + 1
    return hashes[np.lexsort((hashes, cells[(hashes >> CELL_SHIFT).astype(np.int64)]))[:length]]


def _keyed(cells: np.ndarray, similar: int, words: int):
    """Texts: key, a, b, pos for each shingle of a class's prefix, once for copies that a task meets."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, names, counts = [], [], []
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, words)
                if not len(own) or (name := named(own)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                keys.append(prefix(own, cells, similar))
                names.append(name)
                counts.append(len(keys[-1]))
            a, b = (np.repeat(np.array([x[i] for x in names], np.int64), counts) for i in range(2))
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(pos)], ["key", "a", "b", "pos"])

    return run


def possible(n, pos, m, pos_m, similar: int):
    """Whether sets of sizes n and m >= n can be similar enough if the first shingle they have in common has these places in them."""
    return (100 * n >= similar * m) & (np.minimum(n - pos, m - pos_m) >= least_overlap(n, m, similar))


def _shared(similar: int):
    """(key, a, b, pos) in order of key, b, a: the rows that may have a partner in their key. Keys of many
    rows are not looked into here."""
    names = ["key", "a", "b", "pos"]

    def table(rows):
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), pa.array(rows[:, 3].astype(np.int32))], names)

    def meeting(rows):
        """Of whole keys."""
        n, pos, key = rows[:, 2] >> 32, rows[:, 3], rows[:, 0]
        has = np.zeros(len(rows), bool)
        for lag in range(1, min(LAGS, len(rows) - 1) + 1):
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                break
            if lag == LAGS:  # more rows than are looked at pair by pair
                has |= np.isin(key, key[same])
                break
            ok = same[possible(n[same], pos[same], n[same + lag], pos[same + lag], similar)]
            has[ok] = True
            has[ok + lag] = True
        return rows[has]

    def run(batches):
        held, large = np.zeros((0, 4), np.int64), None  # rows of the last key; a key that is too large to be held
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns]).astype(np.int64)])
            if not len(rows):
                continue
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            rows = rows[first]
            if large is not None:
                more = rows[:, 0] == large
                yield table(rows[more])
                rows = rows[~more]
                if not len(rows):
                    held = rows
                    continue
                large = None
            last = rows[:, 0] == rows[-1, 0]
            yield table(meeting(rows[~last]))
            held = rows[last]
            if len(held) > KEY_ROWS:
                yield table(held)
                large, held = int(held[0, 0]), held[:0]
        yield table(meeting(held))

    return run


class Tile:
    """Classes of a tile, sorted by size: sides (blocks of a pair, or all one), labels and bitmaps."""

    def __init__(self, columns: dict[str, list], similar: int):
        order = np.lexsort((columns["cid"], columns["n"]))
        self.similar, self.order = similar, order
        self.cid, self.n, self.pos, self.side, self.label = (np.array(columns[c], np.int64)[order] for c in ("cid", "n", "pos", "side", "label"))
        self.bits = [np.frombuffer(columns["bits"][i], np.uint64) for i in order]
        self.words = np.array([len(x) for x in self.bits])
        self.by_width = {w: (at, np.stack([self.bits[i] for i in at])) for w in np.unique(self.words).tolist() for at in [np.flatnonzero(self.words == w)]}
        self.pair = len(np.unique(self.side)) > 1

    def partners(self, x: int) -> np.ndarray:
        """Rows before x with another label, on another side if there are two, whose bitmaps and sizes
        leave enough overlap possible."""
        n, out = int(self.n[x]), []
        least = int(np.searchsorted(self.n, -(-self.similar * n // 100)))
        for w, (at, table) in self.by_width.items():
            some = slice(*np.searchsorted(at, (least, x)))
            rows = at[some]
            if not len(rows) or w > self.words[x]:
                continue
            ok = (self.label[rows] != self.label[x]) & possible(self.n[rows], self.pos[rows], n, self.pos[x], self.similar)
            if self.pair:
                ok &= self.side[rows] != self.side[x]
            rows, table = rows[ok], table[some][ok]
            if len(rows):
                fits = bound(folded(self.bits[x], w), table, n, self.n[rows]) >= least_overlap(n, self.n[rows], self.similar)
                out.append(rows[fits])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def flagged(self) -> np.ndarray:
        """Places, in the order given, of the rows that have a partner."""
        hit = np.zeros(len(self.n), bool)
        for x in range(1, len(self.n)):
            found = self.partners(x)
            if len(found):
                hit[x] = True
                hit[found] = True
        return self.order[hit]

    def links(self, sets: list[bytes]) -> list[tuple[int, int]]:
        """Exact links that join the rows as all of them would."""
        arrays, out = [np.frombuffer(sets[i], np.uint64) for i in self.order], []
        for x in range(1, len(self.n)):
            for y in self.partners(x).tolist():
                if self.label[y] != self.label[x] and overlap(arrays[x], arrays[y]) >= least_overlap(int(self.n[x]), int(self.n[y]), self.similar):
                    out.append((int(self.cid[x]), int(self.cid[y])))
                    self.label[self.label == self.label[y]] = self.label[x]
        return out


TILE = ["key", "low", "low_block", "high", "high_block"]
FLAGGED = [pa.int64(), *[pa.int32()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
IN_TILE = ["side", "cid", "n", "pos", "label", "bits"]
TILE_SCHEMA = "key long, low int, low_block int, high int, high_block int"


def _per_tile(work, schema: list[tuple[str, pa.DataType]]):
    """Rows in order of TILE: what ``work`` makes of each tile's rows (a dict of lists)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        tile = None

        def ended():
            if not held:
                return []
            rows = pa.Table.from_batches(held).to_pydict()
            return work(rows) if len(rows["cid"]) > 1 else []

        def table(rows):
            columns = zip(*rows) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema)], [name for name, _ in schema])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(len(TILE))]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            out = []
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (here := tuple(int(c[at]) for c in columns)) != tile:
                    out += ended()
                    tile, held = here, []
                held.append(batch.slice(at, to - at))
            yield table(out)
        yield table(ended())

    return run


def within_bound(p: bytes, q: bytes, n: int, m: int, similar: int) -> bool:
    """Whether two bitmaps and their sets' sizes leave enough overlap possible."""
    x, y = int.from_bytes(p, "little"), int.from_bytes(q, "little")
    wide, narrow = 8 * max(len(p), len(q)), 8 * min(len(p), len(q))
    if len(p) < len(q):
        x, y = y, x
    while wide > narrow:
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return (n + m - (x ^ y).bit_count()) // 2 >= least_overlap(n, m, similar)


def _flagged(similar: int):
    """Rows in order of TILE, n: those with a partner within the bound. Tiles of a few rows are looked
    at together, pair by pair."""
    kept = [*TILE, *IN_TILE]
    whole = _per_tile(lambda rows: [tuple(rows[c][i] for c in kept) for i in Tile(rows, similar).flagged().tolist()], list(zip(kept, FLAGGED)))

    def small(rows: pa.Table) -> pa.Table:
        tile = np.column_stack([rows[c].to_numpy() for c in TILE])
        side, n, pos, label = (rows[c].to_numpy() for c in ("side", "n", "pos", "label"))
        bits, hit = rows["bits"].to_pylist(), np.zeros(len(n), bool)
        sides = np.maximum.reduceat(side, first := np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1])) > 0
        pair = np.repeat(sides, np.diff(np.append(first, len(n))))
        for lag in range(1, min(LAGS, len(n) - 1) + 1):
            at = np.flatnonzero((tile[lag:] == tile[:-lag]).all(1))
            if not len(at):
                break
            to = at + lag
            ok = (label[at] != label[to]) & (~pair[at] | (side[at] != side[to])) & possible(n[at], pos[at], n[to], pos[to], similar)
            for x, y in zip(at[ok].tolist(), to[ok].tolist()):
                if not (hit[x] and hit[y]) and within_bound(bits[x], bits[y], int(n[x]), int(n[y]), similar):
                    hit[x] = hit[y] = True
        return rows.take(np.flatnonzero(hit))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def parted(rows: pa.Table):
            """Small tiles, then the others one by one."""
            if not len(rows):
                return
            tile = np.column_stack([rows[c].to_numpy() for c in TILE])
            starts = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1])
            size = np.diff(np.append(starts, len(rows)))
            few = np.repeat(size <= LAGS, size)
            if few.any():
                yield from small(rows.take(np.flatnonzero(few))).to_batches()
            yield from whole(rows.take(np.flatnonzero(~few)).combine_chunks().to_batches())

        def last_tile(rows: pa.Table) -> int:
            """Where the last tile begins."""
            tile = np.column_stack([rows[c].to_numpy() for c in TILE])
            other = np.flatnonzero((tile != tile[-1]).any(1))
            return int(other[-1]) + 1 if len(other) else 0

        schema = pa.schema(list(zip(kept, FLAGGED)))
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows = pa.Table.from_batches(held)
                cut = last_tile(pa.Table.from_batches([batch]))
                if cut or len(held) > 1 and any(batch.column(i)[0].as_py() != held[-2].column(i)[-1].as_py() for i in range(len(TILE))):
                    cut += len(rows) - batch.num_rows
                    yield from parted(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        yield from parted(pa.Table.from_batches(held, schema=schema if not held else None))

    return run


def _linked(similar: int):
    return _per_tile(lambda rows: Tile(rows, similar).links(rows["hashes"]), [("a", pa.int64()), ("b", pa.int64())])


def _tiles(rows: DataFrame, similar: int) -> DataFrame:
    """rows: key, cid, n, pos, label, of keys with different labels. Each with the tiles it is compared in."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), (8 * F.sum("n")).alias("bytes"))
    whole = (F.col("rows") <= BLOCK_ROWS) & (F.col("bytes") <= 2 * BLOCK_BYTES)
    # Partners' sizes differ by a factor below two bands' width, whatever rounding does to a border.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100.0 / similar)) + 1e-9)).cast("int")
    banded = rows.join(size.select("key", whole.alias("whole")), "key").withColumn("band", F.when(F.col("whole"), F.lit(0)).otherwise(band)).drop("whole")
    per = banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("rows"), (8 * F.sum("n")).alias("bytes"), F.min("n").alias("least"))
    needed = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    # A tile that isn't cut is one block, however many bytes it has.
    per = per.join(size.select("key", whole.alias("whole")), "key").select("key", "band", F.when(F.col("whole"), F.lit(1)).otherwise(needed).cast("int").alias("own"))
    above = per.select("key", (F.col("band") - 1).alias("band"), F.col("own").alias("above"))
    below = per.select("key", (F.col("band") + 1).alias("band"), F.col("own").alias("below"))
    blocks = per.join(above, ["key", "band"], "left").join(below, ["key", "band"], "left").na.fill(0)
    dealt = banded.join(blocks, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("own")).cast("int"))

    def pairs(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<low:int,low_block:int,high:int,high_block:int,side:int>>"))

    def pair(low, low_block, high, high_block, side):
        return F.struct(low.alias("low"), low_block.alias("low_block"), high.alias("high"), high_block.alias("high_block"), side.cast("int").alias("side"))

    here, block = F.col("band"), F.col("block")
    each = F.concat(
        pairs("own", lambda j: pair(here, F.least(block, j), here, F.greatest(block, j), block > j)),
        pairs("above", lambda j: pair(here, block, here + 1, j, F.lit(False))),
        pairs("below", lambda j: pair(here - 1, j, here, block, F.lit(True))),
    )
    return dealt.select("key", "cid", "n", "pos", "label", F.explode(each).alias("t")).select("key", "t.low", "t.low_block", "t.high", "t.high_block", "t.side", "cid", "n", "pos", "label")


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted: cid, a, b, least. cid, hashes of those classes, from texts that bear the ids ``least``."""

    def hashed(batches):
        for batch in batches:
            out, seen = [], set()
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, words)
                if len(own) and (name := named(own)) not in seen:
                    seen.add(name)
                    out.append((*name, own.tobytes()))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["a", "b", "hashes"])

    ids = wanted.select("least").distinct()
    some = texts.join(ids, texts["doc_id"].eqNullSafe(ids["least"]), "left_semi").select("text")
    found = some.mapInArrow(hashed, "a long, b long, hashes binary").join(wanted.select("cid", "a", "b"), ["a", "b"])
    return written(found.groupBy("cid").agg(F.first("hashes").alias("hashes")), "jaccard-sets")


def _within(similar: int):
    """(x, y, n, m, bits, others): the pairs whose bitmaps leave enough overlap possible."""

    def run(batches):
        for batch in batches:
            x, y, n, m, p, q = (c.to_pylist() for c in batch.columns)
            ok = [i for i in range(len(x)) if within_bound(p[i], q[i], n[i], m[i], similar)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), batch.column(1).take(pa.array(ok, pa.int64()))], ["x", "y"])

    return run


def _settled(similar: int):
    def run(batches):
        for batch in batches:
            x, y, p, q = (c.to_pylist() for c in batch.columns)
            out = []
            for i in range(len(x)):
                one, other = np.frombuffer(p[i], np.uint64), np.frombuffer(q[i], np.uint64)
                if overlap(one, other) >= least_overlap(len(one), len(other), similar):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64())), batch.column(1).take(pa.array(out, pa.int64()))], ["a", "b"])

    return run


def _stars(texts: DataFrame, classes: DataFrame, similar: int, words: int) -> DataFrame:
    """Links between classes that share a minimum hash and one of them, drawn by a hash, for each."""
    slots = classes.select("cid", "n", F.posexplode("mins").alias("slot", "least_hash"))
    draw = F.min(F.struct(F.xxhash64("slot", "cid").alias("h"), F.col("cid").alias("x"), F.col("n").alias("n_x"))).alias("first")
    firsts = slots.groupBy("slot", "least_hash").agg(draw, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("slot", "least_hash", "first.x", "first.n_x")
    met = slots.join(firsts, ["slot", "least_hash"]).where("cid <> x")
    met = met.where(100 * F.least("n", "n_x") >= similar * F.greatest("n", "n_x")).select("x", F.col("cid").alias("y")).distinct()
    bits = classes.select("cid", "n", "bits")
    one, other = bits.toDF("x", "n_x", "bits_x"), bits.toDF("y", "n_y", "bits_y")
    both = met.join(one, "x").join(other, "y").select("x", "y", "n_x", "n_y", "bits_x", "bits_y")
    close = written(both.mapInArrow(_within(similar), "x long, y long"), "jaccard-close")
    ends = close.select("x").union(close.select("y")).distinct().withColumnRenamed("x", "cid")
    sets = _sets(texts, classes.join(ends, "cid", "left_semi").select("cid", "a", "b", "least"), words)
    pairs = close.join(sets.toDF("x", "hashes_x"), "x").join(sets.toDF("y", "hashes_y"), "y").select("x", "y", "hashes_x", "hashes_y")
    return written(pairs.mapInArrow(_settled(similar), "a long, b long"), "jaccard-stars")


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    return classes.join(components(links).select(F.col("v").alias("cid"), F.col("root").alias("label")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _meetings(texts: DataFrame, cells: np.ndarray, similar: int, words: int) -> DataFrame:
    """key, a, b, pos of the prefix keys in which possible partners meet."""
    keyed = texts.select("text").mapInArrow(_keyed(cells, similar, words), "key long, a long, b long, pos int")
    laid = keyed.repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key", "b", "a")
    return written(laid.mapInArrow(_shared(similar), "key long, a long, b long, pos int"), "jaccard-met")


def _tile_links(texts: DataFrame, met: DataFrame, classes: DataFrame, bits: DataFrame, similar: int, words: int) -> DataFrame:
    """met: key, a, b, pos; classes: cid, a, b, n, least, label; bits: cid, bits. Links between classes of different labels."""
    n = partitions(texts.sparkSession)
    rows = written(met.join(classes.select("cid", "a", "b", "n", "label"), ["a", "b"]).select("key", "cid", "n", "pos", "label"), "jaccard-meeting")
    dropped(met)
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    tiles = _tiles(written(rows.join(mixed, "key", "left_semi"), "jaccard-mixed"), similar)
    whole = tiles.join(bits, "cid").select(*TILE, *IN_TILE)
    laid = whole.repartition(n, *TILE).sortWithinPartitions(*TILE, "n", "cid")
    flagged = written(laid.mapInArrow(_flagged(similar), f"{TILE_SCHEMA}, side int, cid long, n long, pos int, label long, bits binary"), "jaccard-flagged")
    free_shuffles(texts.sparkSession)
    wanted = classes.join(flagged.select("cid").distinct(), "cid", "left_semi").select("cid", "a", "b", "least")
    sets = _sets(texts, wanted, words)
    again = flagged.join(sets, "cid").select(*TILE, *IN_TILE, "hashes").repartition(n, *TILE).sortWithinPartitions(*TILE)
    return written(again.mapInArrow(_linked(similar), "a long, b long").distinct(), "jaccard-links")


def _joined(docs: DataFrame, similar: int, words: int) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, a, b, component (null without shingles), component_id."""
    spark = docs.sparkSession
    arrow_limits(spark)
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    found = written(texts.mapInArrow(_described(words), DESCRIBED), "jaccard-rows")
    cells = _cells(found)
    rows = found.where("chunk is null")
    grouped = rows.where("a is not null").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.first("mins").alias("mins"), F.first("bits").alias("bits"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "a", "b", F.shiftright("b", 32).alias("n"), "least", "mins", "bits"), "jaccard-classes")
    stars = _stars(texts, classes, similar, words)
    free_shuffles(spark)
    labelled = written(_labelled(classes.drop("mins", "bits"), stars), "jaccard-labelled")
    met = _meetings(texts, cells, similar, words)
    free_shuffles(spark)
    more = _tile_links(texts, met, labelled, classes.select("cid", "bits"), similar, words)
    named_ = written(_labelled(classes.select("cid", "a", "b", "least"), stars.unionByName(more)), "jaccard-named")
    smallest = named_.groupBy("label").agg(F.min("least").alias("component_id"))
    members = written(named_.join(smallest, "label").select("a", "b", F.col("label").alias("component"), "component_id"), "jaccard-members")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(members, ["a", "b"], "left").select(
        "doc_id", F.coalesce(F.shiftright("b", 32), F.lit(0)).cast("long").alias("n_shingles"), "component", own.alias("component_id")
    )


def jaccard_components(docs: DataFrame, similar: int = SIMILAR, words: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id that links of sets at
    least ``similar`` percent alike reach, itself included (null only where all are null).

    Null, empty and blank texts have no shingles and no links. Repeated rows, and rows of one id with
    different texts, are rows; those of equal sets are linked. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _joined(rows, similar, words).drop("component")


def jaccard_dedup(docs: DataFrame, similar: int = SIMILAR, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, its smallest doc_id (null last): all columns, unchanged.
    Rows count as in ``jaccard_components``; those without shingles all stay."""
    whole, (doc_id, text) = numbered_columns(docs, "doc_id", "text")
    rows = with_rid(whole, "jaccard-input")
    # Rows are joined under their unique numbers; the ids decide who stays.
    joined = _joined(rows.select(F.col("_rid").alias("doc_id"), F.col(text).alias("text")), similar, words)
    grouped = joined.where("component is not null").select(F.col("doc_id").alias("_rid"), "component")
    grouped = written(grouped.join(rows.select("_rid", F.col(doc_id).cast("long").alias("id")), "_rid"), "jaccard-grouped")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_rid")).alias("first")
    stays = grouped.groupBy("component").agg(first).select(F.col("first._rid").alias("_rid"))
    gone = grouped.select("_rid").join(stays, "_rid", "left_anti")
    return rows.join(gone, "_rid", "left_anti").drop("_rid").toDF(*docs.columns)


#: The query's rows in DuckDB's SQL, by the shingles themselves.
ORACLE_SQL = rf"""
    WITH RECURSIVE words AS (
        SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {SHINGLE} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) END) AS s FROM words
    ), sizes AS (
        SELECT rid, count(*) AS n FROM shingles GROUP BY rid
    ), links AS (
        SELECT x.rid AS a, y.rid AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.rid <> y.rid JOIN sizes p ON p.rid = x.rid JOIN sizes q ON q.rid = y.rid
        GROUP BY x.rid, y.rid, p.n, q.n HAVING 100 * count(*) >= {SIMILAR} * (p.n + q.n - count(*))
    ), reached AS (
        SELECT rid AS a, rid AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
    )
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id
    FROM words w LEFT JOIN sizes USING (rid) JOIN reached r ON r.a = w.rid JOIN words o ON o.rid = r.b GROUP BY w.rid, w.doc_id, n"""
