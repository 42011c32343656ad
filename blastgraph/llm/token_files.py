"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A shard is a run of documents in ascending id. Its file is

* zstandard frames of ``FRAME_TOKENS`` ids each (the last may be shorter), each decodable alone;
* a skippable frame with the document index: ids and token counts, zstandard-compressed;
* a skippable frame in the public "seekable format" of zstandard: per frame its compressed and
  decompressed size and the low 32 bits of the XXH64 of its content, then the number of
  frames, a descriptor byte and the magic number.

A reader takes the last bytes of a file, then the index, and then only the frames that hold the
requested documents, each checked against its checksum. Ids are stored with two bytes where all of
the vocabulary's fit, else four. Files are written through ``pyarrow.fs``, which reads the
scheme of the shared folder's address. A task writes under a name of its own; the manifest that
Spark commits names the files that count, so a lost or repeated task leaves no half shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, dropped, pick, scratch_path, text_or_empty, written
from .tokens import END_ID, encode, vocabulary_path, vocabulary_size

#: Magic numbers of zstandard's skippable frames and of its seekable format.
INDEX_MAGIC, SEEK_FRAME_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FRAME_TOKENS = 1 << 17
#: About so many tokens go to a shard.
SHARD_TOKENS = 32 << 20
LEVEL = 3


def id_width(path: str) -> int:
    """Bytes of a stored id: two where every id of the vocabulary and the end id fit, else four."""
    return 2 if max(vocabulary_size(path) - 1, END_ID) < 1 << 16 else 4


def narrowed(ids: np.ndarray, width: int) -> bytes:
    """Ids as unsigned integers of ``width`` bytes; an id that doesn't fit is an error, never cut."""
    if len(ids) and int(ids.max()) >> 8 * width:
        raise OverflowError(f"id {int(ids.max())} doesn't fit into {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def open_store(uri: str):
    """Filesystem and path of an address: file:, hdfs:, s3: and what else pyarrow reads."""
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; memory is one frame and the index."""

    def __init__(self, uri: str, width: int, frame_tokens: int = FRAME_TOKENS):
        fs, path = open_store(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.type, self.frame_bytes = np.dtype(f"<u{width}"), frame_tokens * width
        self.pending, self.frames = bytearray(), []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.pack = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.pending += narrowed(ids, self.type.itemsize)
        whole = len(self.pending) // self.frame_bytes * self.frame_bytes
        for at in range(0, whole, self.frame_bytes):
            self._frame(bytes(self.pending[at : at + self.frame_bytes]))
        del self.pending[:whole]

    def _frame(self, content: bytes) -> None:
        packed = self.pack.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> int:
        """Ends the file; returns its number of tokens."""
        if self.pending:
            self._frame(bytes(self.pending))
        null = np.packbits(np.array([i is None for i in self.ids], bool)).tobytes()
        doc_ids = np.array([i or 0 for i in self.ids], "<i8").tobytes()
        index = self.pack.compress(struct.pack("<QBQ", len(self.ids), self.type.itemsize, self.frame_bytes) + null + doc_ids + np.array(self.counts, "<u8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(table)) + table)
        self.out.close()
        return sum(self.counts)


class ShardReader:
    """Reads documents of one shard; only the frames that hold them are read and decompressed."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).tolist()
        at, length = self.starts[n - 1], self.frames[n - 1][0]
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(self._at(at + 8, length - 8))
        docs, width, self.frame_bytes = struct.unpack_from("<QBQ", index)
        pos, nulls = 17, -(-docs // 8)
        null = np.unpackbits(np.frombuffer(index, np.uint8, nulls, pos))[:docs].astype(bool)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, np.frombuffer(index, "<i8", docs, pos + nulls))]
        self.counts = np.frombuffer(index, "<u8", docs, pos + nulls + 8 * docs).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.type = np.dtype(f"<u{width}")
        self.last = (-1, b"")

    def _at(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, size, check = self.frames[k]
            content = self.unpack.decompress(self._at(self.starts[k], packed), max_output_size=size)
            if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.last = (k, content)
        return self.last[1]

    def tokens(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the index."""
        start, end = (int(self.firsts[place + i]) * self.type.itemsize for i in (0, 1))
        parts, at = [], start
        while at < end:
            k = at // self.frame_bytes
            content = self.frame(k)[at - k * self.frame_bytes : end - k * self.frame_bytes]
            parts.append(content)
            at += len(content)
        return np.frombuffer(b"".join(parts), self.type)

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id; ids ascend, null last."""
        ids = [i for i in self.doc_ids if i is not None]
        end = bisect_right(ids, doc_id)
        out = []
        while end and ids[end - 1] == doc_id:
            end -= 1
            out.insert(0, end)
        return out


def _encoded(path: str, width: int):
    def run(batches):
        for batch in batches:
            ids = [encode(x, path, END_ID) for x in batch.column(2).to_pylist()]
            crc = [zlib.crc32(x) for x in ids]
            packed = [narrowed(np.frombuffer(x, "<u4"), width) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(packed, pa.binary())],
                ["_rid", "doc_id", "n_tokens", "crc", "ids"],
            )

    return run


def _shards(folder: str, width: int):
    def run(batches):
        writer = uri = shard = None
        docs = 0
        for batch in batches:
            for doc_id, place, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if writer is None:
                    shard, uri = place, f"{folder}/shard-{place:08d}-{uuid.uuid4().hex}.tokens.zst"
                    writer = ShardWriter(uri, width)
                writer.add(doc_id, np.frombuffer(ids, f"<u{width}"))
                docs += 1
        if writer is not None:
            tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes the documents and writes the shards; returns the manifest: shard, uri, docs, tokens, start."""
    spark = docs.sparkSession
    arrow_limits(spark)
    path, folder = path or vocabulary_path(), folder or scratch_path(spark, "token-files")
    width = id_width(path)
    texts = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    encoded = written(texts.mapInArrow(_encoded(path, width), "_rid long, doc_id long, n_tokens long, crc long, ids binary"), "token-ids")
    total = encoded.agg(F.sum("n_tokens").alias("n")).first().n or 0
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, -(-total // shard_tokens), min(cores, -(-total // (shard_tokens // 16))))
    # The row's own number divides ranges of rows that share an id, or have none.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_tokens"), F.col("crc"), F.col("_rid")]
    ranged = encoded.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ranged = ranged.select("doc_id", F.spark_partition_id().cast("long").alias("place"), "ids")
    manifest = written(ranged.mapInArrow(_shards(folder, width), "shard long, uri string, docs long, tokens long"), "token-manifest")
    dropped(encoded)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _digests(batches):
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = ShardReader(uri)
            n = len(reader.doc_ids)
            for at in range(0, n, 10_000):
                places = range(at, min(at + 10_000, n))
                crc = [zlib.crc32(reader.tokens(p).astype("<u4").tobytes()) for p in places]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids[at : at + 10_000], pa.int64()),
                    "start": pa.array(reader.firsts[at : at + len(crc)] + start, pa.int64()),
                    "n_tokens": pa.array(reader.counts[at : at + len(crc)], pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; every frame is checked."""
    uris = manifest.select("uri", "start", "shard")
    n = max(1, manifest.count())
    return uris.repartitionByRange(n, "shard").select("uri", "start").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids and reads them back: doc_id, start, n_tokens, ids_crc32.

    Documents lie in ascending doc_id, null ids last; equal ids by token count, then checksum.
    Null and empty texts hold the end id alone; repeated rows stay rows; other columns are
    ignored; an empty table writes no file.
    """
    return read_token_files(write_token_files(docs, folder))
