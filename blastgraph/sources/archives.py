"""Advisory archives: ZIP files of JSON documents, or folders of such documents.

One task reads an archive's central directory, a row for each member; ranges of ``BLOCK`` bytes of the archive
are then dealt to tasks, which read and inflate their members alone. Tasks open archives by themselves, where
the store is one that they know; else an archive comes whole to one task.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import partitions

#: Bytes of an archive whose members one task reads together, and bytes of documents handed on at once.
BLOCK, AT_ONCE = 16 << 20, 8 << 20


def _open(path: str):
    """A file that can be read at any place."""
    if local := re.match(r"file:/*(/.*)", path):
        return fs.LocalFileSystem().open_input_file(local[1])
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _opens(path: str) -> bool:
    try:
        _open(path).close()
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def _listed(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [m for m in archive.infolist() if not m.is_dir() and m.filename.endswith(".json")]


def _directory(batches):
    """path: the members of each archive and where they lie."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as file, zipfile.ZipFile(file) as archive:
                members = _listed(archive)
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path] * len(members), pa.string()), "name": pa.array([m.filename for m in members], pa.string()), "at": pa.array([m.header_offset for m in members], pa.int64()),
                "size": pa.array([m.compress_size for m in members], pa.int64()), "method": pa.array([m.compress_type for m in members], pa.int32()),
            })


def _member(file, at: int, size: int, method: int) -> bytes:
    """A member's bytes, by its local header, whose names may be of other lengths than the directory's."""
    file.seek(at)
    head = file.read(30)
    file.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = file.read(size)
    if method == zipfile.ZIP_STORED:
        return raw
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -zlib.MAX_WBITS)
    raise zipfile.BadZipFile(f"compression {method} isn't supported")


def _handed_on(documents):
    names, values, held = [], [], 0
    for name, content in documents:
        names.append(name)
        values.append(content.decode("utf-8", "replace"))
        held += len(content)
        if held > AT_ONCE:
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "value": pa.array(values, pa.string())})
            names, values, held = [], [], 0
    yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "value": pa.array(values, pa.string())})


def _read(batches):
    """Members in order of their archive: each archive is opened once."""

    def documents():
        file, opened = None, None
        for batch in batches:
            for path, name, at, size, method in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "at", "size", "method"))):
                if path != opened:
                    if file:
                        file.close()
                    file, opened = _open(path), path
                yield f"{path}!{name}", _member(file, at, size, method)
        if file:
            file.close()

    yield from _handed_on(documents())


def _whole(batches):
    """Archives as bytes: all members."""

    def documents():
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for m in _listed(archive):
                        yield f"{path}!{m.filename}", archive.read(m)

    yield from _handed_on(documents())


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """name, value of each JSON document: the members of the ZIP files of a path (a file, a folder or
    a pattern), or JSON files themselves. What isn't JSON stays a row, so it can be counted."""
    files = spark.read.format("binaryFile").load(path)
    texts = files.where(F.col("path").endswith(".json")).select(F.col("path").alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("value"))
    zips = files.where(F.col("path").endswith(".zip"))
    first = zips.select("path").first()
    if first is None:
        return texts
    if not _opens(first.path):
        return texts.unionByName(zips.select("path", "content").mapInArrow(_whole, "name string, value string").repartition(partitions(spark)))
    members = zips.select("path").mapInArrow(_directory, "path string, name string, at long, size long, method int")
    dealt = members.withColumn("block", F.floor(F.col("at") / block)).repartition(partitions(spark), "path", "block").sortWithinPartitions("path", "at")
    return texts.unionByName(dealt.mapInArrow(_read, "name string, value string"))
