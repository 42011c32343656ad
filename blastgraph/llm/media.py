"""Media columns: signature sniffing with Aho-Corasick, validation, correction and carving.

One automaton over all magic byte sequences runs once over a value's bytes. Each hit is a
candidate only: a validator of its format parses headers, chunk or frame chains, checksums and
lengths, and says where the medium ends. The format that starts the value replaces a wrong
declared type; valid media found further in are carved out, outermost first.

``store`` keeps a text losslessly as a medium: its UTF-8 bytes, zero-padded to a positive
multiple of 64, are the 8-bit samples of a WAV file, the pixels of a BMP or of a PNG, 64 to a
row. Which of the three follows from the content, so equal texts give equal media. The declared
type is a column of the table where it has one; what is sniffed replaces it where they differ.

Time is linear in a value's length but for media nested in media of the same kind: what a
validator looks for to the right of a hit is remembered for the hits behind it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, pick, text_or_empty, written

ROW = 64
FORMATS = ("wav", "bmp", "png")
#: Media types, and magic bytes with their place in a file.
TYPES = {
    "wav": "audio/wav", "bmp": "image/bmp", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg",
    "zip": "application/zip", "gzip": "application/gzip", "pdf": "application/pdf", "flac": "audio/flac", "ogg": "audio/ogg",
}
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "png", 0), (b"GIF87a", "gif", 0), (b"GIF89a", "gif", 0), (b"\xff\xd8\xff", "jpeg", 0),
    (b"BM", "bmp", 0), (b"RIFF", "wav", 0), (b"PK\x03\x04", "zip", 0), (b"\x1f\x8b\x08", "gzip", 0),
    (b"%PDF-", "pdf", 0), (b"fLaC", "flac", 0), (b"OggS", "ogg", 0),
)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind, at in MAGIC:
        found.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + at))
    found.make_automaton()
    return found


# Validators: the end of a medium that starts at ``at``, or 0 if its structure or lengths are wrong.


class Value(bytes):
    """Bytes that remember where a needle was found, so that hits from left to right don't each
    look through all that follows them."""

    def next(self, needle: bytes, at: int) -> int:
        """The first place of ``needle`` from ``at`` on, -1 if there is none."""
        known = self.__dict__.setdefault("known", {})
        low, found = known.get(needle, (len(self) + 1, -1))
        if at < low or -1 < found < at:
            found = self.find(needle, at)
            known[needle] = (at, found)
        return found


def _wav(b: bytes, at: int) -> int:
    if at + 44 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, pos)
        if name == b"fmt " and size < 16 or name == b"data" and b"fmt " not in seen:
            return 0
        seen.add(name)
        pos += 8 + size + (size & 1)
    return end if pos == end and b"data" in seen else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if zero or header not in (40, 108, 124) or not 54 <= offset <= size or at + size > len(b):
        return 0
    width, height, planes, bits, packing = struct.unpack_from("<iiHHI", b, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or packing:
        return 0
    return at + size if offset + (width * bits + 31) // 32 * 4 * abs(height) == size else 0


def _png(b: bytes, at: int) -> int:
    pos, first, data = at + 8, True, False
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        stop = pos + 12 + size
        if stop > len(b) or first and (name != b"IHDR" or size != 13):
            return 0
        if zlib.crc32(memoryview(b)[pos + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return 0
        first, data, pos = False, data or name == b"IDAT", stop
        if name == b"IEND":
            return stop if data and not size else 0
    return 0


def _gif(b: bytes, at: int) -> int:
    pos = at + 13
    if pos > len(b):
        return 0
    pos += 3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return 0


def _jpeg(b: Value, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if not 0xC0 <= mark <= 0xFE or size < 2:
            return 0
        pos += 2 + size
        if mark == 0xDA:
            end = b.next(b"\xff\xd9", pos)
            return end + 2 if end >= 0 else 0
    return 0


def _gzip(b: Value, at: int) -> int:
    """Decompressed in steps, of which none is kept."""
    unpack, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b):
            part = b[pos : pos + (1 << 16)]
            pos += len(part)
            while part and not unpack.eof:
                unpack.decompress(part, 1 << 20)
                part = unpack.unconsumed_tail
            if unpack.eof:
                return pos - len(unpack.unused_data)
    except zlib.error:
        pass
    return 0


def _zip(b: Value, at: int) -> int:
    end = b.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    stop = end + 22 + note
    return stop if at + offset + size == end and stop <= len(b) and b[at + offset : at + offset + 4] == b"PK\x01\x02" else 0


def _pdf(b: Value, at: int) -> int:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    end = b.next(b"%%EOF", at)
    return end + 5 if 0 < b.next(b"startxref", at) < end else 0


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ (polynomial if crc & top else 0)) & mask
        out.append(crc)
    return out


#: The check polynomials of FLAC's frame headers and frames.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(b: bytes, pos: int) -> tuple[int, int]:
    """End of a frame's header and the samples in its block; zeros where there is no such header."""
    if pos + 6 > len(b) or b[pos] != 0xFF or b[pos + 1] & 0xFE != 0xF8:
        return 0, 0
    size, rate, first = b[pos + 2] >> 4, b[pos + 2] & 15, b[pos + 4]
    more = 0 if first < 0x80 else next((n for n in range(1, 7) if not first << n & 0x40), 7)
    at = pos + 5 + more
    extra = {6: 1, 7: 2}.get(size, 0)
    end = at + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or rate == 15 or b[pos + 3] & 1 or end >= len(b):
        return 0, 0
    samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8 if size > 7 else int.from_bytes(b[at : at + extra], "big") + 1
    crc = 0
    for x in b[pos:end]:
        crc = CRC8[crc ^ x]
    return (end + 1, samples) if crc == b[end] else (0, 0)


def _flac(b: Value, at: int) -> int:
    """Metadata blocks, then frames one by one: a frame ends where its check sum comes out and
    either the next header or, with all samples there, nothing more of the stream follows."""
    pos, head, total = at + 4, 0, 0
    while not head & 0x80:
        if pos + 4 > len(b):
            return 0
        first = pos == at + 4
        head, size = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (head & 0x7F or size != 34):
            return 0
        if first:
            total = int.from_bytes(b[pos + 17 : pos + 22], "big") & (1 << 36) - 1
        pos += 4 + size
    seen = 0
    while True:
        start, samples = _flac_header(b, pos)
        if not start:
            return 0
        seen += samples
        crc, end, last = 0, 0, 0
        for i in range(pos, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b[i]]
            if not crc and i > start:
                if total and seen >= total or _flac_header(b, i + 1)[0]:
                    end = i + 1
                    break
                last = last or i + 1
        if not end and not total:  # a stream of unknown length ends with its last whole frame
            return last
        if not end or total and seen >= total:
            return end
        pos = end


def _ogg(b: Value, at: int) -> int:
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        segments = b[pos + 26]
        pos += 27 + segments + sum(b[pos + 27 : pos + 27 + segments])
        if pos > len(b):
            return 0
    return pos if pos > at else 0


VALIDATORS = {"wav": _wav, "bmp": _bmp, "png": _png, "gif": _gif, "jpeg": _jpeg, "zip": _zip, "gzip": _gzip, "pdf": _pdf, "flac": _flac, "ogg": _ogg}


@dataclass(frozen=True)
class Medium:
    kind: str
    start: int
    end: int


def sniff(value: bytes, found: ahocorasick.Automaton) -> list[Medium]:
    """The valid media of a value by start. Media inside another are not listed; in a value
    whose own format holds compressed or raw content, what lies within belongs to it."""
    out: list[Medium] = []
    reach, value = 0, Value(value)
    for last, (kind, back) in found.iter(value.decode("latin-1")):
        start = last - back
        if start >= reach and (end := VALIDATORS[kind](value, start)) > start:
            out.append(Medium(kind, start, end))
            reach = end
    return out


def embedded(value: bytes, medium: Medium, found: ahocorasick.Automaton) -> list[Medium]:
    """Valid media that start inside the samples of a medium that ``wrap`` made."""
    if medium.kind not in FORMATS:
        return []
    inner = payload(value[medium.start : medium.end], medium.kind)
    return sniff(inner, found)


def wrap(samples: bytes, kind: str) -> bytes:
    """Samples, a positive multiple of ROW bytes, as a WAV, BMP or PNG file."""
    rows = len(samples) // ROW
    if kind == "wav":
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples))
        return head + samples
    if kind == "bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(samples), 0, 1078, 40, ROW, -rows, 1, 8, 0, len(samples), 2835, 2835, 256, 0)
        return head + grey + samples

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = b"".join(b"\0" + samples[i : i + ROW] for i in range(0, len(samples), ROW))
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return MAGIC[0][0] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def payload(medium: bytes, kind: str) -> bytes:
    """The samples of a medium that ``wrap`` made, read from its own headers."""
    if kind == "wav":
        pos = 12
        while medium[pos : pos + 4] != b"data":
            pos += 8 + struct.unpack_from("<I", medium, pos + 4)[0]
        return medium[pos + 8 : pos + 8 + struct.unpack_from("<I", medium, pos + 4)[0]]
    if kind == "bmp":
        offset = struct.unpack_from("<I", medium, 10)[0]
        return medium[offset:]
    pos, data = 8, []
    while medium[pos + 4 : pos + 8] != b"IEND":
        size = struct.unpack_from(">I", medium, pos)[0]
        if medium[pos + 4 : pos + 8] == b"IDAT":
            data.append(medium[pos + 8 : pos + 8 + size])
        pos += 12 + size
    lines = zlib.decompress(b"".join(data))
    return b"".join(lines[i + 1 : i + 1 + ROW] for i in range(0, len(lines), ROW + 1))


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _stored(batches):
    for batch in batches:
        n, media = [], []
        for text in batch.column(2).to_pylist():
            size, samples = padded(text)
            n.append(size)
            media.append(wrap(samples, FORMATS[zlib.crc32(samples) % 3]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(1), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])


def store(docs: DataFrame, declared: str | None = None) -> DataFrame:
    """doc_id, n_bytes, declared, media: each whole text as a medium, as a table that is read back.
    ``declared`` names the column with the media type that a row claims; without it none does."""
    arrow_limits(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", *([declared] if declared else []))
    claimed = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), claimed.alias("declared"), text_or_empty().alias("text"))
    return written(texts.mapInArrow(_stored, "doc_id long, n_bytes long, declared string, media binary"), "media")


def _sniffed(batches):
    found = automaton()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for declared, value in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            media = sniff(value, found)
            whole = next((m for m in media if m.start == 0), None)
            kind = whole.kind if whole else ""
            samples = payload(value[: whole.end], kind) if kind in FORMATS else b""
            carved = [m for m in media if m.start] + sniff(samples, found)
            actual = TYPES.get(kind, "application/octet-stream")
            mean = sum(samples) / len(samples) if samples else 0.0
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-ROW:]))
            out["media_bytes"].append(len(value))
            out["media_sha256"].append(hashlib.sha256(value).hexdigest())
            places = "+".join(f"{m.kind}@{m.start}-{m.end}" for m in carved)
            claim = "none" if declared is None else "right" if actual == declared else "corrected"
            out["feature"].append(f"type={actual};declared={claim};mean={mean:.3f};carved={places}")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], ["doc_id", "n_bytes", *out])


def media_features(stored: DataFrame) -> DataFrame:
    """Sniffs the stored media and computes features of what is read back; one row per row."""
    arrow_limits(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(
        _sniffed,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def documents_as_media(docs: DataFrame, declared: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. declared: the column of claimed types, if there is one.

    Null texts count as empty (64 zero bytes); null and repeated ids and repeated rows are rows
    like any other; other columns are ignored; an empty table gives an empty result.
    """
    return media_features(store(docs, declared))
