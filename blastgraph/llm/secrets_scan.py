"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text by the base patterns. Their values are hashed and
counted over the corpus by distinct repositories and owners. A value that several owners hold is
a copied example; one that a single owner holds and that looks random is a live-looking
credential and adds a span of kind ``live``. Base spans always stay.

The repository of a document is its ``source``; the owner is what stands before the first "/" of
it, all of it where there is none. Counts are partial-then-final aggregates over (value, owner,
repository), so a value that a third of all documents hold shuffles a row per task; candidates
join their counts from tables, where adaptive skew handling splits a hot value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, pick, text_or_empty, written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(
    "({})".format("|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
#: Owners from which on a value counts as a copied example; entropy in bits per character and
#: kinds of characters from which on it looks like a credential.
COPIED_OWNERS = 2
LIVE_ENTROPY, LIVE_CLASSES = 2.8, 2
ROW = "_rid long, doc_id long, source string, found array<struct<kind:int,start:int,stop:int,value:long,random:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind: code points, end exclusive; leftmost and
    non-overlapping for each kind, short matches dropped after matching."""
    found = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((0, m.start(), m.end(), m[2]))
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def looks_random(value: str) -> bool:
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit))
    return entropy >= LIVE_ENTROPY and classes >= LIVE_CLASSES


def _scanned(batches):
    for batch in batches:
        rid, doc_id, source, texts = batch.columns
        found = []
        for text in texts.to_pylist():
            found.append([
                {"kind": k, "start": a, "stop": b, "value": xxhash.xxh64_intdigest(v) - (1 << 63), "random": looks_random(v)}
                for k, a, b, v in base_spans(text)
            ])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([rid, doc_id, source, pa.array(found, kind)], ["_rid", "doc_id", "source", "found"])


def _joined(spans):
    """kind:start:end of an array of spans, by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners of every candidate value."""
    owner = F.substring_index(F.coalesce("source", F.lit("")), "/", 1)
    held = found.select(F.explode("found.value").alias("value"), owner.alias("owner"), F.coalesce("source", F.lit("")).alias("repo"))
    by_repo = held.distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_repo.groupBy("value").agg(F.sum("repos").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Null texts count as empty, null sources as one source; null and repeated ids and repeated
    rows are rows like any other; other columns are ignored; an empty table gives an empty
    result. n_copied: base spans whose value several owners hold.
    """
    arrow_limits(docs.sparkSession)
    rows = pick(docs, "doc_id", "source", "text").select(
        F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text")
    )
    found = written(rows.mapInArrow(_scanned, ROW), "secret-spans")
    counts = written(ownership(found), "secret-owners")
    spans = found.select("_rid", F.posexplode("found").alias("at", "s")).select("_rid", "at", F.col("s.value").alias("value"))
    flags = spans.join(counts, "value").where(F.col("owners") >= COPIED_OWNERS).select("_rid", "at")
    # At most a document's own spans come together here.
    copied = written(flags, "secret-copied").groupBy("_rid").agg(F.collect_set("at").alias("copied"))
    whole = found.join(copied, "_rid", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<int>")))
    live = F.filter(F.transform("found", lambda s, i: F.struct(F.lit(3).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), (s["random"] & ~F.array_contains("copied", i)).alias("is"))), lambda s: s["is"])
    live = F.transform(live, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    def count(kind: int):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return whole.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, live)).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.size("copied").cast("long").alias("n_copied"),
    )


def digest(spans: list[tuple[int, int, int, str]]) -> str:
    """base_sha256 of a document's base spans, as the contract writes it."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest()
