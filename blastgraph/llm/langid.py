"""Language ID by Bayesian evidence fusion.

For each text and language four kinds of evidence multiply:

* the text: hashed byte trigrams under a smoothed profile of each language, tempered so that a
  long text counts as at most ``EFFECTIVE`` independent trigrams;
* the declared language of the markup (``html lang`` or a content-language header element);
* the address: a country suffix, or a language code as subdomain or first path segment;
* the host: its share of each language, smoothed towards its domain's, that towards its
  suffix's, and that towards the whole corpus's.

How far declarations and addresses can be trusted, and the priors of hosts, domains, suffixes
and the corpus, are soft counts of the text evidence by grouped aggregation over all rows. A
row's own share is taken out of the counts of its host, its domain, its suffix and the corpus, so
a host that is alone in its domain doesn't confirm itself. Profiles come from at most ``SAMPLE`` rows of
``documents`` with a known language, by a hash of doc_id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, pick, text_or_empty, written
from .html_blocks import attributes, blocks

SAMPLE = 4_000
PLACES = 1 << 14
EFFECTIVE = 120
#: Bytes whose trigrams are looked up at once.
BLOCK = 1 << 20
#: Pseudo-counts of the parent level in the priors, of any value in the trust tables, and of the
#: value that names the language itself.
PARENT, TRUST, AGREES = 5.0, 1.0, 9.0
#: Languages of country suffixes.
SUFFIXES = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "uk": "en", "us": "en", "au": "en",
    "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "dk": "da", "ru": "ru", "jp": "ja",
}
DECLARED = re.compile(r"<html\b([^>]*)>", re.I)
META = re.compile(r"<meta\b([^>]*content-language[^>]*)>", re.I)
ADDRESS = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(?::\d+)?(/[^?#]*)?", re.I)


@dataclass
class Profiles:
    languages: tuple[str, ...]
    table: np.ndarray  # PLACES x languages, log-probabilities


def trigrams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(b"  " + raw + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(7919) ^ b[1:-1] * np.uint32(2654435761) ^ b[2:] * np.uint32(40503 * 65537)) >> np.uint32(7)) & np.uint32(PLACES - 1)


def _pieces(raw: bytes):
    for at in range(0, max(1, len(raw)), BLOCK):
        yield trigrams(raw[at : at + BLOCK])


def _counted(batches):
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            counts = sums.setdefault(lang, np.zeros(PLACES, np.int64))
            for part in _pieces(text.lower().encode()):
                counts += np.bincount(part, minlength=PLACES)
        for lang, counts in sums.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(there)), "place": pa.array(there, pa.int32()), "n": pa.array(counts[there], pa.int64())})


def train(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of at most ``sample`` rows; none gives no language ("und"). Rows without an id,
    a language or a text don't train. Of ids with many rows, those with the smallest hashes count."""
    arrow_limits(docs.sparkSession)
    rows = pick(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang").cast("string")).alias("lang"), text_or_empty().alias("text"))
    known = rows.where("lang is not null and lang <> '' and doc_id is not null")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids: a bounded broadcast.
    texts = known.join(F.broadcast(ids), "doc_id").select("lang", "text")
    if texts.count() > sample:  # ids with many rows, each different one once
        place = F.xxhash64("lang", "text")
        texts = texts.distinct()
        last = texts.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("h")).first().h
        texts = texts.where(place <= last)
    counts = texts.mapInArrow(_counted, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.full((PLACES, len(languages)), 0.5)
    for i, lang in enumerate(languages):
        mine = counts[counts["lang"] == lang]
        table[mine["place"].to_numpy(), i] += mine["n"].to_numpy()
    return Profiles(languages, np.log(table / table.sum(0)).astype(np.float32))


def likelihood(text: str, table: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood of a whole text for each language."""
    total, n = np.zeros(table.shape[1]), 0
    for part in _pieces(text.lower().encode()):
        counts = np.bincount(part, minlength=PLACES)
        total += counts @ table
        n += len(part)
    return total * min(1.0, EFFECTIVE / n) if text.strip() else np.zeros(table.shape[1])


def normalised(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max()) if len(log) else log
    return p / p.sum() if len(p) else p


def declared_language(html: str) -> str:
    """The primary language subtag that the markup declares, or ""."""
    for pattern, name in ((DECLARED, "lang"), (META, "content")):
        if m := pattern.search(html):
            value = attributes(m[1]).get(name, "")
            if tag := re.match(r"[a-zA-Z]{2,3}", value):
                return tag[0].lower()
    return ""


def address_parts(url: str) -> tuple[str, str, str, str]:
    """Host, domain (last two labels), suffix, and the language that the address suggests, or ""."""
    m = ADDRESS.match(url.strip())
    if not m:
        return "", "", "", ""
    host = m[1].lower().strip(".")
    labels = host.split(".")
    suffix = labels[-1]
    path = [p for p in (m[2] or "").lower().split("/") if p][:1]
    codes = [c for c in [*path, labels[0] if len(labels) > 2 else ""] if re.fullmatch(r"[a-z]{2}(?:[-_][a-z]{2})?", c)]
    return host, ".".join(labels[-2:]), suffix, codes[0][:2] if codes else SUFFIXES.get(suffix, "")


ROW = "doc_id long, page_id long, host string, domain string, suffix string, declared string, address string, log array<double>, p array<double>"


def _evidence(profiles: Profiles):
    """Rows (doc_id, page_id, host, url, body) with the evidence of each; body is html where url is not null."""

    def run(batches):
        known = set(profiles.languages)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("host", "domain", "suffix", "declared", "address", "log", "p")}
            for host, url, page, body in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                declared = address = domain = suffix = ""
                if page:
                    declared = declared_language(body)
                    host, domain, suffix, address = address_parts(url)
                    body = " ".join(b.text for b in blocks(body))
                log = likelihood(body, profiles.table)
                out["host"].append(host)
                out["domain"].append(domain)
                out["suffix"].append(suffix)
                out["declared"].append(declared if declared in known else "")
                out["address"].append(address if address in known else "")
                out["log"].append(log.tolist())
                out["p"].append(normalised(log).tolist() if body.strip() else [0.0] * len(log))
            many = pa.list_(pa.float64())
            arrays = [pa.array(v, many if k in ("log", "p") else pa.string()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "page_id", *out])

    return run


def _prior(counts, parent):
    """Counts of each language smoothed towards a parent's shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, s: (c + PARENT * s) / (total + PARENT))


def _sums(rows: DataFrame, n: int, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n)]).alias("counts"))


def fuse(rows: DataFrame, profiles: Profiles) -> DataFrame:
    """rows: doc_id, page_id, host, url, is_page, body. One row each: doc_id, page_id, lang,
    probability, text_lang, declared, address."""
    n, names = len(profiles.languages), F.array(*[F.lit(x) for x in profiles.languages])
    seen = written(rows.select("doc_id", "page_id", "host", "url", "is_page", "body").mapInArrow(_evidence(profiles), ROW), "lang-evidence")
    if not n:
        return seen.select("doc_id", "page_id", F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_lang"), "declared", "address")
    hosts = written(_sums(seen, n, "host", "domain", "suffix"), "lang-hosts")
    flat = hosts.select(F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect()
    corpus = np.array([r.c for r in sorted(flat, key=lambda r: r.i)] or [1.0] * n)
    base = F.array(*[F.lit(float(x)) for x in corpus])

    def level(name: str, *by: str) -> DataFrame:
        parts = [F.sum(F.get("counts", F.lit(i))) for i in range(n)]
        return hosts.groupBy(*by).agg(F.array(*parts).alias(name))

    levels = level("of_domain", "domain", "suffix").join(level("of_suffix", "suffix"), "suffix")
    priors = written(hosts.join(levels, ["domain", "suffix"]).select("host", "domain", "suffix", F.col("counts").alias("of_host"), "of_domain", "of_suffix"), "lang-priors")

    def trust(name: str):
        """log P(value | language) for the known values of a kind of evidence, as a map column."""
        shares = {r[name]: np.array(r["counts"]) for r in _sums(seen.where(F.col(name) != ""), n, name).collect()}
        values = sorted(set(profiles.languages) | set(shares))
        own = np.array([[AGREES * (v == lang) for lang in profiles.languages] for v in values])
        table = np.array([shares.get(v, np.zeros(n)) for v in values]) + TRUST + own
        log = np.log(table / table.sum(0))
        pairs = [x for v, row in zip(values, log) for x in (F.lit(v), F.array(*[F.lit(float(y)) for y in row]))]
        none = F.array(*[F.lit(0.0)] * n)
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), none)

    def plus(a, b):
        return F.zip_with(a, b, lambda x, y: x + y)

    def others(counts):
        """Counts without the row's own share."""
        return F.zip_with(counts, F.col("p"), lambda c, x: F.greatest(c - x, F.lit(0.0)))

    prior = F.transform(others(base), lambda c: (c + 1) / F.lit(float(corpus.sum() + n)))
    for counts in ("of_suffix", "of_domain", "of_host"):
        prior = _prior(others(F.col(counts)), prior)
    joined = seen.join(priors, ["host", "domain", "suffix"])
    log = plus(plus(F.col("log"), trust("declared")), plus(trust("address"), F.transform(prior, lambda x: F.log(x))))
    fused = joined.select("doc_id", "page_id", "declared", "address", "p", log.alias("log"))
    top = F.array_max("log")
    total = F.aggregate(F.transform("log", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return fused.select(
        "doc_id", "page_id", F.get(names, (F.array_position("log", top) - 1).cast("int")).alias("lang"), (1 / total).alias("probability"),
        F.when(F.array_max("p") > 0, F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))).otherwise("und").alias("text_lang"),
        "declared", "address",
    )


def identify(docs: DataFrame, pages: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """One row per document (page_id null) and per page (doc_id null): doc_id, page_id, lang,
    probability, text_lang, declared, address.

    A document's source stands for its host; documents declare nothing. Null and empty texts
    say nothing (text_lang "und", no soft counts) and are decided by the other evidence; ties go to the first language by code. Null and repeated
    ids and repeated rows are rows like any other; other columns are ignored; empty tables give
    an empty result.
    """
    arrow_limits(docs.sparkSession)
    profiles = profiles or train(docs)
    empty, no_id = F.lit(""), F.lit(None).cast("long")
    texts = pick(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), no_id.alias("page_id"), F.concat(F.lit("source:"), F.coalesce(F.col("source").cast("string"), empty)).alias("host"),
        empty.alias("url"), F.lit(False).alias("is_page"), text_or_empty().alias("body"),
    )
    sites = pick(pages, "page_id", "url", "html").select(
        no_id.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), empty.alias("host"), text_or_empty("url").alias("url"),
        F.lit(True).alias("is_page"), text_or_empty("html").alias("body"),
    )
    return fuse(texts.unionByName(sites), profiles)
