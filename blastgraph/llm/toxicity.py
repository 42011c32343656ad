"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps accents, look-alike letters of other scripts and digits inside words to plain
letters. Lexicon entries are words and word beginnings; their weights are log-odds between toxic
and clean training documents, kept where the evidence beats what chance gives among all
candidates. A match inside an exception phrase doesn't count; exceptions are learned, as
neighbours of entries that point to clean documents, and a caller may name more. The sum of a
document's weights, itself and normalised by length, goes through a logistic curve fitted on the
same training documents.

Training reads at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id; the held-out fifth
is never among them. Nothing else is bounded: every word of the sampled texts is a candidate, and
all entries and phrases that pass their tests are kept. Counts are aggregated by Spark; the driver
gets the candidates that lean to toxic documents and one short row per sampled document.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, numbered_columns, pick, text_or_empty, written
from .folding import folded_words

#: Bound of training: labelled rows.
SAMPLE = 20_000
#: Evidence that an entry may lack against the best of all candidates by chance.
BELOW_CHANCE = 6
PREFIXES = (4, 5, 6)
#: Smallest hashes of three words in a row that training documents must share to count as copies.
SKETCHES = 3


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of 5. Null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """weights: entry -> weight, " word " or " beginning"; phrases: words that cancel entries;
    curve: intercept, slope on the sum, slope on the sum by length."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-6.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.phrases:
            entry = folded_words(phrase)
            found.add_word(entry, (len(entry), 0.0))
        found.make_automaton()
        return found


def matches(words: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """Start of each matched word in folded text and its largest weight, exceptions taken out."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if not len(automaton):
        return best
    for end, (length, weight) in automaton.iter(words):
        start = end - length + 1
        if weight == 0.0:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    starts = sorted(best) if spared else []
    done = 0
    for start, end in sorted(spared):  # each match is looked at once, however phrases overlap
        done = max(done, bisect_left(starts, start))
        while done < len(starts) and starts[done] < end:
            del best[starts[done]]
            done += 1
    return best


def features(words: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """log of 1 + the sum of weights, and the same of the sum per hundred words."""
    total = sum(matches(words, automaton).values())
    n = words.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / (n + 20))


def score(words: str, automaton: ahocorasick.Automaton, curve: tuple[float, float, float]) -> float:
    z = curve[0] + sum(b * x for b, x in zip(curve[1:], features(words, automaton)))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def log_likelihood_ratio(t: int, c: int, toxic: int, clean: int) -> float:
    """Dunning's G for presence in t of the toxic and c of the clean documents."""

    def part(k, n, rate):
        return sum(x * math.log(y) for x, y in ((k, rate), (n - k, 1 - rate)) if x)

    both = (t + c) / (toxic + clean)
    return 2 * (part(t, toxic, t / toxic) + part(c, clean, c / clean) - part(t, toxic, both) - part(c, clean, both))


def _sketched(batches):
    """Adds the smallest hashes of three words in a row under ``SKETCHES`` seeds: near copies mostly
    share all of them, texts with a common passage hardly ever."""
    for batch in batches:
        sketch = []
        for text in batch.column(0).to_pylist():
            w = text.split()
            rows = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
            sketch.append([min(xxhash.xxh64_intdigest(x, seed) for x in rows) - (1 << 63) for seed in range(SKETCHES)])
        yield batch.append_column("sketch", pa.array(sketch, pa.list_(pa.int64())))


def _presence(batches):
    """How many toxic and clean documents of a batch have each candidate entry."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2))):
            words = set(folded_words(text).split())
            entries = {f" {w} " for w in words}
            entries |= {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}
            counts[toxic].update(entries)
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array(names, pa.string()),
            "t": pa.array([counts[1][x] for x in names], pa.int64()), "c": pa.array([counts[0][x] for x in names], pa.int64()),
        })


def _neighbours(model: Model):
    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2))):
                words, seen = folded_words(text), set()
                for at in matches(words, automaton):
                    end = words.index(" ", at + 1)
                    before = words.rfind(" ", 0, at) if at else -1
                    after = words.find(" ", end + 1)
                    seen |= {words[before + 1 : end]} if before >= 0 else set()
                    seen |= {words[at + 1 : after]} if after > 0 else set()
                counts[toxic].update(seen)
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array(names, pa.string()),
                "t": pa.array([counts[1][x] for x in names], pa.int64()), "c": pa.array([counts[0][x] for x in names], pa.int64()),
            })

    return run


def _featured(model: Model):
    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            found = [features(folded_words(x), automaton) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column(1),
                "total": pa.array([x[0] for x in found], pa.float64()), "rate": pa.array([x[1] for x in found], pa.float64()),
            })

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a small ridge; slopes below zero are set to zero."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    if (b[1:] < 0).any():
        keep = b[1:] > 0
        part = logistic(x[:, 1:][:, keep], y, ridge) if keep.any() else (float(b[0]),)
        slopes = iter(part[1:])
        return (part[0], *(next(slopes) if k else 0.0 for k in keep))
    return tuple(float(v) for v in b)


def _lexicon(counted: list, toxic: int, clean: int, candidates: int) -> dict[str, float]:
    bar, chosen = 2 * math.log(max(2, candidates)) - BELOW_CHANCE, {}
    for row in sorted(counted, key=lambda r: (len(r.entry.rstrip(" ")), len(r.entry), r.entry)):
        weight = math.log((row.t + 0.5) / (toxic + 1)) - math.log((row.c + 0.5) / (clean + 1))
        if weight < 1.5 or log_likelihood_ratio(row.t, row.c, toxic, clean) < bar:
            continue
        word = row.entry.strip()
        shorter = [chosen[k] for n in PREFIXES if n <= len(word) and (k := f" {word[:n]}") in chosen and k != row.entry]
        if not shorter or weight > max(shorter) + 1:
            chosen[row.entry] = weight
    return chosen


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Model:
    """The model from at most ``sample`` labelled training rows. Labels without an id or a value are
    left out; of repeated ones for an id toxic stands; every row of ``docs`` with a chosen id counts,
    copies once, up to ``sample`` rows with the smallest hashes of their texts. Without toxic or without clean rows the lexicon is empty and every score the same."""
    arrow_limits(docs.sparkSession)
    known = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # At most ``sample`` short rows: a bounded broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # Copies of one document would count as evidence each; one of them stays.
    sketched = rows.mapInArrow(_sketched, "text string, toxic int, sketch array<long>")
    single = sketched.groupBy("sketch", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(single.select("text", "toxic"), "toxic-sample")
    if rows.count() > sample:  # ids with many texts
        place = F.xxhash64("text")
        last = rows.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("h")).first().h
        rows = written(rows.where(place <= last), "toxic-sample")
    classes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    if not toxic or not clean:
        return Model(curve=(30.0 if toxic else -30.0, 0.0, 0.0))
    totals = rows.mapInArrow(_presence, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    totals = written(totals, "toxic-entries")
    likely = totals.where(F.col("t") >= 3).where(F.col("t") * F.lit(clean) > 4 * F.col("c") * F.lit(toxic))
    model = Model(_lexicon(likely.collect(), toxic, clean, totals.count()), tuple(exceptions))
    near = rows.mapInArrow(_neighbours(model), "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    mild = near.where(F.col("c") >= 5).where(F.col("c") * F.lit(toxic) > 20 * F.col("t") * F.lit(clean))
    model.phrases = (*exceptions, *sorted(r.entry.strip() for r in mild.select("entry").collect()))
    seen = rows.mapInArrow(_featured(model), "toxic int, total double, rate double").toPandas()
    seen = seen.sort_values(list(seen.columns))
    model.curve = logistic(seen[["total", "rate"]].to_numpy(), seen["toxic"].to_numpy(float))
    return model


def _scored(model: Model):
    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            scores = [score(folded_words(x), automaton, model.curve) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Null texts score as empty ones; null and repeated ids and repeated rows are rows like any
    other; other columns are ignored; an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    scored = texts.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model predicts toxic: all columns, unchanged. Columns are
    found, and null, empty and repeated rows scored, as in ``score_documents``; an empty table stays
    empty."""
    arrow_limits(docs.sparkSession)
    whole, (text,) = numbered_columns(docs, "text")
    staged = whole.select(text_or_empty(text).alias("text"), *whole.columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields)
    kept = staged.mapInArrow(_scored(model), f"{kinds}, score double").where("score < 0.5")
    return kept.drop("score").toDF(*docs.columns)
