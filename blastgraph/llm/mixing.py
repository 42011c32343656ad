"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions only.

Every source queues its documents in a hashed order, up to ``MAX_REPEAT`` times over. A copy's
virtual finish time is the cumulative size of its source divided by the source's target, so all
sources reach their targets at time 1 together. A copy that straddles its source's target is queued
in two parts, the first of which finishes at time 1, so that a source's taken words miss its target
by less than a word however long its documents are. The mix is the prefix of the global order by
finish time that fits the total budget.

Scale: cumulative sizes are two-level prefix sums over hash ranges of each source, about as many as a
range has rows, so a hot source spreads over many windows; the global order is cut by range
partitioning: sizes are summed per range of finish time, the range that crosses the budget is
divided again, and only a small last range is sorted. Sources are ranked in ranges too. The driver
holds a few scalars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WHITE, numbered_columns, pick, text_or_empty, with_rid, written

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Bits of a document's place in its source's queue.
PLACE_BITS = 60
#: Finish-time ranges per pass; a crossing range of at most so many parts is sorted as it is.
CUT_RANGES, SORTED_AT_ONCE = 1024, 4096
SEED = 20240229


def _sized(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, skey, source, size, h: h is the shuffled place of a document in its source's queue."""
    doc_id = F.col("doc_id").cast("long")
    content = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_or_empty())
    return docs.select(
        "_rid",
        doc_id.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("source").cast("string"))).alias("skey"),
        F.regexp_count(text_or_empty(), F.lit(NOT_WHITE)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(content.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long").alias("h"),
    )


def _ranked(sums: DataFrame) -> DataFrame:
    """Adds rank from 0, by source in code point order, null last: ranges of sources, then places in them."""
    order = (F.col("source").isNull(), F.col("source"))
    ranges = sums.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranges.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    first = parts.select("part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(first, "part").withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def source_targets(sized: DataFrame) -> DataFrame:
    """skey, rank, source_size, target. Sources rank by code point, null last, and weigh
    1, 2, 3, repeating. ``target = min(level * weight, MAX_REPEAT * size)``; the level is raised
    until the targets use the whole budget, or every source is at its limit."""
    sums = _ranked(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size")))
    sums = written(sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))), "mix-weights")
    level, top = 0.0, F.col("source_size") * MAX_REPEAT
    while True:
        capped = F.col("weight") * F.lit(level) >= top
        row = sums.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, top)).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weights"),
        ).first()
        if not row.weights:
            break
        raised = ((row.total or 0) - (row.used or 0)) / row.weights
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(float(level)), top.cast("double")).cast("double")
    return sums.select("skey", "rank", "source_size", target.alias("target"))


def _queued(sized: DataFrame) -> DataFrame:
    """Each document with the cumulative size of its source up to and with it."""
    bits = math.ceil(math.log2(max(1, sized.count())) / 2)
    ranged = sized.withColumn("r", F.shiftright("h", PLACE_BITS - bits))
    sums = ranged.groupBy("skey", "r").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("skey").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    base = written(base.join(source_targets(sized), "skey").drop("in_range"), "mix-ranges")
    inside = Window.partitionBy("skey", "r").orderBy("h", "doc_id", "size", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    queued = ranged.withColumn("inside", F.sum("size").over(inside)).join(base, ["skey", "r"])
    return queued.select("_rid", "doc_id", "size", "h", "rank", "source_size", "target", (F.col("base") + F.col("inside")).alias("cum"))


def _parts() -> list[tuple[Column, Column]]:
    """Words and virtual finish time of each part of a document: for each copy what lies before
    its source's target, and what lies behind."""
    out = []
    limit = F.floor("target")
    for copy in range(MAX_REPEAT):
        end = F.col("cum") + copy * F.col("source_size")
        behind = F.least(F.greatest(end - limit, F.lit(0)), F.col("size"))
        for words, at in ((F.col("size") - behind, F.least(end, limit)), (behind, end)):
            out.append((words, F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(0.0))))
    return out


def _first_left_out(parts: DataFrame, budget: int):
    """The place (vt, rank, h, part, _rid) of the first part that no longer fits, or None."""
    whole = parts.agg(F.min("vt").alias("lo"), F.max("vt").alias("hi"), F.sum("words").alias("all")).first()
    if whole["all"] is None or whole["all"] <= budget:
        return None
    lo, hi, before = whole.lo, whole.hi, 0
    while True:
        near = parts.where(F.col("vt").between(F.lit(lo), F.lit(hi)))
        step = (hi - lo) / CUT_RANGES
        if step <= 0 or lo + step == lo:
            break
        k = F.least(F.floor((F.col("vt") - F.lit(lo)) / F.lit(step)), F.lit(CUT_RANGES - 1)).alias("k")
        ranges = near.groupBy(k).agg(
            F.sum("words").alias("s"), F.count(F.lit(1)).alias("n"), F.min("vt").alias("lo"), F.max("vt").alias("hi")
        )
        running = F.sum("s").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        crossing = ranges.withColumn("run", running).where(F.col("run") > F.lit(budget - before)).orderBy("k").first()
        before += crossing.run - crossing.s
        same = (crossing.lo, crossing.hi) == (lo, hi)
        lo, hi = crossing.lo, crossing.hi
        if crossing.n <= SORTED_AT_ONCE or same:
            break
    order = ["vt", "rank", "h", "part", "_rid"]
    running = F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = parts.where(F.col("vt").between(F.lit(lo), F.lit(hi)))
    return near.withColumn("run", running).where(F.col("run") > F.lit(budget - before)).orderBy("run").select(*order).first()


def _taken(sized: DataFrame) -> DataFrame:
    queued = written(_queued(sized), "mix-queued")
    made = _parts()
    each = F.array(*[F.struct(F.lit(i).alias("part"), words.alias("words"), vt.alias("vt")) for i, (words, vt) in enumerate(made)])
    parts = queued.select("_rid", "h", "rank", F.explode(F.filter(each, lambda p: p["words"] > 0)).alias("p")).select("_rid", "h", "rank", "p.*")
    budget = queued.agg(F.sum("size").alias("s")).first().s or 0
    cut = _first_left_out(parts, budget)

    def fits(i: int) -> Column:
        if cut is None:
            return F.lit(1)
        here = F.struct(made[i][1].alias("vt"), F.col("rank"), F.col("h"), F.lit(i).alias("part"), F.col("_rid"))
        there = F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in (("vt", "double"), ("rank", "bigint"), ("h", "bigint"), ("part", "int"), ("_rid", "bigint"))])
        return (here < there).cast("int")

    taken = sum((fits(i) * made[i][0] for i in range(1, len(made))), fits(0) * made[0][0]).cast("long")
    return queued.select(
        "_rid", "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.when(F.col("size") > 0, F.floor((2 * taken + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("long").alias("copies"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    size: words of the text (null text: 0). A source's target is its share of all words by
    weight, at most ``MAX_REPEAT`` times its words. taken: the document's words in the mix, in part
    where it straddles its source's target; copies: the same in whole documents, rounded.
    A null source is a source of its own; a document without words is never taken; null and
    repeated ids are rows like any other; other columns are ignored; an empty table gives an empty
    result. Reruns agree.
    """
    rows = pick(docs, "doc_id", "text", "source").withColumn("_rid", F.monotonically_increasing_id())
    return _taken(written(_sized(rows), "mix-sized")).drop("_rid")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix in whole documents: the columns of ``docs``, each row ``copies`` times. Columns are
    found as ``mix`` finds them and null, empty and repeated rows count as there."""
    plain, named = numbered_columns(docs, "doc_id", "text", "source")
    whole = with_rid(plain, "mix-input")
    rows = whole.select("_rid", *[F.col(c).alias(n) for c, n in zip(named, ("doc_id", "text", "source"))])
    takes = _taken(written(_sized(rows), "mix-sized")).where("copies > 0").select("_rid", "copies")
    taken = whole.join(takes, "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.drop("_rid", "copies", "_copy").toDF(*docs.columns)


#: The same mix in DuckDB's SQL, by one global sort.
ORACLE_SQL = rf"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {PLACE_BITS // 4}) AS BIGINT) AS h
        FROM documents
    ), sums AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source
    ), weighed AS (
        SELECT *, [{", ".join(map(str, WEIGHTS))}][rank % {len(WEIGHTS)} + 1] AS weight, {MAX_REPEAT} * source_size AS top FROM sums
    ), levels AS (
        SELECT (SELECT sum(source_size) FROM weighed) - coalesce(sum(top) OVER before, 0) AS left_over, sum(weight) OVER behind AS weights, top / weight AS next
        FROM weighed WINDOW before AS (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), behind AS (ORDER BY top / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), level AS (
        SELECT coalesce(max(CAST(left_over AS DOUBLE) / weights) FILTER (CAST(left_over AS DOUBLE) / weights <= next), 0) AS level FROM levels
    ), queued AS (
        SELECT d.doc_id, d.size, d.h, w.rank, w.source_size, least(w.weight * level, CAST(w.top AS DOUBLE)) AS target,
            CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, row_number() OVER () AS rid
        FROM d JOIN weighed w ON d.source IS NOT DISTINCT FROM w.source, level
    ), copies AS (
        SELECT *, i AS copy, cum + i * source_size AS last, least(greatest(last - CAST(floor(target) AS BIGINT), 0), size) AS behind
        FROM queued, (SELECT unnest(range({MAX_REPEAT})) AS i)
    ), parts AS (
        SELECT rid, rank, h, 2 * copy AS part, size - behind AS words, least(last, CAST(floor(target) AS BIGINT)) / target AS vt FROM copies WHERE size > behind
        UNION ALL SELECT rid, rank, h, 2 * copy + 1, behind, last / target FROM copies WHERE behind > 0
    ), fitting AS (
        SELECT rid, words FROM parts QUALIFY sum(words) OVER (ORDER BY vt, rank, h, part, rid ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM d)
    ), takes AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken FROM fitting GROUP BY rid)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken,
        CASE WHEN size > 0 THEN (2 * coalesce(taken, 0) + size) // (2 * size) ELSE 0 END AS copies
    FROM queued LEFT JOIN takes USING (rid)"""
