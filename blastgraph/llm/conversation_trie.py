"""Conversation prefix trie: which conversations share their first turns, and what sharing saves.

``rebuilt`` gives each conversation's turns, the first few taken from another one. A turn's node is
the digest of all turns up to it, chained along the conversation, so equal prefixes meet under equal
digests. Copies are counted before anything is grouped: a node is one row, however many conversations
pass it.

Nodes are hash-partitioned by their first turn's digest. Each partition builds pointer tries in
dictionaries and sums them up in iterative postorder (``summed``). A subtrie of more than ``LIMIT``
nodes is dealt again by its next turn, recursively: by the first depth at which it branches, so a
long common chain costs one round, not one per turn. The nodes above a split get their sums from the sums
of their children's subtries, added up in Spark, deepest split first.

The list of the members that end at a node is hashed as a stream over sorted rows: memory is
bounded; SHA-256 itself has to take the ids of one node one after the other.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, partitions, pick, ranked, written
from .importance import CRC_TABLE_SQL, crc_sql

#: Every conversation takes turns of the one whose id is its own rounded down to a multiple of this.
SHARED = 5
#: Turns taken: a hash of the id modulo this.
TAKEN = 9
#: Nodes that one task builds tries of at once.
LIMIT = 100_000
STEPS = "conv_id long, depth long, node binary, parent binary, first binary, bytes long, last boolean"
SUMS = "node binary, n_children long, n_leaves long, saved_tokens long"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text: turns in order, by sorted ranges of the whole table, so a
    conversation of very many turns is in no single task."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    placed = ranked(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), name="trie-turns")
    starts = placed.groupBy("conv_id").agg(F.min("_rank").alias("_start"))
    return placed.join(starts, "conv_id").select("conv_id", (F.col("_rank") - F.col("_start")).alias("at"), "role", "text")


def rebuilt(conversations: DataFrame, shared: int = SHARED, taken: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation; the turns conv_id, at, role, text of the rebuilt ones). A
    conversation c opens with the first h turns of c - c % shared (all if it has fewer, none if it
    is absent), h being a CRC-32 of c modulo ``taken``, and goes on with its own turns after its first h."""
    turns = written(_turns(conversations), "trie-turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % taken
    asked = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % shared).alias("base"), h.alias("h"))
    given = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    asked = asked.join(given, "base", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0))))
    asked = written(asked.select("conv_id", "base", "h", "got"), "trie-asked")
    own = turns.join(asked, "conv_id").where("at >= h").select("conv_id", (F.col("got") + F.col("at") - F.col("h")).alias("at"), "role", "text")
    opening = turns.where(F.col("at") < taken - 1).withColumnRenamed("conv_id", "base")
    taken_over = asked.where("got > 0").join(opening, "base").where("at < h").select("conv_id", "at", "role", "text")
    return asked.select("conv_id"), own.unionByName(taken_over)


def _digest(parent: bytes, role: bytes, text: bytes) -> bytes:
    """A node's name: 128 bits over its parent's name and its turn."""
    return hashlib.blake2b(parent + len(role).to_bytes(8, "big") + role + text, digest_size=16).digest()


ROOT = bytes(16)


def _chained(batches):
    """Turns (conv_id, role, text) in order: each with the names of its node, parent and first turn, and
    whether it is its conversation's last; a row waits for the one behind it."""
    names = ["conv_id", "depth", "node", "parent", "first", "bytes", "last"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    conv, depth, node, first, waiting = None, 0, ROOT, None, None

    def table(rows):
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        out = []
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if waiting:
                out.append((*waiting, c != conv))
            if c != conv:
                conv, depth, node, first = c, 0, ROOT, None
            parent, depth = node, depth + 1
            node = _digest(parent, role, text)
            first = first or node
            waiting = (c, depth, node, parent, first, len(text))
        yield table(out)
    yield table([(*waiting, True)] if waiting else [])


def steps(turns: DataFrame) -> DataFrame:
    """The nodes that each conversation passes, in a table."""
    arrow_limits(turns.sparkSession)
    raw = turns.select("conv_id", "at", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    laid = raw.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return written(laid.select("conv_id", "role", "text").mapInArrow(_chained, STEPS), "trie-steps")


def _ends(batches):
    """(node, conv_id) in order: the SHA-256 of each node's ids."""
    node, digest = None, None
    for batch in batches:
        out = []
        for n, c in zip(*(x.to_pylist() for x in batch.columns)):
            if n != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(b"%d" % c)
            else:
                digest.update(b",%d" % c)
        yield pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in out], pa.binary()), "ends_sha256": pa.array([x[1] for x in out], pa.string())})
    out = [(node, digest.hexdigest())] if node is not None else []
    yield pa.RecordBatch.from_pydict({"node": pa.array([x[0] for x in out], pa.binary()), "ends_sha256": pa.array([x[1] for x in out], pa.string())})


def ends(found: DataFrame, convs: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes at which conversations end; those without turns end at the root."""
    at = found.where("last").select("node", "conv_id")
    turnless = convs.join(found.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id")
    laid = at.unionByName(turnless).repartition(partitions(found.sparkSession), "node").sortWithinPartitions("node", "conv_id")
    return written(laid.mapInArrow(_ends, "node binary, ends_sha256 string"), "trie-ends")


def summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Pointer tries of nodes (node, parent, n_convs, bytes; whole subtries, in any order): for each
    node its children, the childless nodes below or at it, and the bytes that sharing saves below and at it."""
    nodes, parents = frame["node"].tolist(), frame["parent"].tolist()
    place = {n: i for i, n in enumerate(nodes)}
    children: list[list[int]] = [[] for _ in nodes]
    roots = []
    for i, p in enumerate(parents):
        if (above := place.get(p)) is None:
            roots.append(i)
        else:
            children[above].append(i)
    saved = ((frame["n_convs"] - 1) * frame["bytes"]).tolist()
    leaves = [0] * len(nodes)
    stack = [(i, False) for i in roots]
    while stack:
        i, below_done = stack.pop()
        if not below_done:
            stack.append((i, True))
            stack += [(c, False) for c in children[i]]
        elif children[i]:
            leaves[i] = sum(leaves[c] for c in children[i])
            saved[i] += sum(saved[c] for c in children[i])
        else:
            leaves[i] = 1
    return pd.DataFrame({"node": nodes, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved})


def _built(nodes: DataFrame, limit: int) -> DataFrame:
    """nodes: group, node, parent, n_convs, bytes, of groups of at most ``limit`` nodes: their sums. Groups are
    hash-partitioned so that a partition holds about ``limit`` nodes, and several groups mostly."""
    buckets = max(partitions(nodes.sparkSession), 2 * nodes.count() // limit)
    dealt = nodes.select(F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"), "node", "parent", "n_convs", "bytes")
    return written(dealt.groupBy("bucket").applyInPandas(summed, SUMS), "trie-sums")


def _split(large: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """large: group, depth, node, parent, n_convs, bytes, conv_id, of oversized groups. (their nodes above the
    first branching, all of a chain's; the nodes from it on, grouped anew by their ancestor there). A
    group's nodes are single up to the branching; the ancestor is what the node's smallest member passes there."""
    widths = large.groupBy("group", "depth").agg(F.count(F.lit(1)).alias("n"))
    branching = widths.where("n > 1").groupBy("group").agg(F.min("depth").alias("fork"))
    marked = written(large.join(branching, "group", "left"), "trie-marked")
    stem = marked.where("fork is null or depth < fork")
    below = marked.where("depth >= fork")
    forks = found.select("conv_id", F.col("depth").alias("fork"), F.col("node").alias("next"))
    again = below.join(forks, ["conv_id", "fork"]).select(F.col("next").alias("group"), "depth", "node", "parent", "n_convs", "bytes", "conv_id")
    return stem.select("group", "depth", "node", "parent", "n_convs", "bytes"), written(again, "trie-dealt")


def _stems(stem: DataFrame, sums: DataFrame) -> DataFrame:
    """Sums of the nodes above a split: a chain for each group, its last node above the roots in ``sums``."""
    below = sums.groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    chain = stem.join(below.withColumnRenamed("parent", "node"), "node", "left")
    upwards = Window.partitionBy("group").orderBy(F.col("depth").desc())
    lowest, so_far = F.row_number().over(upwards) == 1, upwards.rowsBetween(Window.unboundedPreceding, 0)
    chain = chain.withColumn("lowest", lowest).withColumn("own", F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes"))
    here = F.when(F.col("lowest"), F.coalesce("leaves", F.lit(1))).otherwise(0)
    kids = F.when(F.col("lowest"), F.coalesce("kids", F.lit(0))).otherwise(1)
    return written(chain.select("node", kids.alias("n_children"), F.sum(here).over(so_far).alias("n_leaves"), F.sum("own").over(so_far).alias("saved_tokens")), "trie-stems")


def sums_of(nodes: DataFrame, found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """nodes: node, parent, first, depth, n_convs, bytes, conv_id. node, n_children, n_leaves, saved_tokens of all."""
    columns = ["depth", "node", "parent", "n_convs", "bytes", "conv_id"]
    groups = nodes.select(F.col("first").alias("group"), *columns)
    built, stems = [], []
    while True:
        sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        over = written(sizes.where(F.col("n") > limit).select("group"), "trie-over")
        built.append(_built(groups.join(over, "group", "left_anti"), limit))
        if over.isEmpty():
            break
        stem, groups = _split(groups.join(over, "group", "left_semi"), found)
        stems.append(stem)
    parents = nodes.select("node", "parent")
    out = built[-1]
    for stem, done in zip(reversed(stems), reversed(built[:-1])):
        out = out.unionByName(_stems(stem, out.join(parents, "node"))).unionByName(done)
    return out


def trie(conversations: DataFrame, shared: int = SHARED, taken: int = TAKEN, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns come in order of ``turn``, null first, then of role and text; null roles and texts are empty; equal
    turns are turns of their own. Rows without a conv_id belong to no conversation. A
    conversation left without turns is a member of the root alone. Other columns are ignored; an empty
    table gives an empty result.
    """
    convs, turns = rebuilt(conversations, shared, taken)
    found = steps(turns)
    same = lambda c: F.min(c).alias(c)
    nodes = written(found.groupBy("node").agg(same("parent"), same("first"), same("depth"), same("bytes"), same("conv_id"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    sums = sums_of(nodes, found, limit)
    hashes = ends(found, convs)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    root = convs.agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")).first()
    first, n = F.lit(root.first).cast("long"), F.lit(root.n)
    tops = sums.join(nodes.where("depth = 1").select("node"), "node", "left_semi").agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")
    )
    top = tops.where(n > 0).select(
        F.lit(ROOT).alias("node"), first.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        n.alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
    )
    inner = nodes.join(sums, "node").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", first))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    both = inner.select("node", *columns).unionByName(top)
    return both.join(hashes, "node", "left").select(*columns, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: The query's rows in DuckDB's SQL, by the prefixes themselves.
ORACLE_SQL = rf"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), asked AS (
        SELECT conv_id, conv_id - conv_id % {SHARED} AS base, {crc_sql("hex(encode(conv_id::VARCHAR))")} % {TAKEN} AS h
        FROM (SELECT DISTINCT conv_id FROM turns), tab
    ), rebuilt AS (
        SELECT a.conv_id, pos, role, text FROM asked a JOIN turns t ON t.conv_id = a.base AND pos < h
        UNION ALL SELECT conv_id, 1000000 + pos, role, text FROM asked JOIN turns USING (conv_id) WHERE pos >= h
    ), paths AS (
        SELECT conv_id, coalesce(path, []) AS path FROM asked LEFT JOIN (
            SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS path FROM rebuilt GROUP BY conv_id) USING (conv_id)
    ), passed AS (
        SELECT conv_id, len(path) AS turns, unnest(range(0, len(path) + 1)) AS depth, path FROM paths
    ), nodes AS (
        SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
        FROM passed GROUP BY 1, 2
    ), childless AS (
        SELECT * FROM nodes ANTI JOIN (SELECT DISTINCT node[1:depth - 1] AS node FROM nodes WHERE depth > 0) USING (node)
    ), above AS (
        SELECT node, depth, n_convs, unnest(range(0, depth + 1)) AS top, node IN (SELECT node FROM childless) AS leaf FROM nodes
    ), sums AS (
        SELECT node[1:top] AS node, count(*) FILTER (depth = top + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves,
            coalesce(sum((n_convs - 1) * strlen(node[depth].text)), 0)::BIGINT AS saved_tokens
        FROM above GROUP BY 1
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]"""
