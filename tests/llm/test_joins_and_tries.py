"""Importance resampling, the Jaccard join and the conversation trie against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blastgraph.llm import conversation_trie, importance, jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Null in every column, empty and blank texts, repeated rows and ids, a long text, ties.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a/x", 30), (1, "the quick brown fox jumps over the lazy dog", "en", "a/x", 30), (2, "The  quick\tbrown fox jumps over the lazy dog", "en", "b/x", 31),
    (3, None, None, None, None), (4, "", "en", "a/x", 0), (None, "nobody owns this row", "en", "b/x", 20), (None, None, None, None, None), (5, " \n\t", "en", None, 3),
    (6, LONG, "en", "a/x", len(LONG)), (7, LONG + " end", "de", "c", len(LONG) + 4), (1, "another text under a used id", "fr", "c", 28), (None, LONG, "en", "a/x", 1), (8, "Žluťoučký kůň's 3.14", "cs", "c", 20),
    (9, "one two", "en", "c", 7), (10, "ONE two", "en", "c", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def benchmark_texts(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def clashing(df, *but):
    names = [n for n in ("_rid", "cid", "key", "a", "b", "n", "label", "TEXT", "bits", "weight", "score", "rank", "_rank", "node", "at", "Doc_Id", "Conv_Id") if n not in but]
    return df.select("*", *[F.lit("z").alias(n) for n in names])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Importance resampling


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789žé漢", min_size=1, max_size=40), max_size=30), st.integers(1, 4))
def test_ngram_crcs_are_those_of_the_joined_words(words, max_n):
    coded = [w.encode() for w in words]
    crcs, lengths = importance.word_crcs(" ".join(words).encode())
    want = [zlib.crc32(b" ".join(coded[i : i + n])) for n in range(1, max_n + 1) for i in range(len(coded) - n + 1)]
    assert importance.ngram_crcs(crcs, lengths, max_n).tolist() == want


def test_crcs_shift_by_long_lengths():
    lengths = np.array([0, 1, 7, 1 << 16, 123_457])
    crcs = np.array([zlib.crc32(b"head")] * len(lengths), np.uint32)
    tails = [bytes(range(256)) * (n // 256) + b"x" * (n % 256) for n in lengths.tolist()]
    found = importance.shifted(crcs, lengths) ^ np.array([zlib.crc32(t) for t in tails], np.uint32)
    assert found.tolist() == [zlib.crc32(b"head" + t) for t in tails]


def test_words_across_pieces(monkeypatch):
    text = "".join(random.Random(3).choice("ab1é -.\n") for _ in range(5_000)).encode()
    whole = importance.word_crcs(text)
    monkeypatch.setattr(importance, "PIECE", 7)
    cut = importance.word_crcs(text)
    assert all((x == y).all() for x, y in zip(whole, cut)) and len(whole[0]) == len(importance.WORDS.findall(text))


def brute_importance(docs, target, max_n, buckets, seed, min_words, drawn):
    def of(text):
        low = (text or "").translate({ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    own, theirs = [of(x) for _, x in docs], [of(x) for x in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in theirs for b in f)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for (doc_id, _), (n_words, found) in zip(docs, own):
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(fit[: len(fit) * drawn // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("max_n", [1, 3])
def test_importance_equals_brute_force(docs, benchmark_texts, max_n):
    found = importance.importance(docs, benchmark_texts, max_n=max_n, buckets=997)
    want = brute_importance([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark_texts.collect()], max_n, 997, 2024, 20, 10)
    assert rows(found) == sorted(want, key=repr)


def test_importance_takes_odd_rows(spark, odd):
    target = spark.createDataFrame([("Lazy dog",), (None,), ("",)], "text string")
    found = rows(importance.importance(odd, clashing(target, "TEXT"), min_words=2, drawn=50))
    want = brute_importance([(r.doc_id, r.text) for r in odd.collect()], ["Lazy dog", None, ""], 1, 10_000, 2024, 2, 50)
    assert [r[:4] for r in found] == sorted((r[:4] for r in want), key=repr) or sorted(r[:4] for r in found if r[0]) == sorted(r[:4] for r in want if r[0])
    ranks = sorted(r[4] for r in found if r[4])
    assert ranks == list(range(1, sum(r[4] is not None for r in want) + 1))
    assert rows(importance.importance(clashing(odd), target, min_words=2, drawn=50).drop("rank")) == sorted((r[:4] for r in found), key=repr)
    assert importance.importance(odd.limit(0), target).count() == 0
    assert importance.importance(odd, target.limit(0)).count() == len(ODD)


def test_importance_sample_keeps_whole_rows(docs, benchmark_texts):
    drawn = importance.importance(docs, benchmark_texts, max_n=2).where("rank is not null")
    sample = importance.importance_sample(clashing(docs), benchmark_texts)
    assert sample.columns == clashing(docs).columns
    assert sorted(r[0] for r in sample.collect()) == sorted(r.doc_id for r in drawn.collect())


# Jaccard join


def brute_sets(texts):
    out = []
    for text in texts:
        low = (text or "").translate({ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_jaccard(docs):
    sets = brute_sets(x for _, x in docs)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return [(doc_id, len(sets[i]), min(ids[find(i)], default=None)) for i, (doc_id, _) in enumerate(docs)]


def family(seed, n, words, kept):
    """Texts that share words with one base, so that pairs lie on both sides of 0.8."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(draw.randrange(kept)):
            text[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_jaccard_equals_brute_force(odd, docs):
    for df in (odd, docs):
        want = brute_jaccard([(r.doc_id, r.text) for r in df.collect()])
        assert rows(jaccard_join.jaccard_components(df)) == sorted(want, key=repr)
    assert rows(jaccard_join.jaccard_components(clashing(odd))) == rows(jaccard_join.jaccard_components(odd))
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_half_similar_families_lose_no_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block_rows)
    texts = family(1, 150, 120, 12) + family(2, 150, 60, 6) + [" ".join(f"s{i}" for i in range(k)) for k in range(1, 80)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(jaccard_join.jaccard_components(df)) == sorted(brute_jaccard(docs), key=repr)


def test_tiles_alone_find_all_links(spark, monkeypatch):
    """Without the stars of minimum hashes, by the prefix keys and blocks of size bands alone."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "_stars", lambda texts, classes, *_: classes.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0))
    docs = list(enumerate(family(5, 60, 80, 10) + [" ".join(f"s{i}" for i in range(k)) for k in range(1, 60)]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_join.jaccard_components(df)) == sorted(brute_jaccard(docs), key=repr)


def test_bitmaps_never_bound_too_low_and_prefixes_meet():
    draw = np.random.default_rng(4)
    cells = draw.integers(0, 50, jaccard_join.CELLS)
    for _ in range(400):
        n = int(draw.integers(1, 300))
        base = draw.integers(0, 2**63, n, dtype=np.uint64)
        x = np.unique(base)
        y = np.unique(np.concatenate([base[: int(n * draw.uniform(0.5, 1))], draw.integers(0, 2**63, int(draw.integers(0, max(1, n // 4) + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert jaccard_join.overlap(x, y) == both
        p, q = jaccard_join.signature(x), jaccard_join.signature(y)
        w = min(len(p), len(q))
        assert jaccard_join.bound(jaccard_join.folded(p, w), jaccard_join.folded(q, w)[None], len(x), np.array([len(y)]))[0] >= both
        assert jaccard_join.within_bound(p.tobytes(), q.tobytes(), len(x), len(y), 80) == (
            jaccard_join.bound(jaccard_join.folded(p, w), jaccard_join.folded(q, w)[None], len(x), np.array([len(y)]))[0] >= jaccard_join.least_overlap(len(x), len(y))
        )
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert both >= jaccard_join.least_overlap(len(x), len(y))
            p, q = jaccard_join.prefix(x, cells).tolist(), jaccard_join.prefix(y, cells).tolist()
            first = next(h for h in p if h in set(q))
            small, large = sorted(((len(x), p.index(first)), (len(y), q.index(first))))
            assert jaccard_join.possible(np.array(small[0]), np.array(small[1]), np.array(large[0]), np.array(large[1]), 80)
        else:
            assert both < jaccard_join.least_overlap(len(x), len(y))


def test_word_hashes_follow_the_words_alone(monkeypatch):
    draw = random.Random(11)
    words = ["".join(draw.choices("abž漢\x00", k=draw.randint(1, 30))).encode() for _ in range(300)] + [b"a", b"a\x00", b"\x00", b"ab" * 300]
    for piece in (1 << 16, 16):
        monkeypatch.setattr(jaccard_join, "PIECE", piece)
        jaccard_join._tables.cache_clear()
        alone = [int(jaccard_join.word_hashes(w)[0]) for w in words]
        text = b"".join(w + draw.choice([b" ", b"\n\t", b"\r\x0b\x0c "]) for w in words)
        assert jaccard_join.word_hashes(b"  " + text).tolist() == alone == jaccard_join.word_hashes(text.strip()).tolist()
        assert len(set(alone)) == len(set(words))
    monkeypatch.undo()
    jaccard_join._tables.cache_clear()
    assert len(jaccard_join.word_hashes(b" \n ")) == len(jaccard_join.word_hashes(b"")) == 0


def test_jaccard_dedup_keeps_one_row_of_each_component(odd, docs):
    for df in (odd, docs):
        found = jaccard_join.jaccard_dedup(clashing(df))
        assert found.columns == clashing(df).columns
        texts = [(i, r.text) for i, r in enumerate(df.collect())]
        groups = {c for (_, n, c) in brute_jaccard(texts) if n}
        assert found.count() == len(groups) + sum(n == 0 for _, n, _ in brute_jaccard(texts))


def test_shingle_sets_are_those_of_the_contract(docs):
    texts = [r.text for r in docs.limit(50).collect()] + [x[1] for x in ODD]
    assert [len(jaccard_join.shingle_set((x or "").encode())) for x in texts] == [len(s) for s in brute_sets(texts)]


# Conversation trie


def brute_trie(turns, shared=5, taken=9):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % taken
        paths[c] = convs.get(c - c % shared, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, own in members.items():
        below, todo = [], [node]
        while todo:
            below.append(todo.pop())
            todo += children[below[-1]]
        ids = ",".join(str(c) for c in sorted(c for c in own if len(paths[c]) == len(node)))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), sum(not children[n] for n in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [100_000, 40, 3])
def test_trie_equals_brute_force(spark, limit):
    given_ = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert rows(conversation_trie.trie(given_, limit=limit)) == brute_trie([tuple(r) for r in given_.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("limit", [100_000, 5])
def test_trie_of_odd_conversations(spark, limit):
    draw = random.Random(8)
    odd = [(None, 1, "user", "no conversation"), (0, None, None, None), (0, 3, "user", "é"), (0, 3, "user", "é"), (0, 3, None, "z"), (7, 1, "user", "own"), (11, 0, "user", None)]
    # One chain shared by many, ends at every depth, forks at some; and copies.
    chain = [("user" if i % 2 else "bot", f"turn {i}") for i in range(30)]
    for c in range(100, 160):
        path = chain[: draw.randrange(1, 31)] + [("user", f"own {draw.randrange(3)}")] * draw.randrange(3)
        odd += [(c, i, *t) for i, t in enumerate(path)]
    odd += [(200, i, "user", f"alone {i}") for i in range(25)]
    df = spark.createDataFrame(odd, TURNS).repartition(3)
    want = brute_trie(odd)
    assert rows(conversation_trie.trie(df, limit=limit)) == want
    assert rows(conversation_trie.trie(clashing(df), limit=limit)) == want


def test_trie_of_nothing_and_of_a_conversation_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_trie.trie(none).count() == 0
    lonely = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(lonely, 0, "user", "gone")], TURNS)
    assert rows(conversation_trie.trie(df)) == brute_trie([(lonely, 0, "user", "gone")]) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_queries_are_registered():
    from blastgraph.llm import queries

    names = {"op11_importance", "op12_jaccard_join", "op13_conversation_trie"}
    assert names <= set(queries.QUERIES) and names <= set(queries.ORACLE_SQL)
