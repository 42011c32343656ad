"""Behaviour of the graph operators on small inputs."""

from __future__ import annotations

import json
import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blastgraph import schema as S
from blastgraph.functions import coordinates, distance
from blastgraph.functions import semver
from blastgraph.operators import advisories, edges, names, pins, resolve, traverse
from blastgraph.operators.cover import smallest_cover
from blastgraph.sources import archives, lockfiles, org, packuments


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def windows(spark, timeline, spec):
    t = spark.createDataFrame([("dep", v, at) for v, at in timeline.items()], "package string, version string, published_at long")
    r = spark.createDataFrame([("dep", spec)], "package string, range string")
    return [(x.version, x.valid_from, x.valid_to) for x in resolve.resolution_windows(t, r).orderBy("valid_from").collect()]


def naive_windows(timeline, fits):
    """Publications in order; a fitting version that beats all before it takes over."""
    out, best = [], None
    for at, version in sorted((at, v) for v, at in timeline.items()):
        if fits(version) and (best is None or semver.key_of(version) > semver.key_of(best)):
            if out:
                out[-1][2] = at
            out.append([version, at, S.OPEN_END])
            best = version
    return [tuple(w) for w in out]


def test_resolution_windows_equal_a_replay_of_the_timeline(spark):
    r = random.Random(8)
    timeline = {f"{r.randint(1, 3)}.{r.randint(0, 4)}.{r.randint(0, 2)}{r.choice(['', '', '-rc.1'])}": at for at in range(10, 500, 10)}
    stable = lambda v: "-" not in v
    assert windows(spark, timeline, "*") == naive_windows(timeline, stable)
    assert windows(spark, timeline, "^2.1.0") == naive_windows(timeline, lambda v: stable(v) and (2, 1) <= semver.key_of(v)[:2] < (3, 0))
    assert windows(spark, timeline, "~3.2.0") == naive_windows(timeline, lambda v: stable(v) and semver.key_of(v)[:2] == (3, 2))
    assert windows(spark, timeline, "file:../x") == [] == windows(spark, timeline, ">=9")


def test_windows_follow_one_another(spark):
    r = random.Random(4)
    timeline = {f"{r.randint(0, 3)}.{r.randint(0, 9)}.{r.randint(0, 9)}": r.randint(1, 10**6) for _ in range(50)}
    found = windows(spark, timeline, "*")
    assert all(a[2] == b[1] for a, b in zip(found, found[1:])) and found[-1][2] == S.OPEN_END


def test_edges_are_clipped_and_capped(spark):
    w = spark.createDataFrame([("dep", "^1", f"1.{i}.0", 100 * i, 100 * i + 100) for i in range(1, 9)], "package string, range string, version string, valid_from long, valid_to long")
    d = spark.createDataFrame([("a@1", 250, "dep", "^1", "runtime"), ("a@1", 250, "gone", "^1", "dev")], "source string, published_at long, dependency string, range string, kind string")
    found = resolve.dependency_edges(d, w, 3).orderBy("valid_from").collect()
    assert [(e.target, e.valid_from, e.valid_to) for e in found] == [("dep@1.6.0", 600, 700), ("dep@1.7.0", 700, 800), ("dep@1.8.0", 800, 900)]
    every = resolve.dependency_edges(d, w, 99).orderBy("valid_from").first()
    assert (every.resolved_to, every.valid_from) == ("1.2.0", 250)


def test_precedence_upserts_and_endpoints(spark):
    e = spark.createDataFrame([("DEPENDS_ON", "a", "b", k, i, 0) for i, k in enumerate(("dev", "optional", "peer", "runtime"))], "rel_type string, source string, target string, kind string, ordinal int, valid_from long")
    assert [r.kind for r in edges.strongest(e).collect()] == ["runtime"]
    assert [r.kind for r in edges.strongest(e.where("kind <> 'runtime'")).collect()] == ["peer"]
    known = spark.createDataFrame([("a",)], "key string")
    assert edges.known_endpoints(e, known, known).isEmpty() and edges.unwritten_targets(e, known).count() == 4
    old, new = (spark.createDataFrame(x, "key string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert rows(edges.upsert(old, new, "key")) == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(edges.last_written(old.unionByName(new), "key", "v")) == [("a", 1), ("b", 2), ("c", 2)]


def test_dependents_leave_the_package_itself_out(spark):
    e = spark.createDataFrame([("a@1", "b@1"), ("a@2", "b@1"), ("b@2", "b@1"), ("@s/c@1", "b@2")], "source string, target string")
    p = spark.createDataFrame([("a",), ("b",), ("@s/c",)], "name string")
    assert rows(edges.dependent_counts(e, p)) == [("@s/c", 0), ("a", 0), ("b", 2)]


def brute_paths(links, targets, hops):
    found = {(t, (t,)): (0, S.OPEN_END) for t in targets}
    frontier = dict(found)
    for _ in range(hops):
        grown = {}
        for (t, keys), (a, b) in frontier.items():
            for s, d, x, y in links:
                low, high = max(a, x), min(b, y)
                if d == keys[0] and s not in keys and low < high:
                    grown[t, (s, *keys)] = (low, high)
        found |= grown
        frontier = grown
    return {(t, keys, *w) for (t, keys), w in found.items()}


def graph_edges(spark, links):
    return spark.createDataFrame([(S.DEPENDS_ON, s, d, "1", x, y) for s, d, x, y in links], "rel_type string, source string, target string, resolved_to string, valid_from long, valid_to long")


def test_prefixes_equal_brute_force(spark):
    r = random.Random(9)
    names = [f"{x}@1" for x in "abcdefg"]
    links = list({(s, d): (s, d, x := r.randint(0, 50), x + r.randint(1, 60)) for s, d in (r.sample(names, 2) for _ in range(22))}.values())
    bad = names[:2]
    targets = spark.createDataFrame([(x,) for x in bad], "key string")
    e = graph_edges(spark, links)
    found = traverse.prefixes(targets, e, 4).collect()
    brute = brute_paths(links, bad, 4)
    assert {(p.target, tuple(p["keys"]), p.valid_from, p.valid_to) for p in found} == brute
    counted: dict = {}
    for t, keys, x, y in brute:  # the graph has cycles, so some walks aren't simple
        counted[t, keys[0], len(keys) - 1, x, y] = counted.get((t, keys[0], len(keys) - 1, x, y), 0) + 1
    got: dict = {}
    for p in traverse.ways(targets, e, 4).collect():
        got[p.target, p.head, p.hops, p.valid_from, p.valid_to] = got.get((p.target, p.head, p.hops, p.valid_from, p.valid_to), 0) + p.ways
    assert got == counted
    at = {(p.target, tuple(p["keys"])) for p in traverse.prefixes(targets, e, 4, as_of=30).collect()}
    assert at == {(t, k) for t, k, x, y in brute_paths(links, bad, 4) if x <= 30 < y}
    reached = {x.key for x in traverse.reaching(e.select(F.col("source").alias("key")), targets, e, 7).collect()}
    seen = set(bad)
    for _ in range(7):
        seen |= {s for s, d, _, _ in links if d in seen}
    assert reached == {s for s, *_ in links if s in seen}


def test_spread_equals_brute_force_with_and_without_cycles(spark):
    r = random.Random(10)
    for letters, n in (("abcdefgh", 9), ("abcde", 12), ("abc", 5)):
        links = sorted({tuple(r.sample(letters, 2)) for _ in range(n)})
        always = [(s, d, 0, S.OPEN_END) for s, d in links]
        found, longest = traverse.spread(spark.createDataFrame([("a",)], "key string"), graph_edges(spark, always), 6)
        simple = brute_paths(always, "a", 6)
        assert longest == max(len(keys) - 1 for _, keys, *_ in simple)
        assert {x.head for x in found.collect()} == {keys[0] for _, keys, *_ in simple}
        least = {x.head: x.hops for x in found.groupBy("head").agg(F.min("hops").alias("hops")).collect()}
        assert all(least[keys[0]] <= len(keys) - 1 for _, keys, *_ in simple)


def test_service_paths(spark):
    e = graph_edges(spark, [("w@1", "bad@1", 10, 20)])
    pin = spark.createDataFrame([("l1", "w", "1", "w@1", True), ("l1", "bad", "1", "bad@1", True), ("l2", "bad", "1", "bad@1", False)], "source string, package string, version string, target string, direct boolean")
    lock = spark.createDataFrame([("l1", "p1", "shop"), ("l2", "p2", "api")], "key string, path string, service string")
    target = spark.createDataFrame([("bad@1",)], "key string")
    found = traverse.service_paths(traverse.prefixes(target, e, 6, links=True), pin, lock)
    ways = traverse.service_ways(traverse.ways(target, e, 6), pin, lock)
    assert rows(ways.select("service", "entry", "hops", "direct", "ways")) == rows(found.groupBy("service", "entry", "hops", "direct").count())
    assert {(p.service, p.entry, p.hops, p.direct) for p in found.collect()} == {("shop", "w@1", 3, False), ("shop", "bad@1", 2, True), ("api", "bad@1", 2, False)}
    links = found.where("hops = 3").first()["links"]
    assert [(x.rel_type, x.holder, x.depends_on) for x in links] == [("USES_LOCKFILE", "shop", "p1"), ("PINS", "p1", "w@1"), ("DEPENDS_ON", "w@1", "bad@1")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 7), max_size=4), max_size=10), st.permutations(range(8)))
def test_cover_meets_every_row_with_the_fewest_options(rows, preference):
    found = smallest_cover(rows, preference)
    real = [r for r in rows if r]
    assert all(r & set(found.chosen) for r in real) and found.proven and found.unmet == len(rows) - len(real)
    best = next(n for n in range(9) if any(all(r & set(c) for r in real) for c in combinations(range(8), n)))
    assert len(found.chosen) == best


def test_cover_prefers_and_splits():
    assert smallest_cover([{"a", "b"}, {"a", "b"}], ["b", "a"]).chosen == ["b"]
    assert smallest_cover([], ["a"]).chosen == [] and smallest_cover([set()], ["a"]).unmet == 1
    hard = [frozenset(random.Random(i).sample(range(60), 4)) for i in range(300)]
    short = smallest_cover(hard, range(60), effort=1)
    assert not short.proven and all(r & set(short.chosen) for r in hard)


def naive_osa(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcé漢", max_size=7), st.text("abcé漢", max_size=7)), max_size=20), st.integers(0, 8))
def test_osa(pairs, ceiling):
    found = distance.osa([a for a, _ in pairs], [b for _, b in pairs], ceiling).tolist()
    assert found == [min(naive_osa(a, b), ceiling + 1) for a, b in pairs]


def test_native_distance(spark):
    r = random.Random(2)
    pairs = [("".join(r.choices("ab", k=r.randint(0, 5))), "".join(r.choices("ab", k=r.randint(0, 5)))) for _ in range(400)] + [("abcdef", "abdcef"), ("ca", "abc"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2):
        assert all(x.d == min(naive_osa(x.a, x.b), k + 1) for x in df.withColumn("d", distance.distance(F.col("a"), F.col("b"), k)).collect())


def naive_radar(counts, owners, popular_at, most):
    """All pairs, the first trick that fits."""
    out = {}
    for name, n in counts.items():
        for other, m in counts.items():
            if name == other or n >= popular_at or m < popular_at or n >= m:
                continue
            plain = [x.translate({ord(c): None for c in "-_."}) for x in (name, other)]
            d = naive_osa(name, other)
            if name.startswith("@") and name.split("/")[-1] == other:
                trick = ("scoped copy", 0)
            elif plain[0] == plain[1]:
                trick = ("punctuation", 0)
            elif d <= most:
                trick = ("one edit" if d == 1 else f"{d} edits", d)
            else:
                continue
            out[name, other] = (*trick, bool(owners.get(name, set()) & owners.get(other, set())), n / m)
    return out


def test_suspects_equal_a_naive_radar(spark):
    r = random.Random(12)
    bases = ["".join(r.choices("abcd", k=r.randint(3, 6))) for _ in range(25)]
    names_ = set(bases) | {f"@s/{r.choice(bases)}" for _ in range(6)} | {f"{x[:2]}-{x[2:]}" for x in r.sample(bases, 8)} | {x[:i] + r.choice("abcdx") + x[i + 1 :] for x in bases for i in [r.randrange(len(x))]}
    counts = {x: r.choice([0, 1, 3, 9, 30, 40, 100]) for x in sorted(names_)}
    owners = {x: set(r.sample(["ann", "bob", "cid", "dee"], r.randint(0, 2))) for x in counts}
    p = spark.createDataFrame(list(counts.items()), "package string, dependents long")
    o = spark.createDataFrame([(x, m) for x, ms in owners.items() for m in ms], "package string, maintainer string")
    for most in (1, 2):
        found = {(x.name, x.resembles): (x.trick, x.distance, x.shares_maintainer, x.ratio) for x in names.suspects(p, o, 30, most).collect()}
        assert found == naive_radar(counts, owners, 30, most) and found


def test_discovery_order_and_budget_equal_a_queue(spark):
    r = random.Random(6)
    names_ = [f"p{i}" for i in range(40)]
    declared = [(r.choice(names_), r.choice([*names_, "missing"]), r.choice(["runtime", "dev", "optional", "peer"])) for _ in range(160)]
    known = set(r.sample(names_, 34))
    seeds = r.sample(names_, 5)

    def crawl(depth, budget):
        queue, queued, out = [(s, 0) for s in seeds], set(seeds), []
        while queue and len(out) < budget:
            name, at = queue.pop(0)
            if name not in known:
                continue
            out.append((name, at, len(out)))
            if at < depth:
                for d in sorted({d for p, d, k in declared if p == name and (at == 0 or k in ("runtime", "optional"))} - queued):
                    queued.add(d)
                    queue.append((d, at + 1))
        return sorted(out)

    s = spark.createDataFrame([(x, i) for i, x in enumerate(seeds)], "package string, place long")
    d = spark.createDataFrame(declared, "package string, dependency string, kind string")
    k = spark.createDataFrame([(x,) for x in known], "package string")
    for depth, budget in ((0, 3), (2, 12), (4, 20), (4, 10**6)):
        assert rows(traverse.discover(s, d, k, depth, budget).select("package", "depth", "place")) == crawl(depth, budget)
    assert rows(traverse.discover(s, d, k, 4).select("package", "depth", "place")) == crawl(4, 10**6)


def test_advisory_intervals(spark):
    a = spark.createDataFrame(
        [("A", "p", [("0", "1.2.0", "")], []), ("B", "p", [("1.2.0", "", "1.3.0")], []), ("C", "p", [], ["9.9.9", "1.0.0"]), ("D", "q", [("", "", "")], []), ("E", "p", [("1.2.0", "1.2.0", "")], [])],
        f"osv_id string, package string, intervals {advisories.INTERVALS}, versions array<string>",
    )
    r = spark.createDataFrame([("p", v, f"p@{v}") for v in ("1.0.0", "1.2.0-rc.1", "1.2.0", "1.3.0", "1.3.1", "junk")], "package string, version string, key string")
    found = {(x.osv_id, x.version, x.range_source) for x in advisories.affected_releases(a, r).collect()}
    assert found == {("A", "1.0.0", "range"), ("A", "1.2.0-rc.1", "range"), ("B", "1.2.0", "range"), ("B", "1.3.0", "range"), ("C", "1.0.0", "enumerated")}


def test_coordinates(spark):
    df = spark.createDataFrame([("@a/b@1.0.0",), ("c@2",)], "k string")
    assert rows(df.select(coordinates.package_of(F.col("k")), coordinates.version_of(F.col("k")))) == [("@a/b", "1.0.0"), ("c", "2")]
    path = spark.createDataFrame([("node_modules/a/node_modules/@s/b",)], "p string")
    assert path.select(coordinates.from_module_path(F.col("p")).alias("n")).first().n == "@s/b"


def parsed(spark, path, document, manifest=None):
    files = spark.createDataFrame([("shop", path, document, manifest)], "service string, path string, document string, manifest string")
    return rows(lockfiles.pins(files).select("kind", "format_version", "name", "version", "direct"))


def test_lockfiles_tolerate_and_merge(spark):
    assert parsed(spark, "x/package-lock.json", "not json") == [] == parsed(spark, "yarn.lock", "") == parsed(spark, "p/pnpm-lock.yaml", ": [")
    twice = '{"lockfileVersion":2,"packages":{"":{"dependencies":{"z":"1"}},"node_modules/z":{"version":"3.1.0"},"node_modules/y/node_modules/z":{"version":"3.1.0"},"odd":7}}'
    assert parsed(spark, "package-lock.json", twice) == [("npm", "2", "z", "3.1.0", True)]
    assert parsed(spark, "npm-shrinkwrap.json", twice, "{}") == [("npm", "2", "z", "3.1.0", False)]
    assert parsed(spark, "package-lock.json", '{"dependencies":{"z":{"version":"1.0.0"},"odd":[1]}}', '{"dependencies":{"z":"1"}}') == [("npm", "", "z", "1.0.0", True)]
    lines = "# a comment\r\n\r\nz@1, z@^1.0.0:\r\n  resolved x\r\n  version 1.0.3\r\n  version 9.9.9\r\n"
    assert parsed(spark, "yarn.lock", lines) == [("yarn", "1", "z", "1.0.3", False)]
    newer = '__metadata:\n  version: 8\n"z@npm:^3.0.0, z@npm:3.1.0":\n  version: 3.1.0\n"mine@workspace:.":\n  version: 0.0.0-use.local\n'
    assert parsed(spark, "yarn.lock", newer, '{"dependencies":{"z":"^3"}}') == [("yarn", "8", "z", "3.1.0", True)]
    importers = "lockfileVersion: '6.0'\nimporters:\n  .:\n    devDependencies:\n      z:\n        version: 3.1.0\npackages:\n  /z@3.1.0:\n    dev: true\n  /y/2.0.0: {}\n"
    assert parsed(spark, "pnpm-lock.yaml", importers) == [("pnpm", "6.0", "y", "2.0.0", False), ("pnpm", "6.0", "z", "3.1.0", True)]


def test_yaml_lines_give_what_a_yaml_parser_gives(spark):
    yaml = pytest.importorskip("yaml")
    r = random.Random(14)

    def name():
        return r.choice(["", "@s/"]) + "".join(r.choices("abc-", k=3)).strip("-") + r.choice(["x", "y"])

    def write(document):
        return yaml.safe_dump(document, sort_keys=False, width=10**6, default_style=r.choice([None, "'", '"']) if r.random() < 0.5 else None)

    for _ in range(4):
        packages = {f"{r.choice(['', '/'])}{name()}@{r.randint(0, 9)}.{r.randint(0, 9)}.0{r.choice(['', '(peer@1.0.0)'])}": r.choice([{}, {"dev": True, "version": "9", "dependencies": {name(): "1.0.0"}}]) for _ in range(6)}
        named = [re.sub(r"^/", "", k).split("(")[0].rpartition("@") for k in packages]
        declared = r.sample([n for n, _, _ in named], 2)
        importers = {r.choice([".", "apps/web"]): {"dependencies": {declared[0]: {"specifier": "^1", "version": "1.0.0"}}, "devDependencies": {declared[1]: {"version": "2.0.0"}}}}
        document = {"lockfileVersion": "9.0", "importers": importers, "packages": packages, "note": "a: b # c"}
        want = {("pnpm", "9.0", n, v, n in declared) for n, _, v in named}
        assert set(parsed(spark, "pnpm-lock.yaml", write(document))) == want
        top = {"lockfileVersion": 5.4, "dependencies": {declared[0]: "1.0.0"}, "packages": packages}
        assert set(parsed(spark, "pnpm-lock.yaml", yaml.safe_dump(top, sort_keys=False, width=10**6))) == {("pnpm", "5.4", n, v, n == declared[0]) for n, _, v in named}
        berry = {"__metadata": {"version": 6, "cacheKey": 8}, "own@workspace:.": {"version": "0.0.0-use.local", "resolution": "own@workspace:."}}
        berry |= {f"{n}@npm:^{i}, {n}@npm:{v}": {"version": v, "resolution": f"{n}@npm:{v}", "dependencies": {"version": "^7"}} for i, (n, _, v) in enumerate(named)}
        assert set(parsed(spark, "yarn.lock", write(berry), json.dumps({"dependencies": {declared[0]: "*"}}))) == {("yarn", "6", n, v, n == declared[0]) for n, _, v in named}


def test_unknown_lockfiles_fail(spark):
    for call in (lambda: lockfiles.kind_of("Cargo.lock"), lambda: parsed(spark, "Cargo.lock", "")):
        try:
            call()
        except Exception as e:
            assert "UnknownLockfile" in type(e).__name__ + str(e)
        else:
            raise AssertionError


def test_archives_count_what_is_no_json(spark, tmp_path):
    import zipfile

    good = '{"id":"A","summary":" \\n","details":"\\n\\n  head \\nmore","severity":[{"type":"x"},{"score":"S"}],"affected":[{"package":{"ecosystem":"npm","name":"z"},"versions":["1"]}]}'
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("a/A.json", good)
        z.writestr("a/B.json", '{"id":')
        z.writestr("a/C.json", "[1]")
        z.writestr("readme.txt", "no")
    found = archives.read(spark, str(tmp_path / "all.zip"))
    assert found.count() == 3 and found.where(advisories.malformed(F.col("value"))).count() == 1
    row = advisories.parse(advisories.read_documents(found)).first()
    assert (row.osv_id, row.summary, row.severity, row.published_at) == ("A", "head ", "S", 0)


def test_archives_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import zipfile

    want = {}
    for a in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w") as z:
            for i in range(4_000):
                text = json.dumps({"id": f"{a}-{i}", "filler": str(i) * 20})
                z.writestr(f"d{i % 7}/{i}é.json", text, zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
                want[f"{a}-{i}"] = text
    (tmp_path / "three.json").write_text('{"id":"three"}')
    found = archives.read(spark, str(tmp_path), block=20_000)
    got = found.select("value", F.spark_partition_id().alias("p"), F.get_json_object("value", "$.id").alias("id")).collect()
    assert {r.id: r.value for r in got} == want | {"three": '{"id":"three"}'} and len(got) == len(want) + 1
    assert len({r.p for r in got if r.id.startswith("one")}) > 1
    monkeypatch.setattr(archives, "_opens", lambda path: False)
    assert {r.value for r in archives.read(spark, str(tmp_path)).collect()} == {r.value for r in got}


def test_pins_and_recent(spark):
    p = spark.createDataFrame([("l", "a", "1", True), ("l", "x", "9", False)], "source string, package string, version string, direct boolean")
    r = spark.createDataFrame([("a", "1", "a@1", 5), ("a", "2", "a@2", 9)], "package string, version string, key string, published_at long")
    assert rows(pins.matched(p, r).select("target")) == [("a@1",)] and rows(pins.unmatched_sample(p, r)) == [("x@9",)]
    assert rows(packuments.recent(r, 1).select("key")) == [("a@2",)] and packuments.recent(r, 0).count() == 2


def test_org_manifest(spark, tmp_path):
    (tmp_path / "org.json").write_text('{"org":"acme","services":[{"name":"api","repo":"r","path":"api","committed_at":"2022-03-01T09:12:00Z"},{"name":"web","criticality":"tier-1","committed_at":"77"}]}')
    got = rows(org.read(spark, str(tmp_path / "org.json")).select("name", "criticality", "path", "committed_at"))
    assert got == [("api", "unknown", "api", 1646125920), ("web", "tier-1", "web", 77)]


def test_names_one_edit_apart_meet_once_and_are_never_broadcast(spark):
    r = random.Random(5)
    some = sorted({"".join(r.choice("ab\U0001f600") for _ in range(r.randint(0, 5))) for _ in range(120)})
    found = names.one_edit(spark.createDataFrame([(x,) for x in some * 2], "name string"))
    met = [(x.a, x.b) for x in found.collect()]
    d = distance.osa([a for a in some for _ in some], [b for _ in some for b in some], 1)
    want = [(a, b) for (a, b), n in zip(((a, b) for a in some for b in some), d) if n == 1]
    assert sorted(met) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    known = spark.createDataFrame([("abcd", 9), ("abce", 1)], "package string, dependents long")
    near = names.suspects(known, spark.createDataFrame([], "package string, maintainer string"), 5)
    logical = near._jdf.queryExecution().optimizedPlan().toString()
    assert "merge" in logical
