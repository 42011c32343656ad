"""Registered queries against their SQL at the smallest scale; snapshot, command line, streaming."""

from __future__ import annotations

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from blastgraph import cli, queries, samples, storage
from blastgraph import ingest as load
from blastgraph.graph import Graph, census
from blastgraph.operators import traverse
from blastgraph.plans import blast, compromise, evaluate, fix
from blastgraph.sources.projection import Projection
from blastgraph.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(df):
    columns = sorted(df.columns)
    text = df[columns].astype(object).where(df[columns].notna(), None).astype(str).replace(r"\.0$", "", regex=True)
    return columns, sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, duck):
    assert plain(queries.QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(queries.ORACLE_SQL[name]).df())


def test_projections_follow_their_files_and_tables(spark, sf, tmp_path):
    import shutil

    for name in ("lineitem", "part"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(500).write.parquet(str(tmp_path / f"{name}.parquet"))
    one = Projection.of(spark, str(tmp_path))
    n = one.raw_releases.count()
    assert Projection.of(spark, str(tmp_path)) is one
    shutil.rmtree(storage.path_of(one.raw_releases).removeprefix("file://"))
    two = Projection.of(spark, str(tmp_path))
    assert two is not one and two.raw_releases.count() == n
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(100).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert Projection.of(spark, str(tmp_path)).raw_releases.count() < n


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="session")
def saved(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("graph"))
    Projection(spark, sf).snapshot().save(folder)
    return folder


def test_snapshot_and_plan(spark, saved):
    graph = Graph.load(spark, saved)
    assert census(graph).where("n > 0").count() == 6
    bad = compromise.bad_by_range(graph, "pkg20", ">=1.2.0 <1.6.0")
    assert {r.version for r in bad.collect()} <= {"1.2.0", "1.3.0", "1.4.0", "1.5.0"}
    found = blast.paths(graph, bad, links=True)
    made = fix.plan(graph, found, bad)
    totals = made.totals.first()
    assert totals.paths > 0 and totals.severed == totals.paths and totals.complete != totals.truncated or totals.rounds == 3
    assert totals.followable == (totals.complete and totals.blocked == 0)
    bad_keys = {r.key for r in bad.collect()}
    assert not {f"{v.package}@{v.to_version}" for v in made.changes.collect()} & bad_keys
    few = fix.numbered(found, 5)
    assert few.count() == 5 and {r.truncated for r in few.collect()} == {True}
    assert not fix.choose(few).totals.first().complete
    assert fix.choose(fix.numbered(found.limit(0))).totals.first().complete is False
    with pytest.raises(compromise.NothingKnown):
        compromise.known(compromise.bad_by_range(graph, "nothing"), "nothing")


def chains(spark, *paths):
    """Numbered chains from lists of (rel_type, holder, depends_on)."""
    rows = [(i, "shop", paths[i][-1][2], False, [(*link, link[2].split("@")[0], "1", False) for link in paths[i]]) for i in range(len(paths))]
    return spark.createDataFrame(rows, "path_id long, service string, target string, truncated boolean, links array<struct<rel_type:string,holder:string,depends_on:string,package:string,version:string,direct:boolean>>")


def test_fix_chooses_the_fewest_changes_and_own_pins_first(spark):
    pin = lambda a, b: ("PINS", a, b)
    dep = lambda a, b: ("DEPENDS_ON", a, b)
    shared = chains(spark, [("USES_LOCKFILE", "shop", "l1"), pin("l1", "web@1"), dep("web@1", "bad@1")], [pin("l2", "web@1"), dep("web@1", "bad@1")])
    made = fix.choose(shared)
    assert [(r.holder, r.severs, r.mine) for r in made.changes.collect()] == [("web@1", 2, False)]
    assert (made.totals.first().severed, made.totals.first().exact, made.totals.first().complete) == (2, True, True)
    lone = fix.choose(chains(spark, [pin("l1", "web@1"), dep("web@1", "bad@1")])).changes.collect()
    assert [r.mine for r in lone] == [True] and "l1" in lone[0].description
    around = fix.choose(shared, made.changes).changes.collect()
    assert sorted(r.holder for r in around) == ["l1", "l2"]
    cut = fix.severed_paths(shared, made.changes)
    assert cut.where("cut").count() == 2


def test_command_line(spark, saved, capsys):
    assert cli.main([saved, "doctor"]) == 0
    assert cli.main([saved, "probe"]) == 0
    assert cli.main([saved, "reach", "--package", "pkg20"]) == 0
    assert cli.main([saved, "blast", "--package", "no-such-package"]) == 1
    with pytest.raises(SystemExit):
        cli.main([saved, "blast"])
    assert cli.main([saved, "fix", "--package", "pkg20"]) == 0
    assert cli.main([saved, "--json", f"{saved}-json", "blast", "--package", "pkg20", "--paths", "2"]) == 0
    assert spark.read.json(f"{saved}-json").count() > 0
    assert "Release" in capsys.readouterr().out


def test_probe(spark, monkeypatch, tmp_path):
    row = storage.round_trip(spark).first()
    assert row.readable and row.deletable and row.healthy and row.elapsed_ms > 0
    (tmp_path / "file").write_text("no folder")
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}/file")
    row = storage.round_trip(spark).first()
    assert not (row.readable or row.deletable or row.healthy)


def test_ingest_from_files(spark, tmp_path):
    doc = {"name": "left", "time": {"1.0.0": "2020-01-01T00:00:00Z"}, "versions": {"1.0.0": {"_npmUser": {"name": "ann"}}}}
    right = {"name": "right", "time": {"2.0.0": "2021-01-01T00:00:00Z"}, "versions": {"2.0.0": {"dependencies": {"left": "^1.0.0", "gone": "*"}}}}
    for d in (doc, right):
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / f"{d['name']}.json").write_text(json.dumps(d))
    (tmp_path / "repos" / "shop").mkdir(parents=True)
    (tmp_path / "repos" / "shop" / "package-lock.json").write_text('{"lockfileVersion":3,"packages":{"node_modules/right":{"version":"2.0.0"}}}')
    (tmp_path / "repos" / "shop" / "package.json").write_text('{"dependencies":{"right":"^2"}}')
    (tmp_path / "org.json").write_text('{"org":"acme","services":[{"name":"shop","path":"shop","committed_at":"2022-01-01T00:00:00Z"}]}')
    (tmp_path / "adv").mkdir()
    (tmp_path / "adv" / "A.json").write_text('{"id":"A","affected":[{"package":{"ecosystem":"npm","name":"left"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]}]}]}')
    made = load.from_folders(spark, str(tmp_path / "docs"), str(tmp_path / "org.json"), str(tmp_path / "repos"), str(tmp_path / "adv"))
    counters = {r.counter: r.n for r in made.counters.collect()}
    assert (counters["releases"], counters["depends_on"], counters["pins"], counters["affects"], counters["unmatched_pins"]) == (2, 1, 1, 1, 0)
    args = [str(tmp_path / "graph"), "ingest", "--documents", str(tmp_path / "docs"), "--organisation", str(tmp_path / "org.json"), "--repositories", str(tmp_path / "repos"), "--advisories", str(tmp_path / "adv")]
    assert cli.main([*args, "--seeds", "right", "--max-packages", "1", "--state", str(tmp_path / "state")]) == 0
    assert [r.package for r in Graph.load(spark, str(tmp_path / "graph")).releases.collect()] == ["right"]
    bad = compromise.bad_by_advisory(made.graph, "A")
    assert [(r.service, r.entry, r.hops) for r in blast.paths(made.graph, bad).collect()] == [("shop", "right@2.0.0", 3)]


def test_evaluation(spark, saved):
    graph = Graph.load(spark, saved)
    report = evaluate.report(graph, 2).cache()
    total = evaluate.summary(report, "speedup").first()
    assert (total.cases, total.agreement) == (2, 1.0) and total.median_speedup > 0
    assert evaluate.summary(report.limit(0)).first().agreement == 1.0
    assert evaluate.by_name_similarity(graph.packages.select("name").toDF("package"), spark.createDataFrame([], "case string, package string")).count() == 0


def naive_forward(links, sources, bad, hops, cap):
    """Depth first, one source and case at a time: chains met (at most cap), and the releases on them."""
    out, on = {}, set()

    def walk(path, low, high):
        if path[-1] in bad:
            yield path
        if len(path) <= hops:
            for s, d, x, y in links:
                if s == path[-1] and d not in path and max(low, x) < min(high, y):
                    yield from walk([*path, d], max(low, x), min(high, y))

    for source, entries in sources.items():
        for entry, pins in entries.items():
            for path in walk([entry], 0, 10**9):
                for case in bad[path[-1]]:
                    out[case, source] = out.get((case, source), 0) + pins
                    on |= {(case, r) for r in path}
    return {k: min(v, cap) for k, v in out.items()}, on


def test_walks_service_by_service_equal_brute_force(spark):
    r = random.Random(31)
    for letters, n in (("abcdefgh", 22), ("abcdefghij", 18)):
        names = [f"{x}@1" for x in letters]
        links = list({(s, d): (s, d, x := r.randint(0, 50), x + r.randint(1, 60)) for s, d in (r.sample(names, 2) for _ in range(n))}.values())
        bad = {names[0]: ["one", "two"], names[1]: ["two"]}
        sources = {f"shop{i}": {e: r.randint(1, 3) for e in r.sample(names, 3)} for i in range(4)}
        edges = spark.createDataFrame([("DEPENDS_ON", s, d, "1", x, y) for s, d, x, y in links], "rel_type string, source string, target string, resolved_to string, valid_from long, valid_to long")
        marks = evaluate.Labels.of(spark.createDataFrame([(c, k) for k, cs in bad.items() for c in cs], "case string, key string"))
        asked = spark.createDataFrame([(e, s, p) for s, es in sources.items() for e, p in es.items()], "entry string, source string, pins long")
        hits, passed = traverse.forward(asked.selectExpr("entry as key").distinct(), edges, marks.releases, 4, asked, 10**6)
        counted = hits.join(asked, "entry").join(marks.cases, "label").groupBy("case", "source").agg(F.sum(F.col("ways") * F.col("pins")).alias("n"))
        want, on = naive_forward(links, sources, bad, 4, 10**6)
        assert {(x.case, x.source): x.n for x in counted.collect()} == want
        assert {(x.case, x.release) for x in passed.join(marks.cases, "label").select("case", "release").collect()} == on
        few, _ = traverse.forward(asked.selectExpr("entry as key").distinct(), edges, marks.releases, 4, asked, 2)
        counted = few.join(asked, "entry").join(marks.cases, "label").groupBy("case", "source").agg(F.least(F.sum(F.col("ways") * F.col("pins")), F.lit(2)).alias("n"))
        assert {(x.case, x.source): x.n for x in counted.collect()} == {k: min(v, 2) for k, v in want.items()}


def test_ingest_makes_only_the_tables_that_are_asked_for(spark, sf, monkeypatch):
    p, made, write = Projection.of(spark, sf), [], load.written
    monkeypatch.setattr(load, "written", lambda df, name: (made.append(name), write(df, name))[1])
    found = load.build(samples.packuments(p), p.services, samples.lockfiles(p), samples.advisories(p), versions_kept=samples.KEPT, windows_kept=samples.WINDOWS)
    assert found.graph.affects.count() and made == ["documents", "advisories", "releases", "affects"]
    assert found.graph.dependencies.count() and "pins" not in made and "unmatched" not in made
    assert found.graph.pins.count() and {r.counter: r.n for r in found.counters.collect()}["pins"] == found.graph.pins.count()
    assert made.count("documents") == 1 and not hasattr(found.graph, "nothing")


def test_walks_leave_out_what_no_bad_release_can_be_reached_from(spark, monkeypatch):
    links = [("in@1", "mid@1", 0, 9), ("mid@1", "bad@1", 0, 9), ("mid@1", "side0@1", 0, 9), ("late@1", "in@1", 9, 12), ("far@1", "late@1", 0, 12)]
    links += [(f"side{i}@1", f"side{i + 1}@1", 0, 9) for i in range(4)] + [(f"other{i}@1", "side0@1", 0, 9) for i in range(20)]
    edges = spark.createDataFrame([("DEPENDS_ON", s, d, "1", x, y) for s, d, x, y in links], "rel_type string, source string, target string, resolved_to string, valid_from long, valid_to long")
    marks = evaluate.Labels.of(spark.createDataFrame([("one", "bad@1")], "case string, key string"))
    asked = spark.createDataFrame([(e, "shop", 1) for e in ("in@1", "late@1", "far@1", *(f"other{i}@1" for i in range(20)))], "entry string, source string, pins long")
    walked, write = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name, **more: (walked.append(write(df, name, **more)) if name == "forward" else None) or (walked[-1] if name == "forward" else write(df, name, **more)))
    hits, passed = traverse.forward(asked.selectExpr("entry as key"), edges, marks.releases, 3, asked, 10)
    assert [(x.entry, x.hops, x.ways) for x in hits.collect()] == [("in@1", 2, 1)]
    assert {x.release for x in passed.collect()} == {"in@1", "mid@1", "bad@1"}
    assert {(x.entry, x["head"]) for level in walked for x in level.collect()} == {("in@1", "in@1"), ("in@1", "mid@1"), ("in@1", "bad@1"), ("late@1", "late@1"), ("late@1", "in@1")}
    least = {x["head"]: x.least for x in traverse.nearness(marks.releases, edges, 3).collect()}
    assert least == {"bad@1": 0, "mid@1": 1, "in@1": 2, "late@1": 3}


def test_first_paths_and_chains_build_no_more_than_they_show(spark, saved, monkeypatch):
    graph = Graph.load(spark, saved)
    bad = compromise.bad_by_range(graph, "pkg20")
    every = blast.paths(graph, bad, links=True)
    deepest = every.agg(F.max("hops")).first()[0]
    levels = []
    whole = traverse.prefix_levels
    monkeypatch.setattr(traverse, "prefix_levels", lambda *a, **k: (levels.append(x) or x for x in whole(*a, **k)))
    for cap in (7, 10**6):
        levels.clear()
        found = blast.shown(blast.first_paths(graph, bad, cap=cap), "truncated")
        want = blast.shown(blast.truncated(every, cap), "truncated")
        assert plain(found.toPandas()) == plain(want.toPandas())
        enough = [h for h in range(2, deepest + 1) if every.where(F.col("hops") <= h).count() > cap]
        assert not enough or len(levels) == enough[0] - 1
    for cap in (25, 10**6):
        columns = ["path_id", "service", "hops", "target", "chain", "truncated"]
        few = fix.chains(graph, bad, cap=cap)
        assert plain(fix.numbered(few, cap).select(columns).toPandas()) == plain(fix.numbered(every, cap).select(columns).toPandas())
        assert cap > 100 or few.select("service").distinct().count() <= cap + 1


def test_streaming_advisories(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    doc = {"id": "A-1", "affected": [{"package": {"ecosystem": "npm", "name": "p"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}]}]}
    (source / "a.json").write_text(json.dumps(doc))
    releases = spark.createDataFrame([("p", "1.0.0", "p@1.0.0"), ("p", "2.0.0", "p@2.0.0")], "package string, version string, key string")
    for _ in range(2):
        ingest.write_affects(ingest.advisory_stream(spark, str(source)), releases, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert [r.target for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["p@1.0.0"]
