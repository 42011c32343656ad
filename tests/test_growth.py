"""What tasks hold and exchange mustn't grow faster than the tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from blastgraph import ingest, samples
from blastgraph.functions.coordinates import package_of
from blastgraph.operators import advisories, edges, resolve, traverse
from blastgraph.plans import blast, fix
from blastgraph.queries import QUERIES, bad_of
from blastgraph.sources import lockfiles, packuments, projection
from blastgraph.sources.projection import Projection
from blastgraph.storage import written


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_files_are_read_in_their_row(spark):
    file = "service string, path string, kind string, format_version string, document string, declared array<string>"
    files = spark.createDataFrame([("s", "p", "yarn", "1", "a@1:\n  version 1.0.0\n", None)], file)
    for read in (lockfiles.yarn_classic, lockfiles.yarn_berry, lockfiles.pnpm):
        found = physical(read(files if read is lockfiles.yarn_classic else files.drop("format_version")))
        assert not re.search(r"Exchange|Window|Sort", found), read.__name__


def test_repeated_keys_give_the_first_entry(spark):
    berry = "__metadata:\n  version: 6\na@npm:1:\n  resolution: x\na@npm:1:\n  version: 1.0.0\na@npm:1:\n  version: 2.0.0\n"
    classic = "a@1:\n  version 1.0.0\nb@1:\n  version 3.0.0\na@1:\n  version 2.0.0\n"
    files = spark.createDataFrame([("s", f"{i}/yarn.lock", d, None) for i, d in enumerate((berry, classic))], "service string, path string, document string, manifest string")
    assert sorted((r.path[0], r.name, r.version) for r in lockfiles.pins(files).collect()) == [("0", "a", "1.0.0"), ("1", "a", "1.0.0"), ("1", "b", "3.0.0")]


def test_ranges_are_parsed_once_for_each(spark):
    timeline = spark.createDataFrame([("a", "1.0.0", 1)], "package string, version string, published_at long")
    requests = spark.createDataFrame([("a", "^1.0.0"), ("a", "latest"), ("b", "*")], "package string, range string")
    found = resolve.resolution_windows(timeline, requests)
    assert [(r.package, r.range, r.version) for r in found.collect()] == [("a", "^1.0.0", "1.0.0")]
    below = plan(found).split("ArrowEvalPython")
    assert len(below) == 2 and "Aggregate" in below[1]


def test_walks_over_vertices_exchange_no_distinct_edges(spark, monkeypatch):
    found = []
    keep = traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: (found.append(plan(df)), keep(df, name))[1])
    links = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b")], "source string, target string")
    bad = spark.createDataFrame([("a",)], "key string")
    seen, longest = traverse.spread(bad, links, 3)
    assert sorted(map(tuple, seen.collect())) == [("a", 0), ("b", 1), ("c", 2)] and longest == 2
    assert all(p.count("Aggregate") <= 1 for p in found)


def test_larger_tables_are_dealt_to_more_tasks(spark, sf, monkeypatch):
    few = Projection(spark, sf)
    assert few.tasks == 4
    monkeypatch.setattr(projection, "TASK_BYTES", 20_000)
    many = Projection(spark, sf)
    assert many.tasks > 4
    known = edges.known_endpoints(many.dependencies, many.releases, many.releases, tasks=many.tasks)
    assert "hashpartitioning(source#" in physical(known) and f", {many.tasks})" in physical(known)
    assert many.dependencies.count() == few.dependencies.count()


def test_only_dependencies_that_lead_to_bad_releases_are_resolved(spark, sf):
    p = Projection(spark, sf)
    bad = bad_of(p, 10)
    found, links = p.leading(bad.select("key"), 6)
    counted = blast.ways(p, bad).groupBy("service", "target", "hops", "build_time").agg(F.sum("ways"))
    assert "dependencies" not in p.__dict__
    ends = links.select(F.col("target").alias("t")).distinct()
    every = p.dependencies.join(ends, package_of(F.col("target")) == F.col("t"), "left_semi")
    assert found.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, every.select(*found.columns).collect()))
    prefix = traverse.ways(bad.select("key"), p.dependencies, 6)
    whole = traverse.service_ways(prefix, p.pins, p.lockfiles).groupBy("service", "target", "hops", "build_time").agg(F.sum("ways"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, whole.collect()))


def test_dependencies_of_a_graph_that_lead_to_targets(spark, sf):
    p = Projection(spark, sf)
    graph, bad = p.snapshot(), bad_of(p, 10).select("key")
    ours, theirs = (sorted(map(tuple, g.leading(bad, 6)[0].select("source", "target", "valid_from").collect())) for g in (graph, p))
    assert ours == theirs
    few, _ = graph.leading(bad, 1)
    assert {r.package for r in few.select(package_of(F.col("target")).alias("package")).collect()} == {r.package for r in bad_of(p, 10).collect()}


def test_pins_are_put_together_only_where_chains_begin(spark, sf, monkeypatch):
    p, found = Projection(spark, sf), {}
    keep = traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: (found.setdefault(name, []).append(plan(df)), keep(df, name))[1])
    traverse.service_ways(traverse.ways(bad_of(p, 10).select("key"), p.dependencies, 6), p.pins, p.lockfiles).count()
    (met,) = found["pinned"]
    assert met.index("Aggregate") < met.index("Join LeftSemi")


def test_versions_are_parsed_for_the_packages_of_changes_only(spark, sf):
    p = Projection(spark, sf)
    links = spark.createDataFrame([("c", "pkg1", "1.1.0")], "change string, package string, version string")
    found = plan(fix.upgrades(p, links, bad_of(p)))
    releases = found[found.index("Join Inner") :]
    parsed = [i for i, line in enumerate(releases.splitlines()) if "regexp_extract" in line]
    semi = [i for i, line in enumerate(releases.splitlines()) if "Join LeftSemi" in line]
    assert semi and min(semi) > min(parsed)


def test_plans_look_once_for_what_leads_back(spark, sf, monkeypatch):
    p, asked = Projection(spark, sf), []
    keep = fix.tainted
    monkeypatch.setattr(fix, "tainted", lambda *a: (asked.append(a), keep(*a))[1])
    bad = bad_of(p, 10)
    made = fix.plan(p, fix.chains(p, bad), bad)
    assert made.totals.first().rounds > 1 and len(asked) == 1


def metadata(name, **other):
    body = {"dependencies": {"a": "^1", "b": 5, "c": None, "d": {"x": 1}}, "dist": {"integrity": "", "shasum": "q"}, "deprecated": False, "_npmUser": {"name": "ann"}}
    times = {"1.0.0": "2020-01-01T00:00:00Z", "created": "2019-01-01T00:00:00Z", "bad": "some day", "unpublished": {"a": 1}}
    return {"name": name, "time": times, "versions": {"1.0.0": body, "2.0.0": {}}, "maintainers": [{"name": "bob"}, "tim <t@x>", ""], **other}


def test_documents_are_read_once_whatever_they_hold(spark):
    odd = [
        metadata("list", versions={"1.0.0": {"dependencies": ["x"]}, "2.0.0": {"dependencies": {"a": "*"}, "dist": "text"}}), metadata("text", time="x"), metadata("one", maintainers={"name": "x"}),
        metadata("bodies", versions={"1.0.0": "text", "2.0.0": None, "3.0.0": [1], "4.0.0": {"devDependencies": {"k": "~1"}}}), [metadata("inside")], "text", 7,
    ]
    usual = [metadata("plain"), metadata("plain"), metadata("none", time=None), metadata(5), metadata(None), metadata(""), {}, metadata("null", versions={"1.0.0": {"dependencies": None, "dist": None}})]
    whole = json.dumps(metadata("cut"))
    texts = [*map(json.dumps, odd), whole[:-1], whole[:90], "nonsense", "", *map(json.dumps, usual), " \n" + whole]
    given = spark.createDataFrame([(t,) for t in texts], "document string")
    opened = written(packuments.opened(given), "opened")
    assert opened.where("document is null").count() == len(usual) + 1
    for keep in (0, 1):
        ours, theirs = ingest.reduced(opened, keep), ingest.reduced(given, keep)
        for name in ingest.REDUCED:
            assert sorted(map(repr, ours[name].collect())) == sorted(map(repr, theirs[name].collect())), name
    usually = plan(ingest.reduced(opened)["declared"]).split("\n")
    assert sum("from_json" in line for line in usually if "get_json_object" not in line) == 0


def test_lockfiles_are_read_once_whatever_they_hold(spark, monkeypatch):
    packages = {
        "": {"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"@s/c": "1"}, "optionalDependencies": ["x"]}, "node_modules/a": {"version": "1.0.0", "dependencies": {"q": "1"}},
        "node_modules/a/node_modules/b": {"version": "2.0.0"}, "node_modules/b": {"version": "2.0.0", "link": False}, "node_modules/l": {"link": True, "version": "9"},
        "node_modules/@s/c/": {"version": 3}, "node_modules/al": {"name": "b", "version": "4"}, "node_modules/none": {}, "node_modules/null": None,
    }
    kinds = [packages, {k: v for k, v in packages.items() if k}, packages | {"": None}, packages | {"": {}}, packages | {"": "text"}]
    manifests = [None, '{"dependencies":{"b":"1"}}', '{"dependencies":["b"],"devDependencies":{"a":"1"}}', "{}", "bad"]
    rows = [(str(odd), f"{i}-{j}/package-lock.json", json.dumps({"lockfileVersion": 3, "packages": p | odd}), m) for i, p in enumerate(kinds) for j, m in enumerate(manifests) for odd in ({}, {"node_modules/odd": 5})]
    counted = []
    monkeypatch.setattr(lockfiles, "written", lambda df, name: (counted.append((name, written(df, name))), counted[-1][1])[1])
    found = lockfiles.pins(spark.createDataFrame(rows, "service string, path string, document string, manifest string")).collect()
    pins = {odd: sorted(tuple(r)[1:] for r in found if r.service == odd) for odd in {r[0] for r in rows}}
    assert len(pins) == 2 and len({tuple(x) for x in pins.values()}) == 1 and any(r.direct for r in found)
    opened = dict(counted)["lockfiles"]
    assert opened.where("pins is not null").count() == (len(kinds) - 1) * len(manifests)  # in one pass, but for odd ones


def test_advisories_are_made_and_read_once(spark, sf):
    found = plan(advisories.parse(advisories.read_documents(samples.advisories(Projection(spark, sf)))))
    assert found.count("from_json(StructField(id") == 1 and found.count("CVE-") == 2  # whole, or cut off


def test_plans_are_made_for_all_chains(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(fix, "plan", lambda graph, found, bad, cap=4000: (asked.append(cap), fix.Plan(found, found))[1])
    every = QUERIES["fix_plan"](spark, sf)  # here the chains that it plans for
    n = every.count()
    whole = written(fix.numbered(every, None), "whole")
    assert asked == [None] and n == blast.paths(Projection.of(spark, sf), bad_of(Projection.of(spark, sf), 10)).count()
    few = fix.numbered(every, 25)
    assert n > 25 and few.first().truncated and (whole.count(), whole.where("truncated").count()) == (n, 0)
    assert [tuple(r) for r in few.select("path_id", "chain").orderBy("path_id").collect()] == [tuple(r) for r in whole.select("path_id", "chain").orderBy("path_id").limit(25).collect()]


def test_smallest_choices_in_tasks_equal_those_on_the_driver(spark, monkeypatch):
    sets = [[0], [0, 1], [2, 3], [3, 4], [2, 4], [5, 6], [6, 7], [8, 9, 5], [10, 11], []]
    rows = spark.createDataFrame(list(enumerate(sets)), "row long, set array<long>")
    pairs = rows.select("row", F.explode("set").alias("change"))
    found = []
    for kernel in (100, 0):
        monkeypatch.setattr(fix, "KERNEL", kernel)
        picked, proven = fix._smallest(rows, pairs)
        found.append((sorted(r.change for r in picked.collect()), proven))
    assert found[0] == found[1] and found[0][1] and len(found[0][0]) == 6
    assert all(set(found[0][0]) & set(s) for s in sets if s)
