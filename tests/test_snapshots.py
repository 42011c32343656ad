"""Ingest in stages: taken up again after a crash, brought up to date by what changed, other versions unread."""

from __future__ import annotations

import json
import random

import pytest

from blastgraph import ingest, snapshots
from blastgraph.graph import Graph

NAMES = [f"p{i}" for i in range(12)]


def document(name, seed):
    r = random.Random(f"{name} {seed}")
    versions = [f"{r.randint(1, 2)}.{i}.0" for i in range(r.randint(1, 5))]
    times = {v: f"20{10 + i}-0{r.randint(1, 9)}-01T00:00:00Z" for i, v in enumerate(versions)}
    bodies = {v: {"dependencies": {d: r.choice(["^1.0.0", "*", "^2.0.0", "git://x"]) for d in r.sample([*NAMES, "gone"], 3)}, "devDependencies": {r.choice(NAMES): "*"}} for v in versions}
    return json.dumps({"name": name, "time": times, "versions": bodies, "maintainers": [{"name": f"m{seed}"}]})


def rest(spark):
    services = spark.createDataFrame([("shop", "r", "high")], "name string, repo string, criticality string")
    lock = '{"lockfileVersion":3,"packages":{"node_modules/p1":{"version":"1.0.0"},"node_modules/p2":{"version":"2.0.0"}}}'
    files = spark.createDataFrame([("shop", "package-lock.json", lock, None, 7)], "service string, path string, document string, manifest string, committed_at long")
    found = {"id": "A", "affected": [{"package": {"ecosystem": "npm", "name": n}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}]}]} for n in NAMES]}
    return services, files, spark.createDataFrame([(json.dumps(found),)], "value string")


def docs(spark, seeds):
    return spark.createDataFrame([(document(n, s),) for n, s in seeds.items()], "document string")


def content(made):
    tables = {name: getattr(made.graph, name) for name in Graph.__dataclass_fields__} | {"counters": made.counters, "unmatched": made.unmatched}
    return {name: sorted(map(repr, (r.asDict() for r in t.select(*sorted(t.columns)).collect()))) for name, t in tables.items()}


OPTIONS = {"versions_kept": 3, "windows_kept": 2}


def test_refresh_equals_a_build_of_what_there_is_now(spark, tmp_path):
    folder, others = str(tmp_path / "store"), rest(spark)
    seeds = dict.fromkeys(NAMES[:10], 0)
    for change in ({}, {"p3": 1, "p11": 0, "p1": None}):
        seeds = {n: s for n, s in (seeds | change).items() if s is not None}
        given = docs(spark, seeds)
        made = snapshots.refresh(folder, given, *others, **OPTIONS)
        assert content(made) == content(ingest.build(given, *others, **OPTIONS))
        ledger = snapshots.Ledger(spark, folder)
        touched = {r.package for r in ledger.before("touched").collect()}
        assert touched == (set(change) or set(seeds))
        assert ledger.run is None


def test_a_run_that_died_goes_on_behind_its_last_stage(spark, tmp_path, monkeypatch):
    folder, others, given = str(tmp_path / "store"), rest(spark), docs(spark, dict.fromkeys(NAMES, 0))
    calls = []
    link, tables = ingest.linked, ingest.facts_of

    def dying(*args):
        calls.append("link")
        if len(calls) == 3:
            raise RuntimeError("lost")
        return link(*args)

    monkeypatch.setattr(ingest, "linked", dying)
    with pytest.raises(RuntimeError):
        snapshots.refresh(folder, given, *others, **OPTIONS)
    half = snapshots.Ledger(spark, folder)
    assert half.last is None and {"edges-0", "edges-1"} <= set(half.run["stages"]) and "edges-2" not in half.run["stages"]
    (tmp_path / "store" / "ledger" / "99999998.json").write_text('{"version": 1, "ru')  # cut off while being written
    calls.clear()
    again = []
    monkeypatch.setattr(ingest, "linked", lambda *a: (again.append("link"), link(*a))[1])
    monkeypatch.setattr(ingest, "facts_of", lambda *a: (again.append("facts"), tables(*a))[1])
    made = snapshots.refresh(folder, given, *others, **OPTIONS)
    assert again == ["link"] * (snapshots.BUCKETS - 2)
    assert content(made) == content(ingest.build(given, *others, **OPTIONS))
    assert {k: v for k, v in snapshots.Ledger(spark, folder).last["stages"].items() if k in half.run["stages"]} == half.run["stages"]
    again.clear()
    assert content(snapshots.refresh(folder, given, *others, **OPTIONS)) == content(made) and again == []


def test_other_versions_and_options_begin_anew(spark, tmp_path):
    folder, others, given = str(tmp_path / "store"), rest(spark), docs(spark, dict.fromkeys(NAMES[:6], 0))
    snapshots.refresh(folder, given, *others, **OPTIONS)
    first = snapshots.Ledger(spark, folder).last["stages"]
    made = snapshots.refresh(folder, given, *others, versions_kept=1, windows_kept=2)
    assert content(made) == content(ingest.build(given, *others, versions_kept=1, windows_kept=2))
    written = sorted((tmp_path / "store" / "ledger").iterdir())[-1]
    written.with_name("99999999.json").write_text(json.dumps(json.loads(written.read_text()) | {"version": 99}))
    assert snapshots.Ledger(spark, folder).last is None
    made = snapshots.refresh(folder, given, *others, **OPTIONS)
    assert content(made) == content(ingest.build(given, *others, **OPTIONS))
    assert not set(snapshots.Ledger(spark, folder).last["stages"].values()) & set(first.values())


def test_a_crawl_chooses_the_documents(spark):
    given = docs(spark, dict.fromkeys(NAMES, 0))
    seeds = spark.createDataFrame([("p4", 0), ("p2", 1)], "package string, place long")
    taken, near = ingest.crawl(given, seeds, 2, 5)
    assert taken.count() == 5 and {r.package for r in near.collect()} == {"p4", "p2"}
    made = ingest.build(taken, *rest(spark), dev_packages=near)
    assert {r.name for r in made.graph.packages.collect()} >= {"p4", "p2"}
