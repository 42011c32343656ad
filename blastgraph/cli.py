"""Command line: questions over a saved graph.

    python -m blastgraph.cli GRAPH doctor [--edges]
    python -m blastgraph.cli GRAPH probe
    python -m blastgraph.cli GRAPH blast --package lodash [--versions SPEC] [--as-of DATE] [--runtime-only]
    python -m blastgraph.cli GRAPH fix | reach | pivot | typosquat | evaluate ...
    python -m blastgraph.cli GRAPH project TABLES
    python -m blastgraph.cli GRAPH ingest --documents DIR --organisation FILE --repositories DIR --advisories ZIP

``--json FILE`` writes an answer as JSON lines beside showing it. Exit status: 1 where nothing answers to what was asked for, 2 for a wrong call.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest, storage
from .functions.times import moment
from .graph import Graph, census, census_edges, census_totals
from .plans import blast, compromise, evaluate, fix, people
from .sources.projection import Projection
from .sources.seeds import SEEDS


def _bad(graph: Graph, args) -> DataFrame:
    if args.advisory:
        return compromise.known(compromise.bad_by_advisory(graph, args.advisory), args.advisory)
    return compromise.known(compromise.bad_by_range(graph, args.package, args.versions), f"{args.package}@{args.versions}")


def _as_of(spark: SparkSession, text: str | None) -> int | None:
    if not text:
        return None
    value = spark.range(1).select(moment(F.lit(text)).alias("t")).first().t
    if value is None:
        raise SystemExit(2)
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blastgraph")
    p.add_argument("graph", help="folder of a saved graph")
    p.add_argument("--json", help="folder to write the answer to, as JSON lines")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor").add_argument("--edges", action="store_true")
    commands.add_parser("probe")
    commands.add_parser("overview").add_argument("--advisories", action="store_true")
    c = commands.add_parser("ingest")
    for name in ("documents", "organisation", "repositories", "advisories"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--seeds", nargs="*", help="crawl from these packages; without names from popular ones")
    c.add_argument("--depth", type=int, default=3)
    c.add_argument("--max-packages", type=int)
    c.add_argument("--state", help="folder that keeps stages between runs")
    commands.add_parser("project").add_argument("tables")
    for name in ("blast", "fix", "reach"):
        c = commands.add_parser(name)
        c.add_argument("--advisory")
        c.add_argument("--package")
        c.add_argument("--versions", default="*")
        c.add_argument("--as-of")
        c.add_argument("--runtime-only", action="store_true")
        c.add_argument("--paths", type=int, default=25)
    c = commands.add_parser("pivot")
    c.add_argument("package")
    c.add_argument("--limit", type=int, default=15)
    c = commands.add_parser("typosquat")
    c.add_argument("--popular-at", type=int, default=25)
    c.add_argument("--distance", type=int, default=1)
    c.add_argument("--limit", type=int, default=20)
    commands.add_parser("evaluate").add_argument("--limit", type=int, default=20)
    return p


def answer(spark: SparkSession, args) -> DataFrame:
    if args.command == "project":
        Projection(spark, args.tables).snapshot().save(args.graph)
        return census(Graph.load(spark, args.graph))
    if args.command == "ingest":
        seeds = list(SEEDS) if args.seeds == [] else args.seeds
        made = ingest.from_folders(spark, args.documents, args.organisation, args.repositories, args.advisories, seeds, args.depth, args.max_packages, args.state)
        made.graph.save(args.graph)
        return made.counters
    if args.command == "probe":
        return storage.round_trip(spark)
    graph = Graph.load(spark, args.graph)
    if args.command == "doctor":
        rows = census_edges(graph).withColumnRenamed("rel_type", "label") if args.edges else census(graph)
        total = census_totals(graph, args.edges).select(F.lit("all").alias("label"), F.expr("vertices + coalesce(edges, 0)").alias("n"))
        return (census(graph).unionByName(rows) if args.edges else rows).unionByName(total)
    if args.command == "overview":
        return people.latest_advisories(graph) if args.advisories else people.top_packages(graph)
    if args.command == "pivot":
        return people.pivot(graph, args.package, args.limit)
    if args.command == "typosquat":
        return people.typosquat(graph, args.popular_at, args.distance, args.limit)
    if args.command == "evaluate":
        return evaluate.report(graph, args.limit)
    if not args.advisory and not args.package:
        print("name an advisory or a package", file=sys.stderr)
        raise SystemExit(2)
    bad, as_of = _bad(graph, args), _as_of(spark, args.as_of)
    if args.command == "reach":
        return blast.reach(graph, bad, as_of)
    runtime = not args.runtime_only
    if args.command == "fix":
        made = fix.plan(graph, fix.chains(graph, bad, as_of, runtime), bad)
        return made.changes.select("change", "description", "severs", "to_version", "available", "reachable", "upstream").crossJoin(made.totals)  # one row
    found = blast.services(graph, blast.ways(graph, bad, as_of, runtime))
    if args.paths:
        chains = blast.first_chains(blast.paths(graph, bad, as_of, runtime), args.paths)
        found = found.join(chains.groupBy("service").agg(F.sort_array(F.collect_list(F.struct("rank", "chain"))).alias("chains")), "service")  # at most --paths each
    return found.orderBy("shortest", "service")


def show(found: DataFrame) -> None:
    """Every row, one line each, fetched partition by partition."""
    print(*found.columns, sep="\t")
    for row in found.toLocalIterator():
        print(*row, sep="\t")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("blastgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = answer(spark, args)
        if args.json:
            found.write.mode("overwrite").json(args.json)
            found = spark.read.schema(found.schema).json(args.json)
        show(found)
    except compromise.NothingKnown as e:
        print(f"nothing answers to {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
