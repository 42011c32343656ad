"""From documents to a graph: package documents, lockfiles with their services, advisories.

``build`` is one declarative plan from parsed tables to a Graph; what several later tables read is
written once, when one of them is first asked for: who asks for edges parses no lockfile. ``snapshots.refresh`` takes the same steps in stages that survive a crash and are brought up to date. ``Ingested.counters`` counts what came in and what was left out, and why.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .graph import Graph
from .operators import advisories as A
from .operators import edges, pins, resolve, traverse
from .sources import lockfiles, packuments
from .storage import written


class Tables(dict):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]]):
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.make[name]()
        return self[name]


class LateGraph(Graph):
    """A graph whose tables are made when they are first asked for."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]]):
        self._make = make

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.__dict__.get("_make", ()):
            raise AttributeError(name)
        self.__dict__[name] = self._make[name]()
        return self.__dict__[name]


class Ingested:
    """The graph; counters: counter, n; unmatched: coordinates pinned by lockfiles but not known."""

    def __init__(self, graph: Graph, counters: Callable[[], DataFrame], unmatched: Callable[[], DataFrame]):
        self.graph, self._counters, self._unmatched = graph, counters, unmatched

    @cached_property
    def counters(self) -> DataFrame:
        return self._counters()

    @cached_property
    def unmatched(self) -> DataFrame:
        return self._unmatched()


def _counted(name: str, rows: DataFrame, what: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if what is None else F.coalesce(F.sum(what.cast("bigint")), F.lit(0))
    return rows.agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("counter"), "n")


#: The tables of ``reduced``.
REDUCED = ("releases", "packages", "people", "timeline", "declared")


def reduced(documents: DataFrame, versions_kept: int = S.VERSIONS_KEPT) -> dict[str, DataFrame]:
    """What later steps need of package documents (opened or not), each package's rows from its own documents alone: releases (the
    latest ``versions_kept``), packages, people, timeline, declared."""
    return {
        "releases": packuments.recent(packuments.releases(documents), versions_kept), "packages": packuments.packages(documents), "people": packuments.maintainers(documents),
        "timeline": packuments.version_times(documents), "declared": packuments.dependencies(documents),
    }


def facts_of(tables: dict[str, DataFrame], dev_packages: DataFrame | None = None) -> DataFrame:
    """source, published_at, dependency, range, kind of what kept releases declare on packages that were crawled."""
    crawled = tables["timeline"].select(F.col("package").alias("dependency")).distinct()
    releases = tables["releases"].select("package", "version", "key", "published_at")
    facts = tables["declared"].join(releases, ["package", "version"]).join(crawled, "dependency", "left_semi")
    if dev_packages is not None:
        near = dev_packages.select("package").distinct().withColumn("near", F.lit(True))
        facts = facts.join(near, "package", "left").where("kind <> 'dev' or near").drop("near")
    return facts.select(F.col("key").alias("source"), "published_at", "dependency", "range", "kind")


def windows_of(facts: DataFrame, timeline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows of the ranges asked for; package, range, parses, met of each: whether it is a range, and has a release)."""
    requests = facts.select(F.col("dependency").alias("package"), "range").distinct()
    windows = written(resolve.resolution_windows(timeline, requests), "windows")
    met = windows.select("package", "range").distinct().withColumn("met", F.lit(True))
    judged = requests.join(resolve.parsed_ranges(requests), "range").join(met, ["package", "range"], "left")
    return windows, judged.select("package", "range", F.col("parsed").isNotNull().alias("parses"), F.coalesce("met", F.lit(False)).alias("met"))


EDGE = ("rel_type", "source", "target", "range", "resolved_to", "kind", "valid_from", "valid_to")


def linked(facts: DataFrame, windows: DataFrame, releases: DataFrame, windows_kept: int = S.WINDOWS_PER_DEPENDENCY) -> DataFrame:
    """Edges with ``written``: those between kept releases once each, the strongest; and those to releases that
    weren't kept."""
    resolved = written(resolve.dependency_edges(facts, windows, windows_kept), "resolved")
    known = edges.strongest(edges.known_endpoints(resolved, releases, releases)).select(*EDGE, F.lit(True).alias("written"))
    return known.unionByName(edges.unwritten_targets(resolved, releases).select(*EDGE, F.lit(False).alias("written")))


def assemble(tables: dict[str, DataFrame], services: DataFrame, files: DataFrame, advisories: DataFrame) -> Ingested:
    """The graph and the counters, each made when it is asked for. tables: those of ``reduced``, and facts, judged, edges."""
    lock = files.select(_path().alias("key"), "path", "service", "committed_at").distinct()

    def publishers() -> DataFrame:
        return tables["releases"].where("publisher <> ''")

    def maintainers() -> DataFrame:
        accounts = tables["people"].select("username", "email").unionByName(publishers().select(F.col("publisher").alias("username"), F.lit("").alias("email")))
        return accounts.groupBy("username").agg(F.max("email").alias("email")).select("username", F.lit("npm").alias("ecosystem"), "email")

    def dependencies() -> DataFrame:
        return tables["edges"].where("written").drop("written")

    @cache
    def read() -> DataFrame:
        return written(lockfiles.pins(files), "pins")

    def found() -> DataFrame:
        return read().select(_path().alias("source"), F.col("name").alias("package"), "version", "direct")

    @cache
    def unmatched() -> DataFrame:
        return written(pins.unmatched(found(), tables["releases"]).select(F.concat_ws("@", "package", "version").alias("coordinate")).distinct(), "unmatched")

    @cache
    def parsed() -> DataFrame:
        return written(A.parse(A.read_documents(advisories)), "advisories")

    def kept() -> DataFrame:
        hit = parsed().join(graph.affects.select("osv_id").distinct(), "osv_id", "left_semi")
        return edges.last_written(hit.select("osv_id", "severity", "published_at", "summary", "cwe", "aliases"), "osv_id", "published_at")

    graph = LateGraph({
        "packages": lambda: tables["packages"], "releases": lambda: tables["releases"].drop("publisher"), "maintainers": maintainers,
        "services": lambda: services.select("name", "repo", "criticality"), "lockfiles": lambda: lock, "advisories": kept,
        "can_publish": lambda: tables["people"].select(F.col("username").alias("maintainer"), "package").distinct(),
        "published": lambda: publishers().select(F.col("publisher").alias("maintainer"), F.col("key").alias("release"), F.col("published_at").alias("at")),
        "pins": lambda: pins.matched(found(), tables["releases"]), "dependencies": dependencies,
        "affects": lambda: written(A.affected_releases(parsed(), tables["releases"]), "affects"),
    })

    def counters() -> DataFrame:
        ids = parsed().select("osv_id").distinct()
        judged, rel = tables["judged"], F.col("rel_type")
        return reduce(DataFrame.unionByName, [
            _counted("declared", tables["facts"]), _counted("unresolvable_ranges", judged, ~F.col("parses")), _counted("unsatisfied_ranges", judged, F.col("parses") & ~F.col("met")),
            _counted("unwritten_targets", tables["edges"], ~F.col("written")),
            _counted("depends_on", graph.dependencies, rel == S.DEPENDS_ON), _counted("dev_depends_on", graph.dependencies, rel == S.DEV_DEPENDS_ON),
            _counted("packages", graph.packages), _counted("releases", tables["releases"]), _counted("maintainers", graph.maintainers), _counted("services", services), _counted("lockfiles", lock),
            _counted("pins", graph.pins), _counted("direct_pins", read(), F.col("direct")), _counted("unmatched_pins", unmatched()),
            _counted("advisory_records", advisories), _counted("advisory_malformed", advisories, A.malformed(F.col("value"))), _counted("advisories_parsed", ids),
            _counted("advisories", graph.advisories), _counted("advisories_out_of_scope", ids.join(graph.advisories, "osv_id", "left_anti")), _counted("affects", graph.affects),
        ])

    return Ingested(graph, counters, unmatched)


def _path() -> Column:
    return F.concat_ws(":", "service", "path")


def build(
    documents: DataFrame, services: DataFrame, files: DataFrame, advisories: DataFrame, dev_packages: DataFrame | None = None,
    versions_kept: int = S.VERSIONS_KEPT, windows_kept: int = S.WINDOWS_PER_DEPENDENCY,
) -> Ingested:
    """documents: document (package metadata). services: name, repo, criticality. files: service,
    path, document, manifest, committed_at. advisories: value (JSON text). dev_packages: the packages
    whose development dependencies count, all where there is none."""
    documents = written(packuments.opened(documents), "documents")  # each of the tables below reads them
    made = reduced(documents, versions_kept)
    tables = Tables({name: (lambda name=name: made[name] if name == "declared" else written(made[name], name)) for name in made})

    @cache
    def resolved() -> tuple[DataFrame, DataFrame]:
        return windows_of(tables["facts"], tables["timeline"])

    tables.make |= {
        "facts": lambda: written(facts_of(tables, dev_packages), "declared"), "judged": lambda: written(resolved()[1], "judged"),
        "edges": lambda: written(linked(tables["facts"], resolved()[0], tables["releases"], windows_kept), "dependencies"),
    }
    return assemble(tables, services, files, advisories)


def crawl(documents: DataFrame, seeds: DataFrame, depth: int, budget: int | None = None, dev_horizon: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents of the packages that a crawl from the seeds takes; those of them within the horizon, whose
    development dependencies count). seeds: package, and place where they have an order."""
    named = documents.select(F.get_json_object("document", "$.name").alias("package"), "document")
    declared = packuments.dependencies(documents).select("package", "dependency", "kind")
    taken = written(traverse.discover(seeds, declared, named.select("package").distinct(), depth, budget), "crawled")
    return named.join(taken.select("package"), "package", "left_semi").select("document"), taken.where(F.col("depth") <= dev_horizon).select("package")


def from_folders(
    spark: SparkSession, documents: str, organisation: str, repositories: str, archive: str, seeds: list[str] | None = None, depth: int = 3, budget: int | None = None, folder: str | None = None, **options,
) -> Ingested:
    """The same from files: package documents (JSON, one per file), an organisation manifest, the
    folder its services' paths are under, and an archive or folder of advisories. With seeds only what a crawl from
    them takes; with a folder in stages that are taken up again and brought up to date (``snapshots``)."""
    from .sources import archives, org

    services = written(org.read(spark, organisation), "services")
    found = lockfiles.read_with_manifests(spark, repositories)
    at = F.regexp_replace(F.concat(F.lit(repositories.rstrip("/") + "/"), "path"), "^file:/*", "/")
    owner = services.select(F.col("name").alias("service"), at.alias("folder"), "committed_at")
    files = found.withColumn("folder", F.regexp_replace(F.col("folder"), "^file:/*", "/")).join(owner, "folder").select("service", "path", "document", "manifest", "committed_at")
    read = packuments.read(spark, documents)
    if seeds is not None:
        order = spark.createDataFrame([(name, i) for i, name in enumerate(seeds)], "package string, place long")
        read, options["dev_packages"] = crawl(read, order, depth, budget)
    if folder is not None:
        from .snapshots import refresh

        return refresh(folder, read, services, files, archives.read(spark, archive), **options)
    return build(read, services, files, archives.read(spark, archive), **options)
