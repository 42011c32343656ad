"""Bounded path enumeration over time-bounded edges, counts of paths, and vertex-level reachability.

Paths grow backwards from the few targets, one join per hop. The window of a path (latest start,
earliest end) is intersected at every hop and a path whose window is empty, or doesn't cover the
moment asked for, ends there: both conditions only get stricter along a path, so nothing is lost.
Each hop's frontier is a written table, so lineage stays one hop deep and lost executors cost
one read. Three answers, from dear to cheap: ``prefixes`` builds every chain; ``ways`` counts chains
that agree in ends, hops and window without building them; ``spread`` and ``reaching`` walk
distinct vertices. ``forward`` goes the other way, from each entry on, knows nothing of the targets
until it meets them, and serves as the check of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.coordinates import package_of
from ..storage import written
from .ranks import ranked

LINK = "array<struct<rel_type:string,holder:string,depends_on:string,package:string,version:string,direct:boolean>>"


def live(valid_from: Column, valid_to: Column, as_of: int | None) -> Column:
    """Whether a window can still count: it covers the moment, or isn't empty."""
    return (valid_from < valid_to) if as_of is None else (valid_from <= as_of) & (valid_to > as_of)


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("source").alias("e_source"), F.col("target").alias("head"), "rel_type", F.col("resolved_to").alias("e_version"),
        F.col("valid_from").alias("e_from"), F.col("valid_to").alias("e_to"),
    )


def prefix_levels(targets: DataFrame, edges: DataFrame, hops: int, as_of: int | None = None, links: bool = False, within: DataFrame | None = None) -> Iterator[DataFrame]:
    """``prefixes`` hop by hop; a hop is only walked when it is asked for. within: head, least; chains then
    only grow to heads that are at most so many edges from where they have to begin."""
    start = targets.select(
        F.col("key").alias("target"), F.col("key").alias("head"), F.lit(0).alias("hops"), F.lit(0).cast("bigint").alias("valid_from"),
        F.lit(S.OPEN_END).cast("bigint").alias("valid_to"), F.array("key").alias("keys"), F.lit(False).alias("build_time"), *([F.array().cast(LINK).alias("links")] if links else []),
    )
    step = _steps(edges)
    low, high = F.greatest("valid_from", "e_from"), F.least("valid_to", "e_to")
    link = F.struct(
        F.col("rel_type"), F.col("e_source").alias("holder"), F.col("head").alias("depends_on"),
        package_of(F.col("head")).alias("package"), F.col("e_version").alias("version"), F.lit(False).alias("direct"),
    )

    def near(found: DataFrame, hop: int) -> DataFrame:
        return found if within is None else found.join(within.where(F.col("least") + hop <= hops).select("head"), "head", "left_semi")

    frontier = written(near(start, 0), "frontier")
    yield frontier
    for hop in range(1, hops + 1):
        grown = frontier.join(step, "head").where(~F.array_contains("keys", F.col("e_source")) & live(low, high, as_of))
        grown = grown.select(
            "target", F.col("e_source").alias("head"), F.lit(hop).alias("hops"), low.alias("valid_from"), high.alias("valid_to"),
            F.concat(F.array("e_source"), "keys").alias("keys"), (F.col("build_time") | (F.col("rel_type") == S.DEV_DEPENDS_ON)).alias("build_time"),
            *([F.concat(F.array(link), "links").alias("links")] if links else []),
        )
        frontier = written(near(grown, hop), "frontier")
        if frontier.isEmpty():
            return
        yield frontier


def prefixes(targets: DataFrame, edges: DataFrame, hops: int, as_of: int | None = None, links: bool = False, within: DataFrame | None = None) -> DataFrame:
    """Every simple chain of at most ``hops`` dependency edges that ends in a target.

    targets: key. edges: rel_type, source, target, resolved_to, valid_from, valid_to. Columns:
    target, head, hops, valid_from, valid_to, keys (head first), build_time, and ``links`` where
    asked for. The chain without edges, the target itself, is among them.
    """
    return reduce(DataFrame.unionByName, prefix_levels(targets, edges, hops, as_of, links, within))


def package_links(edges: DataFrame) -> DataFrame:
    """source, target: each pair of packages of which a release of one depends on one of the other, once."""
    return written(edges.select(package_of(F.col("source")).alias("source"), package_of(F.col("target")).alias("target")).distinct(), "links")


def near_packages(targets: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """package of those that an edge of a chain of at most ``hops`` edges to the targets can point to, and of no more than may
    be: a package counts if any of its releases is near enough. targets: key. links: source, target, the packages of all edges."""
    near = nearness(targets.select(package_of(F.col("key")).alias("head")), links, hops)
    return written(near.where(F.col("least") < hops).select(F.col("head").alias("package")), "near-packages")


def linked_to(links: DataFrame, near: DataFrame) -> DataFrame:
    """The links that end in a package of ``near``."""
    return links.join(near.select(F.col("package").alias("target")), "target", "left_semi")


def looping(links: DataFrame, rounds: int = S.BLAST_HOPS) -> DataFrame:
    """package of those that may lie on a cycle of dependencies: the others, which nothing leads to or from any
    more, are taken away round by round. Fewer rounds leave more packages in, never fewer. links: ``package_links``."""
    pairs = links
    left = pairs.count()
    for _ in range(rounds):
        kept = pairs.join(pairs.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = written(kept.join(pairs.select(F.col("source").alias("target")).distinct(), "target", "left_semi"), "looping")
        before, left, pairs = left, kept.count(), kept
        if left in (0, before):
            break
    return pairs.select(F.col("source").alias("package")).union(pairs.select("target")).distinct()


def _met(grown: DataFrame, vertex: str, loops: DataFrame | None) -> DataFrame:
    """``grown`` without walks that come back to a vertex in ``met``, which then holds ``vertex`` too where its package may loop."""
    if loops is None:
        return grown
    simple = grown.where(~F.array_contains("met", F.col(vertex))).withColumn("package", package_of(F.col(vertex)))
    turned = simple.join(loops.select("package", F.lit(True).alias("turns")), "package", "left")
    return turned.withColumn("met", F.when(F.col("turns"), F.array_sort(F.array_append("met", F.col(vertex)))).otherwise(F.col("met"))).drop("package", "turns")


def ways(targets: DataFrame, edges: DataFrame, hops: int, as_of: int | None = None, loops: DataFrame | None = None) -> DataFrame:
    """The chains of ``prefixes``, counted: target, head, hops, valid_from, valid_to, build_time, ways.

    targets: key, and ``label`` where targets that share one are counted together, under the label.
    Chains that agree in these are one row from the hop on where they meet, so a hop's rows don't
    multiply as chains do. A chain can only repeat a vertex that lies on a cycle; ``loops`` (package, of
    all that may, by default ``looping``) says for which vertices, and the target, visits are carried, and nothing
    else, so that every chain counted is simple.
    """
    loops = looping(package_links(edges)) if loops is None else loops
    loops = None if loops.isEmpty() else loops
    group = ["target", "head", "valid_from", "valid_to", "build_time", "met"]
    step, none = _steps(edges), F.array().cast("array<string>")
    start = targets.select(
        F.col("label" if "label" in targets.columns else "key").alias("target"), F.col("key").alias("head"), F.lit(0).cast("bigint").alias("valid_from"), F.lit(S.OPEN_END).cast("bigint").alias("valid_to"),
        F.lit(False).alias("build_time"), (none if loops is None else F.array("key")).alias("met"), F.lit(1).cast("bigint").alias("ways"), F.lit(0).alias("hops"),
    )
    low, high = F.greatest("valid_from", "e_from"), F.least("valid_to", "e_to")
    frontier = written(start, "ways")
    found = [frontier]
    for hop in range(1, hops + 1):
        grown = _met(frontier.join(step, "head").where(live(low, high, as_of)), "e_source", loops)
        moved = grown.select(
            "target", F.col("e_source").alias("head"), low.alias("valid_from"), high.alias("valid_to"),
            (F.col("build_time") | (F.col("rel_type") == S.DEV_DEPENDS_ON)).alias("build_time"), "met", "ways",
        )
        frontier = written(moved.groupBy(*group).agg(F.sum("ways").alias("ways")).withColumn("hops", F.lit(hop)), "ways")
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionByName, found).drop("met")


STATE = ["entry", "head", "valid_from", "valid_to", "met"]


def nearness(targets: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """head, least: the vertices from which some target is at most ``hops`` edges away, time aside, and the fewest
    edges that takes. targets: head."""
    step = edges.select(F.col("source").alias("e_source"), F.col("target").alias("head"))
    seen = frontier = written(targets.select("head").distinct().withColumn("least", F.lit(0)), "near")
    for hop in range(1, hops + 1):
        found = step.join(frontier.select("head"), "head").select(F.col("e_source").alias("head")).distinct()
        frontier = written(found.join(seen, "head", "left_anti").withColumn("least", F.lit(hop)), "near")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def forward(
    entries: DataFrame, edges: DataFrame, marks: DataFrame, hops: int, sources: DataFrame, cap: int, loops: DataFrame | None = None, near: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Chains from each entry on, along edges whose windows meet, to marked vertices.

    entries: key. marks: head, label (a vertex may have several). sources: entry, source, pins: what asks
    for an entry, and how often. (entry, label, hops, ways of every meeting; entry, label, release on the
    chains that met). Walks from one entry that agree in head and window are one row. An entry is
    left when all its sources have met ``cap`` chains under every label they ask for, after the hop at which
    they did: sources meet whole hops, the shortest chains first.

    near: ``nearness`` of the marks, made here by default. A walk only goes on to vertices from which a mark is
    near enough for the hops that are left: others meet none, whatever their windows.
    """
    loops = looping(package_links(edges)) if loops is None else loops
    loops = None if loops.isEmpty() else loops
    near = nearness(marks, edges, hops) if near is None else near
    step = edges.select(F.col("source").alias("head"), F.col("target").alias("e_target"), F.col("valid_from").alias("e_from"), F.col("valid_to").alias("e_to"))
    step = written(step.join(near.select(F.col("head").alias("e_target"), "least").where(F.col("least") < hops), "e_target"), "forward-steps")
    entries = entries.join(near.select(F.col("head").alias("key")), "key", "left_semi")
    low, high = F.greatest("valid_from", "e_from"), F.least("valid_to", "e_to")
    met = F.array().cast("array<string>") if loops is None else F.array("key")
    start = entries.select(F.col("key").alias("entry"), F.col("key").alias("head"), F.lit(0).cast("bigint").alias("valid_from"), F.lit(S.OPEN_END).cast("bigint").alias("valid_to"), met.alias("met"), F.lit(1).cast("bigint").alias("ways"))
    labels = marks.select("label").distinct().count()

    levels = [written(start, "forward")]
    hits: list[DataFrame] = []
    counts = None
    for hop in range(hops + 1):
        here = written(levels[-1].join(marks, "head").groupBy("entry", "label").agg(F.sum("ways").alias("ways")).withColumn("hops", F.lit(hop)), "forward-hits")
        hits.append(here)
        if hop == hops:
            break
        frontier = levels[-1]
        new = here.join(sources, "entry").groupBy("source", "label").agg(F.sum(F.col("ways") * F.col("pins")).alias("n"))
        counts = written(new if counts is None else counts.unionByName(new).groupBy("source", "label").agg(F.sum("n").alias("n")), "forward-counts")
        full = counts.where(F.col("n") >= cap).groupBy("source").agg(F.count(F.lit(1)).alias("labels")).where(F.col("labels") >= labels)
        if not full.isEmpty():
            frontier = frontier.join(sources.join(full, "source", "left_anti").select("entry").distinct(), "entry", "left_semi")
        moved = _met(frontier.join(step.where(F.col("least") < hops - hop), "head").where(low < high), "e_target", loops).select("entry", F.col("e_target").alias("head"), low.alias("valid_from"), high.alias("valid_to"), "met", "ways")
        levels.append(written(moved.groupBy(*STATE).agg(F.sum("ways").alias("ways")), "forward"))
        if levels[-1].isEmpty():
            break
    # Back along the levels, from what was met to where it came from.
    on_chains: list[DataFrame] = []
    good = None
    for level in reversed(levels):
        here = level.join(marks, "head").select(*STATE, "label")
        if good is not None:
            after = good.select("entry", F.col("head").alias("e_target"), F.col("valid_from").alias("low"), F.col("valid_to").alias("high"), F.col("met").alias("met_then"), "label")
            came = _came(level, step, loops).join(after, ["entry", "e_target", "low", "high", "met_then"]).select(*STATE, "label")
            here = here.unionByName(came)
        good = written(here.distinct(), "forward-good")
        on_chains.append(good.select("entry", "label", F.col("head").alias("release")))
    return reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, on_chains).distinct()


def _came(level: DataFrame, step: DataFrame, loops: DataFrame | None) -> DataFrame:
    """Each state of a level with each state it leads to: e_target, low, high, met_then."""
    low, high = F.greatest("valid_from", "e_from"), F.least("valid_to", "e_to")
    reached = _met(level.withColumn("met_before", F.col("met")).join(step, "head").where(low < high), "e_target", loops)
    return reached.select("entry", "head", "valid_from", "valid_to", F.col("met_before").alias("met"), "e_target", low.alias("low"), high.alias("high"), F.col("met").alias("met_then"))


def _pinned(prefix: DataFrame, pins: DataFrame, lockfiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pins of heads alone, and the lockfiles they stand in: repeated entries of a lockfile are only put together, and
    lockfiles only joined to services, where a chain begins."""
    met = written(pins.join(prefix.select(F.col("head").alias("target")).distinct(), "target", "left_semi"), "pinned")
    return met, lockfiles.join(met.select(F.col("source").alias("key")).distinct(), "key", "left_semi")


def service_paths(prefix: DataFrame, pins: DataFrame, lockfiles: DataFrame) -> DataFrame:
    """Chains from services: each prefix whose head is pinned, through the pin and the lockfile.
    Adds service, lockfile, entry, direct; hops, chain and links (where there are some) count both steps."""
    pins, lockfiles = _pinned(prefix, pins, lockfiles)
    pin = pins.select(F.col("source").alias("lockfile"), F.col("target").alias("head"), F.col("version").alias("p_version"), F.col("package").alias("p_package"), F.col("direct").alias("p_direct"))
    owner = lockfiles.select(F.col("key").alias("lockfile"), "path", "service")
    joined = prefix.join(pin, "head").join(owner, "lockfile")
    uses = F.struct(F.lit(S.USES_LOCKFILE).alias("rel_type"), F.col("service").alias("holder"), F.col("path").alias("depends_on"), F.lit("").alias("package"), F.lit("").alias("version"), F.lit(False).alias("direct"))
    pinned = F.struct(F.lit(S.PINS).alias("rel_type"), F.col("path").alias("holder"), F.col("head").alias("depends_on"), F.col("p_package").alias("package"), F.col("p_version").alias("version"), F.col("p_direct").alias("direct"))
    steps = [F.concat(F.array(uses, pinned), "links").alias("links")] if "links" in prefix.columns else []
    return joined.select(
        "service", "lockfile", "target", F.col("head").alias("entry"), (F.col("hops") + 2).alias("hops"), "valid_from", "valid_to",
        (F.col("p_direct") & (F.col("hops") == 0)).alias("direct"), "build_time", F.concat(F.array("service", "path"), "keys").alias("chain"), *steps,
    )


def service_ways(counted: DataFrame, pins: DataFrame, lockfiles: DataFrame) -> DataFrame:
    """``service_paths`` for counted chains: service, target, entry, hops, direct, build_time, ways."""
    once = counted.groupBy("target", "head", "hops", "build_time").agg(F.sum("ways").alias("ways"))
    pins, lockfiles = _pinned(counted, pins, lockfiles)
    pin = pins.select(F.col("source").alias("lockfile"), F.col("target").alias("head"), F.col("direct").alias("p_direct"))
    owner = lockfiles.select(F.col("key").alias("lockfile"), "service")
    return once.join(pin, "head").join(owner, "lockfile").select(
        "service", "target", F.col("head").alias("entry"), (F.col("hops") + 2).alias("hops"), (F.col("p_direct") & (F.col("hops") == 0)).alias("direct"), "build_time", "ways"
    )


def spread(targets: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, int]:
    """head, hops of every vertex and each number of edges at most ``hops`` over which a target is
    reached from it, and the length of the longest simple chain. targets: key; edges: source, target.

    Walks are followed over distinct vertices. One simple chain is carried along for each vertex
    as a witness; only where no witness is left, which takes cycles, are chains enumerated.
    """
    step = edges.select(F.col("source").alias("e_source"), F.col("target").alias("head"))  # repeated ones meet in a vertex
    frontier = written(targets.select(F.col("key").alias("head"), F.array("key").alias("witness"), F.lit(0).alias("hops")), "spread")
    found, longest, witnessed = [frontier], 0, True
    for hop in range(1, hops + 1):
        simple = F.when(~F.array_contains("witness", F.col("e_source")), F.array_append("witness", F.col("e_source")))
        grown = frontier.join(step, "head").select(F.col("e_source").alias("head"), simple.alias("witness"))
        frontier = written(grown.groupBy("head").agg(F.min("witness").alias("witness")).withColumn("hops", F.lit(hop)), "spread")
        seen = frontier.agg(F.count(F.lit(1)).alias("n"), F.count("witness").alias("simple")).first()
        if not seen.n:
            break
        found.append(frontier)
        longest, witnessed = (hop, True) if seen.simple else (longest, False)
    if not witnessed:
        longest = _longest_simple(targets, step, hops)
    return reduce(DataFrame.unionByName, found).select("head", "hops"), longest


def _longest_simple(targets: DataFrame, step: DataFrame, hops: int) -> int:
    frontier = written(targets.select(F.col("key").alias("head"), F.array("key").alias("keys")), "simple")
    for hop in range(1, hops + 1):
        grown = frontier.join(step, "head").where(~F.array_contains("keys", F.col("e_source")))
        # Chains over the same vertices to the same head go on alike.
        frontier = written(grown.select(F.col("e_source").alias("head"), F.array_sort(F.array_append("keys", F.col("e_source"))).alias("keys")).distinct(), "simple")
        if frontier.isEmpty():
            return hop - 1
    return hops


def reaching(sources: DataFrame, targets: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """key of the sources from which some target is at most ``hops`` edges away, time aside.
    sources, targets: key."""
    return sources.select("key").distinct().join(upstream(targets, edges, hops), "key", "left_semi")


def upstream(targets: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """key of all vertices from which some target is at most ``hops`` edges away, time aside. targets: key."""
    step = edges.select("source", "target")
    seen = written(targets.select("key").distinct(), "reached")
    frontier = seen
    for _ in range(hops):
        found = step.join(frontier.withColumnRenamed("key", "target"), "target").select(F.col("source").alias("key")).distinct()
        frontier = written(found.join(seen, "key", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def discover(seeds: DataFrame, declared: DataFrame, known: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """package, depth, place of what a crawl from the seeds meets, breadth first: seeds follow every
    kind of dependency, deeper packages runtime and optional ones. seeds, known: package; seeds come in order
    of ``place`` where they have one, else by name. declared: package, dependency, kind.

    A package queues once, behind the first that names it; the dependencies of one come by name. With
    a budget the crawl takes so many known packages in that order, and a level is cut by what is left of it.
    """
    links = declared.select("package", "dependency", "kind").distinct()
    place = F.col("place") if "place" in seeds.columns else F.lit(0)
    queued = seeds.groupBy("package").agg(F.min(F.struct(place.alias("above"), F.col("package").alias("name"))).alias("queued"))
    taken, seen, level = 0, None, 0
    while True:
        found = queued.join(known, "package", "left_semi")
        if seen is not None:
            found = found.join(seen, "package", "left_anti")
        placed = ranked(found.select("package", F.col("queued.above").alias("above"), F.col("queued.name").alias("name")), F.col("above"), F.col("name"), name="discovered")
        placed = placed.select("package", F.lit(level).alias("depth"), (F.col("_rank") + taken).alias("place"))
        frontier = written(placed if budget is None else placed.where(F.col("place") < budget), "discovered")
        new = frontier.count()
        seen = frontier if seen is None else seen.unionByName(frontier)
        taken, level = taken + new, level + 1
        if not new or level > depth or taken == budget:
            return seen
        follow = links if level == 1 else links.where(F.col("kind").isin("runtime", "optional"))
        named = frontier.select("package", F.col("place").alias("above")).join(follow, "package")
        queued = named.groupBy(F.col("dependency").alias("package")).agg(F.min(F.struct("above", F.col("dependency").alias("name"))).alias("queued"))
