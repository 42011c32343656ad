"""The registered queries over the projected graph, each beside its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest, samples, snapshots
from . import oracle as O
from . import schema as S
from .functions import coordinates, distance, semver, times
from .graph import census, census_edges, census_totals
from .operators import advisories, edges, names, pins, resolve, traverse
from .plans import blast, compromise, evaluate, fix, people
from .sources import lockfiles, packuments
from .sources.projection import Projection, package_name
from .storage import shared_folder, written

#: Demonstration parameters: a moment, the typosquat radar's threshold, the share for chain lists.
AS_OF = 915_148_800
POPULAR = 5
NEAR = 10

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Projection under its name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Projection.of(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def bad_of(p: Projection, share: int = 40) -> DataFrame:
    """Every release of the demonstration's package."""
    return compromise.bad_by_range(p.graph(), p.middle_package(share))


# Scans, dimensions, counts


@query("SELECT c_name AS name, c_mktsegment AS criticality FROM customer")
def scan_services(p):
    return p.services.select("name", "criticality")


@query(O.plain("SELECT package AS name, dependents FROM depc"))
def scan_packages(p):
    return p.graph().dependents().withColumnRenamed("package", "name")


@query(O.plain("SELECT package, version, key FROM rel"))
def release_index(p):
    return p.releases.where("package <> '' and version <> ''").select("package", "version", "key")


@query(O.plain("SELECT count(*) AS n FROM rel"))
def release_count(p):
    return p.releases.agg(F.count(F.lit(1)).alias("n"))


@query(O.plain("SELECT key, version, published_at FROM bad"))
def releases_of_package(p):
    return compromise.releases_of(p.graph(), p.middle_package()).select("key", "version", "published_at")


@query(O.plain("SELECT osv_id, severity, published_at FROM adv WHERE osv_id = (SELECT min(osv_id) FROM adv)"))
def advisory_header(p):
    rows = p.advisories
    first = rows.agg(F.min("osv_id").alias("osv_id"))
    return rows.join(first, "osv_id", "left_semi").select("osv_id", "severity", "published_at")


@query(O.plain("SELECT name, 'npm' AS ecosystem, coalesce((SELECT min(published_at) FROM rel WHERE package = name), 0) AS first_published FROM parts"))
def packages_dim(p):
    return p.packages


@query(O.plain("SELECT key, package, version, published_at, '' AS integrity, FALSE AS deprecated FROM rel"))
def releases_dim(p):
    return p.releases


@query("SELECT s_name AS username, 'npm' AS ecosystem, '' AS email FROM supplier")
def maintainers_dim(p):
    return p.maintainers


@query(O.plain("""SELECT 'Package' AS label, count(*) AS n FROM parts UNION ALL SELECT 'Release', count(*) FROM rel UNION ALL SELECT 'Maintainer', count(*) FROM supplier
    UNION ALL SELECT 'Service', count(*) FROM customer UNION ALL SELECT 'Lockfile', count(*) FROM lock UNION ALL SELECT 'Advisory', count(*) FROM adv"""))
def census_labels(p):
    return census(p.graph())


QUERIES["census"], ORACLE_SQL["census"] = QUERIES.pop("census_labels"), ORACLE_SQL.pop("census_labels")


@query(O.plain("""SELECT 'VERSION_OF' AS rel_type, count(*) AS n FROM rel UNION ALL SELECT 'DEPENDS_ON', count(*) FROM dep WHERE rel_type = 'DEPENDS_ON'
    UNION ALL SELECT 'DEV_DEPENDS_ON', count(*) FROM dep WHERE rel_type = 'DEV_DEPENDS_ON' UNION ALL SELECT 'CAN_PUBLISH', count(*) FROM can
    UNION ALL SELECT 'PUBLISHED', count(*) FROM rel UNION ALL SELECT 'USES_LOCKFILE', count(*) FROM lock UNION ALL SELECT 'PINS', count(*) FROM pins
    UNION ALL SELECT 'AFFECTS', count(*) FROM affects"""))
def edge_census(p):
    return census_edges(p.graph())


QUERIES["census_edges"], ORACLE_SQL["census_edges"] = QUERIES.pop("edge_census"), ORACLE_SQL.pop("edge_census")


@query(O.plain("""SELECT vertices, edges, vertices = 0 AS is_empty, TRUE AS counted_everything FROM (SELECT
    (SELECT count(*) FROM parts) + (SELECT count(*) FROM rel) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM lock) + (SELECT count(*) FROM adv) AS vertices,
    2 * (SELECT count(*) FROM rel) + (SELECT count(*) FROM dep) + (SELECT count(*) FROM can) + (SELECT count(*) FROM lock) + (SELECT count(*) FROM pins) + (SELECT count(*) FROM affects) AS edges)"""))
def census_total(p):
    return census_totals(p.graph())


@query(O.plain("SELECT (SELECT count(*) FROM decl) AS declared, (SELECT count(*) FROM dep) AS edges, (SELECT count(*) FROM pins) AS pins, (SELECT count(DISTINCT osv_id) FROM affects) AS matched_advisories"))
def ingest_stats(p):
    def n(df, name, what=F.lit(1)):
        return df.agg(F.count(what).alias(name))

    out = n(p.declared, "declared")
    for part in (n(p.dependencies, "edges"), n(p.pins, "pins"), p.affects.agg(F.countDistinct("osv_id").alias("matched_advisories"))):
        out = out.crossJoin(part)  # single rows
    return out


# Resolution and edges


@query(O.plain("SELECT package, '*' AS range, version, valid_from, valid_to FROM win WHERE part IN (SELECT dep FROM decl)"))
def resolution_windows(p):
    return p.windows


@query(O.plain("SELECT rel_type, source, target, range, resolved_to, kind, valid_from, valid_to FROM dep"))
def depends_on_edges(p):
    return p.dependencies.select("rel_type", "source", "target", "range", "resolved_to", "kind", "valid_from", "valid_to")


@query(O.plain("SELECT key, package, version, published_at FROM rel QUALIFY row_number() OVER (PARTITION BY package ORDER BY published_at DESC, version DESC) <= 3"))
def recent_releases(p):
    return packuments.recent(p.releases, 3).select("key", "package", "version", "published_at")


@query(O.plain("SELECT package, dependents FROM depc"))
def dependent_counts(p):
    return p.graph().dependents()


@query(O.plain("""SELECT source, target, CASE min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END) WHEN 0 THEN 'runtime' WHEN 2 THEN 'optional' ELSE 'dev' END AS kind
    FROM (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_returnflag FROM lineitem) GROUP BY source, target"""))
def edge_precedence(p):
    kind = F.when(F.col("l_returnflag") == "A", "runtime").when(F.col("l_returnflag") == "N", "optional").otherwise("dev")
    rows = p.table("lineitem").select(
        F.lit(S.DEPENDS_ON).alias("rel_type"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"),
        kind.alias("kind"), F.col("l_linenumber").alias("ordinal"), F.lit(0).alias("valid_from"),
    )
    return edges.strongest(rows).select("source", "target", "kind")


@query("SELECT l_orderkey AS id, max(l_shipdate) AS written FROM lineitem GROUP BY l_orderkey")
def upsert_dedupe(p):
    rows = p.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("written"))
    return edges.last_written(rows, "id", "written")


@query(O.plain("SELECT source, target, resolved_to FROM dep WHERE target IN (SELECT key FROM rel WHERE ln <= 3) AND source IN (SELECT key FROM rel WHERE ln >= 2)"))
def edge_endpoint_semi(p):
    rel = p.releases
    number = F.regexp_extract("version", r"^1\.(\d+)", 1).cast("int")
    return edges.known_endpoints(p.dependencies, rel.where(number >= 2), rel.where(number <= 3), tasks=p.tasks).select("source", "target", "resolved_to")


@query(O.plain("SELECT source, target FROM dep WHERE target NOT IN (SELECT key FROM rel WHERE ln <= 3)"))
def unwritten_targets(p):
    number = F.regexp_extract("version", r"^1\.(\d+)", 1).cast("int")
    return edges.unwritten_targets(p.dependencies, p.releases.where(number <= 3)).select("source", "target")


@query(O.plain("SELECT count(*) AS declared, CAST(0 AS BIGINT) AS not_ranges FROM decl"))
def resolve_counters(p):
    return resolve.resolve_counters(p.requests)


@query(O.plain("SELECT source, target FROM dep WHERE rel_type = 'DEV_DEPENDS_ON' AND source IN (SELECT key FROM rel WHERE part <= (SELECT max(p_partkey) // 10 FROM part))"))
def dev_horizon(p):
    """Development edges of the packages within the horizon only: the seeds, a tenth of the parts."""
    near = p.raw_releases.crossJoin(p.table("part").agg(F.max("p_partkey").alias("top"))).where("part <= floor(top / 10)")  # one row
    dev = p.dependencies.where(F.col("rel_type") == S.DEV_DEPENDS_ON)
    return dev.join(near.select(F.col("key").alias("source")), "source", "left_semi").select("source", "target")


@query(O.base() + f"""links AS (SELECT DISTINCT r.package, {O.name('d.dep')} AS dependency, d.kind FROM decl d JOIN rel r ON r.key = d.source),
    walk AS (SELECT DISTINCT package, 0 AS depth FROM rel WHERE part = (SELECT max(p_partkey) FROM part)
        UNION SELECT l.dependency, w.depth + 1 FROM walk w JOIN links l ON l.package = w.package WHERE w.depth < 4 AND (w.depth = 0 OR l.kind = 'runtime'))
    SELECT package, CAST(min(depth) AS BIGINT) AS depth FROM walk WHERE package IN (SELECT package FROM rel) GROUP BY package""")
def discover(p):
    known = p.packages.select(F.col("name").alias("package"))
    top = p.table("part").agg(F.max("p_partkey").alias("part"))
    seeds = p.raw_releases.join(top, "part", "left_semi").select("package").distinct()
    declared = p.declared.select(coordinates.package_of(F.col("source")).alias("package"), "dependency", "kind")
    return traverse.discover(seeds, declared, known, 4).select("package", F.col("depth").cast("bigint").alias("depth"))


@query(O.base() + f"""links AS (SELECT DISTINCT r.package, {O.name('d.dep')} AS dependency, d.kind FROM decl d JOIN rel r ON r.key = d.source),
    seeds AS (SELECT DISTINCT package, part FROM rel WHERE part % 10 = 9),
    walk AS (SELECT package, 0 AS depth, [lpad(((SELECT max(part) FROM seeds) - part)::VARCHAR, 12, '0')] AS path FROM seeds
        UNION ALL SELECT l.dependency, w.depth + 1, list_append(path, l.dependency) FROM walk w JOIN links l ON l.package = w.package
        WHERE w.depth < 3 AND (w.depth = 0 OR l.kind = 'runtime') AND w.package IN (SELECT package FROM rel)),
    first AS (SELECT package, min({{'depth': depth, 'path': path}}) AS best FROM walk WHERE package IN (SELECT package FROM rel) GROUP BY package),
    placed AS (SELECT package, row_number() OVER (ORDER BY best) - 1 AS place, best.depth AS depth FROM first)
    SELECT package, CAST(depth AS BIGINT) AS depth, place FROM placed WHERE place < (SELECT count(*) FROM part) // 5""")
def discover_budget(p):
    """A crawl from every tenth package, the last first, that stops within a level at a fifth of the packages."""
    known = p.packages.select(F.col("name").alias("package"))
    tenth = p.raw_releases.where("part % 10 = 9").select("package", "part").distinct()
    seeds = tenth.select("package", (-F.col("part")).alias("place"))
    declared = p.declared.select(coordinates.package_of(F.col("source")).alias("package"), "dependency", "kind")
    return traverse.discover(seeds, declared, known, 3, p.table("part").count() // 5).select("package", F.col("depth").cast("bigint").alias("depth"), "place")


# Compromise, blast, reach


@query(O.plain("SELECT package, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, '' AS fixed_in, min(published_at) AS introduced_at, count(*) AS releases FROM bad GROUP BY package"))
def compromise_range(p):
    return compromise.summary(compromise.known(bad_of(p), "package"))


@query(O.plain("""SELECT package, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, any_value(fixed_in) AS fixed_in,
    (SELECT min(r.published_at) FROM rel r JOIN affects b ON b.target = r.key WHERE b.osv_id = (SELECT min(osv_id) FROM affects)) AS introduced_at, count(*) AS releases
    FROM affects WHERE osv_id = (SELECT min(osv_id) FROM affects) GROUP BY package"""))
def compromise_advisory(p):
    graph = p.graph()
    first = graph.affects.agg(F.min("osv_id").alias("m")).first().m
    return compromise.summary(compromise.bad_by_advisory(graph, first))


@query(O.plain("""SELECT f.osv_id, 'defect in ' || a.package AS summary, any_value(f.severity) AS severity, any_value(f.published_at) AS published_at, a.package,
    array_to_string(list_sort(list(DISTINCT a.version)), ',') AS versions, any_value(a.fixed_in) AS fixed_in,
    (SELECT min(r.published_at) FROM rel r JOIN affects b ON b.target = r.key WHERE b.osv_id = f.osv_id) AS introduced_at, count(*) AS releases, FALSE AS unfixed
    FROM affects a JOIN adv f USING (osv_id) WHERE f.osv_id = (SELECT max(osv_id) FROM affects) GROUP BY f.osv_id, a.package"""))
def compromise_answer(p):
    """What an advisory is about, and what it affects."""
    graph = p.graph()
    return compromise.answer(graph, graph.affects.agg(F.max("osv_id").alias("m")).first().m)


@query(samples.SQL + f"""SELECT osv_id, {O.name('part')} AS package, event_id % 3 = 1 AS unfixed, CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END AS intervals FROM madv""")
def advisory_unfixed(p):
    """Whether some interval of an advisory has no fix; events as in ``advisory_events``."""
    rows = p.table("events").where("event_type = 'error'").withColumn("k", F.from_json("props", "k int")["k"])
    number, parts = F.col("event_id"), p.table("part").agg(F.count(F.lit(1)).alias("parts"))
    kind = F.when(number % 3 == 0, "fixed").when(number % 3 == 1, "last_affected").otherwise("introduced")
    second = F.when(number % 3 == 2, F.array(F.create_map(F.lit("fixed"), F.lit("1.1.0")), F.create_map(F.lit("introduced"), F.lit("2.0.0")), F.create_map(F.lit("fixed"), F.lit("2.1.0"))))
    events = F.coalesce(second, F.array(F.create_map(kind, samples._at(samples.VERSIONS, 2 + F.col("k") % 5))))
    whole = F.to_json(F.concat(F.array(F.create_map(F.lit("introduced"), F.lit("1.0.0"))), events))
    folded = advisories.fold_events(F.from_json(whole, f"array<{advisories.EVENT}>"))
    found = rows.crossJoin(F.broadcast(parts)).select(F.concat(F.lit("A-"), number).alias("osv_id"), package_name(number % F.col("parts")).alias("package"), folded.alias("intervals"))  # one row
    return found.select("osv_id", "package", advisories.unfixed(F.col("intervals")).alias("unfixed"), F.size("intervals").alias("intervals"))


@query(O.blast() + f"SELECT valid_to = {O.OPEN_END} AS open_ended, count(*) AS paths FROM paths GROUP BY 1")
def blast_open_ended(p):
    """Chains whose window is still open, and others."""
    return blast.paths(p.graph(), bad_of(p)).groupBy(blast.open_ended().alias("open_ended")).agg(F.count(F.lit(1)).alias("paths"))


@query(O.blast() + "SELECT CAST(coalesce(max(hops), 0) AS BIGINT) AS depth, coalesce(max(hops), 0) BETWEEN 1 AND 7 AS shortened FROM paths")
def blast_shortened(p):
    return blast.shortened(blast.ways(p.graph(), bad_of(p)))


@query(O.blast() + """SELECT p.service, count(*) AS paths, CASE WHEN any_value(c_custkey) % 3 = 0 OR any_value(c_custkey) % 3 = 1 THEN 'unknown' ELSE any_value(c_mktsegment) END AS criticality
    FROM paths p JOIN customer ON c_name = p.service GROUP BY p.service""")
def blast_criticality(p):
    """Services of which a third have no criticality and a third an empty one."""
    number = F.col("c_custkey") % 3
    named = p.table("customer").select(F.col("c_name").alias("name"), F.when(number == 1, "").when(number == 2, F.col("c_mktsegment")).alias("criticality"))
    graph = p.graph()
    found = blast.services(SimpleNamespace(services=named), blast.ways(graph, bad_of(p)))
    return found.select("service", "paths", "criticality")


@query(O.plain("SELECT key, package, version FROM rel"))
def release_keys(p):
    """The two halves of every release's key."""
    return p.releases.select("key", coordinates.package_of(F.col("key")).alias("package"), coordinates.version_of(F.col("key")).alias("version"))


@query(O.blast() + O.SHOWN)
def blast_paths(p):
    return blast.shown(blast.paths(p.graph(), bad_of(p)))


@query(O.blast() + "SELECT count(*) AS paths, count(DISTINCT service) AS services, CAST(max(hops) AS BIGINT) AS deepest FROM paths")
def blast_radius(p):
    return blast.radius(blast.ways(p.graph(), bad_of(p)))


QUERIES["blast"], ORACLE_SQL["blast"] = QUERIES.pop("blast_radius"), ORACLE_SQL.pop("blast_radius")


@query(O.blast(as_of=AS_OF) + O.SHOWN)
def blast_as_of(p):
    return blast.shown(blast.paths(p.graph(), bad_of(p), as_of=AS_OF))


@query(O.blast(build=False) + O.SHOWN)
def blast_no_build(p):
    return blast.shown(blast.paths(p.graph(), bad_of(p), include_build=False))


@query(O.blast() + O.SERVICES)
def blast_services(p):
    graph = p.graph()
    return blast.services(graph, blast.ways(graph, bad_of(p)))


@query(O.blast() + O.SHOWN.replace(" FROM paths", ", (SELECT count(*) FROM paths) > 100 AS truncated FROM paths") + " ORDER BY hops, service, target, chain LIMIT 100")
def blast_truncated(p):
    return blast.shown(blast.first_paths(p.graph(), bad_of(p), cap=100), "truncated")


@query(O.blast() + """SELECT service, CAST(rank AS BIGINT) AS rank, CAST(hops AS BIGINT) AS hops, target, chain FROM (
    SELECT *, row_number() OVER (PARTITION BY service ORDER BY hops, target, chain) AS rank FROM paths) WHERE rank <= 25""")
def blast_first_chains(p):
    return blast.first_chains(blast.paths(p.graph(), bad_of(p)), 25).withColumn("hops", F.col("hops").cast("bigint")).withColumn("rank", F.col("rank").cast("bigint"))


@query(O.base() + O.prefixes(6) + " SELECT target, head, CAST(hops AS BIGINT) AS hops, valid_from, valid_to, array_to_string(keys, ' > ') AS chain FROM pre")
def paths_msp(p):
    found = traverse.prefixes(bad_of(p).select("key"), p.dependencies, 6)
    return found.select("target", "head", F.col("hops").cast("bigint").alias("hops"), "valid_from", "valid_to", F.array_join("keys", " > ").alias("chain"))


def _reach(live: str) -> str:
    return O.base() + O.prefixes(6, "d.rel_type = 'DEPENDS_ON'", live) + """ SELECT (SELECT count(DISTINCT head) FROM pre WHERE head NOT IN (SELECT key FROM bad)) AS releases,
    (SELECT count(DISTINCT r.package) FROM pre JOIN rel r ON r.key = pre.head WHERE r.package NOT IN (SELECT package FROM bad)) AS packages, (SELECT CAST(max(hops) AS BIGINT) FROM pre) AS max_depth"""


@query(_reach("TRUE"))
def reach(p):
    return blast.reach(p.graph(), bad_of(p))


@query(_reach(f"greatest(p.valid_from, d.valid_from) <= {AS_OF} AND least(p.valid_to, d.valid_to) > {AS_OF}"))
def reach_as_of(p):
    return blast.reach(p.graph(), bad_of(p), as_of=AS_OF)


@query(O.base() + """up AS (SELECT key, 0 AS depth FROM bad UNION SELECT d.source, u.depth + 1 FROM up u JOIN dep d ON d.target = u.key AND d.rel_type = 'DEPENDS_ON' WHERE u.depth < 4)
    SELECT DISTINCT key FROM up""")
def upgrade_reaching(p):
    runtime = p.dependencies.where(F.col("rel_type") == S.DEPENDS_ON)
    return traverse.reaching(p.releases.select("key"), bad_of(p).select("key"), runtime, S.UPGRADE_HOPS)


@query(O.base() + O.prefixes(6, "d.rel_type = 'DEPENDS_ON'", "TRUE") + """ SELECT r.package, CAST(min(hops) AS BIGINT) AS hops FROM pre JOIN rel r ON r.key = pre.head
    WHERE hops > 0 AND r.package NOT IN (SELECT package FROM bad) GROUP BY r.package""")
def reach_packages(p):
    return blast.reach_packages(p.graph(), bad_of(p))


# Fix

_NUMBERED = """, first AS (SELECT *, min(hops) OVER (PARTITION BY service) AS shortest FROM paths), numbered AS (
    SELECT *, row_number() OVER (ORDER BY shortest, service, hops, target, chain) - 1 AS path_id FROM first QUALIFY path_id < 4000),
hops_on AS (
    SELECT path_id, 'PINS' AS rel_type, path AS holder, entry AS depends_on, pin_version AS version FROM numbered
    UNION ALL SELECT path_id, l.rel_type, l.holder, l.depends_on, l.version FROM (SELECT path_id, unnest(links) AS l FROM numbered)) """


def _chains(p: Projection) -> DataFrame:
    """The chains that plans are made for."""
    return fix.chains(p.graph(), bad_of(p, NEAR))


@query(O.blast(share=NEAR) + _NUMBERED + "SELECT rel_type, holder, depends_on, version, count(DISTINCT path_id) AS severs, rel_type = 'PINS' AS mine FROM hops_on GROUP BY rel_type, holder, depends_on, version")
def chokepoint_candidates(p):
    return fix.changes(fix.numbered(_chains(p))).select("rel_type", "holder", "depends_on", "version", "severs", "mine")


@query(O.blast(share=NEAR) + _NUMBERED + """, widest AS (SELECT rel_type, holder, depends_on, version, count(DISTINCT path_id) AS n FROM hops_on GROUP BY ALL),
    avoided AS (SELECT * FROM widest WHERE n = (SELECT max(n) FROM widest))
    SELECT CASE rel_type WHEN 'PINS' THEN concat_ws(' ', 'move our pin of', depends_on, 'in', holder) ELSE concat_ws(' ', 'ask', holder, 'to move off', depends_on) END AS description,
        count(DISTINCT path_id) AS severs FROM hops_on ANTI JOIN avoided USING (rel_type, holder, depends_on, version) GROUP BY rel_type, holder, depends_on, version""")
def fix_offered(p):
    """Every change in words, without those that cut most chains, which are ruled out."""
    paths = fix.written(fix.numbered(_chains(p)), "fix-paths")
    every = fix.written(fix.changes(paths), "fix-changes")
    most = every.agg(F.max("severs").alias("severs"))
    offered = fix.offered(paths, every.join(most, "severs", "left_semi"))
    return offered.select(fix.description().alias("description"), "severs")


@query(O.blast() + "SELECT count(*) AS naive FROM (SELECT DISTINCT service, target FROM paths)")
def naive_cost(p):
    return fix.naive_cost(blast.ways(p.graph(), bad_of(p)))


@query()
def fix_remediate(p):
    """The chosen changes. The choice is a search, which SQL can't say; ``fix_coverage`` checks what it achieves."""
    return fix.choose(fix.numbered(_chains(p))).changes


@query(O.blast(share=NEAR) + _NUMBERED + """SELECT service, count(*) AS paths, count(*) AS cut, CAST(0 AS BIGINT) AS left_over FROM numbered GROUP BY service""")
def fix_coverage(p):
    """For each service its chains and those that a chosen change lies on: all of them."""
    paths = fix.written(fix.numbered(_chains(p)), "fix-paths")
    cut = fix.severed_paths(paths, fix.choose(paths).changes)
    n = F.count(F.when(F.col("cut"), 1))
    return cut.groupBy("service").agg(F.count(F.lit(1)).alias("paths"), n.alias("cut"), (F.count(F.lit(1)) - n).alias("left_over"))


@query(O.blast(share=NEAR) + _NUMBERED + """SELECT count(*) AS paths, count(*) AS severed, count(DISTINCT (service, target)) AS naive, TRUE AS no_more_than_naive,
    (SELECT count(*) FROM paths) > 4000 AS truncated, (SELECT count(*) FROM paths) <= 4000 AS complete FROM numbered""")
def fix_totals(p):
    totals = fix.choose(fix.numbered(_chains(p))).totals
    return totals.select("paths", "severed", "naive", (F.col("changes") <= F.col("naive")).alias("no_more_than_naive"), "truncated", "complete")


@query()
def fix_plan(p):
    """The changes with their verified upgrades, chosen anew around dead ends, for all chains."""
    return _whole_plan(p).changes


@query()
def fix_plan_totals(p):
    return _whole_plan(p).totals


def _whole_plan(p: Projection) -> fix.Plan:
    bad = bad_of(p, NEAR)
    return fix.plan(p.graph(), fix.chains(p.graph(), bad, cap=None), bad, cap=None)


def _pin_links(p: Projection) -> DataFrame:
    """Every direct pin as a change of our own."""
    pinned = p.pins.where("direct").select("package", "version").distinct()
    return pinned.select(F.concat_ws("@", "package", "version").alias("change"), F.lit(True).alias("mine"), "package", "version")


_LINKS = """links AS (SELECT DISTINCT package || '@' || version AS change, package, version, CAST(split_part(version, '.', 2) AS INTEGER) AS ln FROM pins WHERE direct),
    ups AS (SELECT l.change, r.package, r.key, r.version AS to_version, row_number() OVER (PARTITION BY l.change ORDER BY r.ln) AS rank
        FROM links l JOIN rel r ON r.package = l.package AND r.ln > l.ln WHERE r.key NOT IN (SELECT key FROM bad) QUALIFY rank <= 6)"""


@query(O.base() + _LINKS + " SELECT * FROM ups")
def upgrades(p):
    return fix.upgrades(p.graph(), _pin_links(p), bad_of(p))


@query(O.base() + _LINKS + """, up AS (SELECT key, 0 AS depth FROM bad UNION SELECT d.source, u.depth + 1 FROM up u JOIN dep d ON d.target = u.key AND d.rel_type = 'DEPENDS_ON' WHERE u.depth < 4),
    judged AS (SELECT change, min(CASE WHEN key NOT IN (SELECT key FROM up) OR package IN (SELECT package FROM bad) THEN rank END) AS best, count(*) AS n FROM ups GROUP BY change),
    found AS (SELECT l.change, l.package, l.version, u.to_version, j.n FROM links l LEFT JOIN judged j USING (change) LEFT JOIN ups u ON u.change = l.change AND u.rank = j.best)
    SELECT change, TRUE AS mine, package, version, coalesce(to_version, '') AS to_version, to_version IS NOT NULL AS available,
        to_version IS NULL AND coalesce(n, 0) > 0 AS reachable, to_version IS NOT NULL AS clean, FALSE AS upstream FROM found""")
def upgrade_verdicts(p):
    return fix.verdicts(p.graph(), _pin_links(p), bad_of(p))


# Pins and advisories


@query("SELECT CAST(l_orderkey AS VARCHAR) AS source, " + O.name("l_partkey") + " AS package, '1.' || l_linenumber || '.0' AS version, bool_or(l_returnflag = 'A') AS direct FROM lineitem GROUP BY ALL")
def pins_dedupe(p):
    return edges.declared_pins(p.pin_entries)


@query(O.plain("SELECT source, package, version, direct, target FROM pins WHERE target IN (SELECT key FROM rel WHERE publisher % 2 = 0)"))
def pins_match(p):
    half = p.raw_releases.where("publisher % 2 = 0")
    return pins.matched(p.pins, half).select("source", "package", "version", "direct", "target")


@query(O.plain("SELECT DISTINCT target AS coordinate FROM pins WHERE target NOT IN (SELECT key FROM rel WHERE publisher % 2 = 0) ORDER BY 1 LIMIT 10"))
def pins_unmatched(p):
    return pins.unmatched_sample(p.pins, p.raw_releases.where("publisher % 2 = 0"))


@query(O.plain("SELECT osv_id, target, package, version, introduced, fixed_in, 'range' AS range_source FROM affects"))
def advisory_match(p):
    return p.affects


# People, names, overview


@query(O.plain("SELECT DISTINCT maintainer FROM can WHERE package = (SELECT min(package) FROM can)"))
def maintainers_of(p):
    return people.maintainers_of(p.graph(), p.can_publish.agg(F.min("package").alias("m")).first().m)


_PIVOT = """sib AS (SELECT c.package, d.dependents, array_to_string(list_sort(list(DISTINCT c.maintainer)), ',') AS accounts FROM can c JOIN depc d USING (package)
    WHERE c.package <> (SELECT min(package) FROM can) AND c.maintainer IN (SELECT maintainer FROM can WHERE package = (SELECT min(package) FROM can))
    GROUP BY c.package, d.dependents ORDER BY d.dependents DESC, c.package LIMIT 50) """


def _pivot(p: Projection) -> DataFrame:
    return people.pivot(p.graph(), p.can_publish.agg(F.min("package").alias("m")).first().m)


@query(O.base() + _PIVOT + "SELECT * FROM sib")
def pivot(p):
    return _pivot(p)


@query(O.base() + _PIVOT + "SELECT count(*) AS siblings, CAST(coalesce(sum(dependents), 0) AS BIGINT) AS dependents FROM sib")
def pivot_totals(p):
    return people.pivot_totals(_pivot(p))


@query(O.plain("SELECT package, array_to_string(list_sort(list(DISTINCT maintainer)), ',') AS owners FROM can GROUP BY package"))
def owners(p):
    return people.owners(p.graph())


@query(O.base() + f"""pop AS (SELECT * FROM depc WHERE dependents >= {POPULAR}),
    shapes AS (
        SELECT n.package AS name, t.package AS resembles, 0 AS rank, n.dependents, t.dependents AS target_dependents FROM depc n JOIN pop t ON n.package LIKE '@%' AND regexp_extract(n.package, '[^/]*$') = t.package
        UNION ALL SELECT n.package, t.package, 1, n.dependents, t.dependents FROM depc n JOIN pop t ON regexp_replace(n.package, '[-_.]', '', 'g') = regexp_replace(t.package, '[-_.]', '', 'g')
        UNION ALL SELECT n.package, t.package, 2, n.dependents, t.dependents FROM depc n JOIN pop t ON abs(length(n.package) - length(t.package)) <= 1 AND damerau_levenshtein(n.package, t.package) <= 1),
    best AS (SELECT name, resembles, min(rank) AS rank, dependents, target_dependents FROM shapes
        WHERE dependents < {POPULAR} AND dependents < target_dependents AND name <> resembles GROUP BY ALL)
    SELECT name, resembles, ['scoped copy', 'punctuation', 'one edit'][rank + 1] AS trick, CAST(rank = 2 AS INTEGER) AS distance, dependents, target_dependents,
        EXISTS (SELECT 1 FROM can a JOIN can b ON a.maintainer = b.maintainer WHERE a.package = name AND b.package = resembles) AS shares_maintainer,
        dependents / target_dependents AS ratio
    FROM best ORDER BY shares_maintainer, ratio, name, resembles LIMIT 50""")
def typosquat(p):
    return people.typosquat(p.graph(), popular_at=POPULAR)


@query(O.plain("SELECT package, dependents FROM depc ORDER BY dependents DESC, package LIMIT 12"))
def overview_packages(p):
    return people.top_packages(p.graph())


@query(O.plain(f"SELECT osv_id, severity, published_at, 'defect in ' || {O.name('part')} AS summary FROM adv ORDER BY published_at DESC, osv_id LIMIT 200"))
def overview_advisories(p):
    return people.latest_advisories(p.graph())


# Evaluation


@query(O.plain("""SELECT DISTINCT osv_id, severity, published_at FROM (SELECT * FROM affects ORDER BY published_at DESC, osv_id, target LIMIT 80)
    ORDER BY published_at DESC, osv_id LIMIT 20"""))
def eval_incidents(p):
    return evaluate.incidents(p.graph())


def _case(p: Projection, share: int) -> DataFrame:
    """The demonstration's bad releases as one case."""
    return bad_of(p, share).select(F.lit("case").alias("case"), "key", "package")


@query(O.base() + "wrong AS (SELECT DISTINCT 'case' AS \"case\", package FROM bad) SELECT package, distance FROM (" + O.nearest("wrong") + ")")
def name_similarity(p):
    """Names nearest to the bad package's, of all names."""
    return evaluate.by_name_similarity(p.parts.select(F.col("name").alias("package")), _case(p, 40)).select("package", "distance")


@query(O.blast(share=NEAR) + "SELECT service, least(count(*), 500) AS paths FROM paths GROUP BY service")
def eval_baseline(p):
    return evaluate.service_by_service(p.graph(), _case(p, NEAR)).services.select("service", "paths")


@query(O.blast(share=40) + "SELECT DISTINCT unnest(keys) AS release FROM pre JOIN pins n ON n.target = pre.head JOIN lock l ON l.key = n.source")
def eval_baseline_releases(p):
    """The releases on the chains that the walks service by service meet."""
    return evaluate.service_by_service(p.graph(), _case(p, 40), cap=10**9).releases.select("release")


def _evaluated(p: Projection) -> DataFrame:
    return p.shared("evaluated", lambda: written(evaluate.evaluate(p.graph()), "evaluated"))


@query(O.EVALUATED + "SELECT * FROM cases")
def evaluate_incidents(p):
    return _evaluated(p)


@query(O.EVALUATED + """SELECT count(*) AS cases, avg(CAST(agrees AS INTEGER)) AS agreement, max(exposed) FILTER (place = n // 2) AS median_exposed,
    coalesce(avg(precision) FILTER (exposed > 0), 0) AS similarity_precision, coalesce(avg(recall) FILTER (exposed > 0), 0) AS similarity_recall
    FROM (SELECT *, row_number() OVER (ORDER BY exposed) - 1 AS place, count(*) OVER () AS n FROM cases)""")
def evaluate_summary(p):
    """The upper median, which the reports take of speed-ups, here of the numbers of exposed services."""
    cases = _evaluated(p).withColumn("size", F.col("exposed").cast("double"))
    found = evaluate.summary(cases, "size")
    return found.withColumn("median_exposed", F.col("median_speedup").cast("bigint")).drop("median_speedup")


@query(O.base() + """e AS (SELECT DISTINCT c_mktsegment AS "case", c_name AS item FROM customer JOIN lock ON service = c_name WHERE committed_at % 2 = 0),
    f AS (SELECT DISTINCT c_mktsegment AS "case", c_name AS item FROM customer WHERE c_custkey % 3 <> 0),
    n AS (SELECT "case", count(*) FILTER (e.item IS NOT NULL AND f.item IS NOT NULL) AS matched, count(*) FILTER (f.item IS NULL) AS missed, count(*) FILTER (e.item IS NULL) AS invented
        FROM (SELECT *, item AS i FROM e) e FULL JOIN (SELECT *, item AS i FROM f) f USING ("case", i) GROUP BY "case")
    SELECT "case", matched, missed, invented, matched / (matched + invented) AS precision, matched / (matched + missed) AS recall, missed = 0 AND invented = 0 AS agrees FROM n""")
def eval_scores(p):
    even = p.lockfiles.where("committed_at % 2 = 0").select(F.col("service").alias("item"))
    expected = p.services.join(even, F.col("name") == F.col("item"), "left_semi").select(F.col("criticality").alias("case"), F.col("name").alias("item"))
    found = p.table("customer").where("c_custkey % 3 <> 0").select(F.col("c_mktsegment").alias("case"), F.col("c_name").alias("item"))
    return evaluate.scores(expected, found)


# Functions on values made from the tables

_SPELLINGS = """CASE ln % 6 WHEN 0 THEN package || '@' || version WHEN 1 THEN '/' || package || '@' || version WHEN 2 THEN '"' || package || '@npm:' || version || '"'
    WHEN 3 THEN '/' || package || '/' || version WHEN 4 THEN package || '@' || version || '(peer@2.0.0)(@s/other@1.0.0)' ELSE 'just' || part END"""


@query(O.plain(f"""SELECT {_SPELLINGS} AS spec, CASE WHEN ln % 6 = 5 THEN '' ELSE package END AS name, CASE WHEN ln % 6 = 5 THEN '' ELSE version END AS version FROM rel"""))
def coordinate_split(p):
    rows = p.raw_releases.withColumn("ln", F.split("version", r"\.")[1].cast("int")).select(F.expr(_SPELLINGS).alias("spec"))
    return rows.withColumn("c", coordinates.split_coordinate(F.col("spec"))).select("spec", "c.name", "c.version")


_TAGS = ("alpha", "alpha.1", "alpha.beta", "beta", "beta.2", "beta.11", "rc.1", "")
_VERSIONS = "SELECT DISTINCT l_suppkey % 3 AS major, CAST(l_quantity AS INTEGER) % 12 AS minor, l_linenumber AS patch, l_partkey % 8 AS tag FROM lineitem"
_VERSION = f"major || '.' || minor || '.' || patch || CASE WHEN tag = 7 THEN '' ELSE '-' || ['{"','".join(_TAGS)}'][tag + 1] END"


def _versions(p: Projection) -> DataFrame:
    """Distinct versions, most of them prereleases: version, and what it was made of."""
    parts = p.table("lineitem").select(
        (F.col("l_suppkey") % 3).alias("major"), (F.col("l_quantity").cast("int") % 12).alias("minor"), F.col("l_linenumber").alias("patch"), (F.col("l_partkey") % 8).alias("tag")
    ).distinct()
    tag = F.get(F.array(*[F.lit(f"-{t}" if t else "") for t in _TAGS]), F.col("tag").cast("int"))
    return parts.withColumn("version", F.concat(F.concat_ws(".", "major", "minor", "patch"), tag))


@query(f"SELECT {_VERSION} AS version, row_number() OVER (ORDER BY major, minor, patch, tag) AS place FROM ({_VERSIONS})")
def semver_sort(p):
    from pyspark.sql import Window

    rows = _versions(p).select("version", semver.version_key(F.col("version")).alias("k"))
    return rows.select("version", F.row_number().over(Window.orderBy("k")).alias("place"))  # a bounded set: what the rule above can give


#: Ranges, and by hand when a version of major, minor, patch and tag (7: none) is in each.
_RANGES = {
    "^1.2.3": "tag = 7 AND major = 1 AND (minor, patch) >= (2, 3)", "^0.2.3": "tag = 7 AND major = 0 AND minor = 2 AND patch >= 3", "~1.4": "tag = 7 AND major = 1 AND minor = 4",
    "~2.0.3": "tag = 7 AND major = 2 AND minor = 0 AND patch >= 3", "1.x": "tag = 7 AND major = 1", "*": "tag = 7", "": "tag = 7",
    "0.3 - 1.2": "tag = 7 AND ((major = 0 AND minor >= 3) OR (major = 1 AND minor <= 2))", "0.3.2 - 1.2.4": "tag = 7 AND (major, minor, patch) >= (0, 3, 2) AND (major, minor, patch) <= (1, 2, 4)",
    ">1.3": "tag = 7 AND (major > 1 OR (major = 1 AND minor > 3))", "<=1.3": "tag = 7 AND (major = 0 OR (major = 1 AND minor <= 3))", "0.1 || 2": "tag = 7 AND (major = 2 OR (major = 0 AND minor = 1))",
    ">=1.2.3-beta.2 <2": "major = 1 AND ((tag = 7 AND (minor, patch) >= (2, 3)) OR (minor = 2 AND patch = 3 AND tag >= 4))",
    "^1.2.3-beta": "major = 1 AND ((tag = 7 AND (minor, patch) >= (2, 3)) OR (minor = 2 AND patch = 3 AND tag >= 3))",
    "1.2.3-rc.1": "major = 1 AND minor = 2 AND patch = 3 AND tag = 6", "latest": "FALSE", "git+ssh://host/x": "FALSE", "workspace:*": "FALSE",
}


@query(f"WITH v AS ({_VERSIONS}) " + " UNION ALL ".join(f"SELECT {_VERSION} AS version, '{r}' AS range, {ok} AS ok FROM v" for r, ok in _RANGES.items()))
def semver_satisfies(p):
    ranges = p.spark.createDataFrame([(r,) for r in _RANGES], "range string")
    rows = _versions(p).select("version").crossJoin(F.broadcast(ranges))  # the ranges above
    parsed = rows.join(resolve.parsed_ranges(ranges), "range")
    return parsed.select("version", "range", semver.satisfies(semver.version_key(F.col("version")), F.col("parsed")).alias("ok"))


_STAMP = "CASE o_orderkey % 6 WHEN 0 THEN d || 'T00:00:00Z' WHEN 1 THEN d || 'T00:00:00.500Z' WHEN 2 THEN d || 'T02:30:00+02:30' WHEN 3 THEN d WHEN 4 THEN 'on ' || d ELSE '' END"


@query(f"""SELECT o_orderkey AS id, {_STAMP} AS stamp, CASE WHEN o_orderkey % 6 <= 3 THEN CAST(epoch(CAST(d AS DATE)) AS BIGINT) ELSE 0 END AS seconds,
    CASE WHEN o_orderkey % 6 <= 3 THEN CAST(epoch(CAST(d AS DATE)) AS BIGINT) END AS moment FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def timestamps(p):
    rows = p.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).select("id", F.expr(_STAMP).alias("stamp"))
    return rows.select("id", "stamp", times.epoch_or_unknown(F.col("stamp")).alias("seconds"), times.moment(F.col("stamp")).alias("moment"))


@query(O.plain("""SELECT a.name AS a, b.name AS b, CAST(damerau_levenshtein(a.name, b.name) AS INTEGER) AS d FROM (
        SELECT DISTINCT x.name AS a, y.name AS b FROM (SELECT name, unnest(list_append(list_transform(range(1, length(name) + 1), lambda i: name[1:i - 1] || name[i + 1:]), name)) AS k FROM parts) x
        JOIN (SELECT name, unnest(list_append(list_transform(range(1, length(name) + 1), lambda i: name[1:i - 1] || name[i + 1:]), name)) AS k FROM parts) y USING (k) WHERE x.name <> y.name) m
    JOIN parts a ON a.name = m.a JOIN parts b ON b.name = m.b WHERE damerau_levenshtein(a.name, b.name) <= 1"""))
def edit_distance(p):
    """Pairs within one edit among all names."""
    return names.one_edit(p.parts).withColumn("d", distance.distance(F.col("a"), F.col("b"), 1)).where("d <= 1")


# Parsers and ingest on documents made from the tables


@query(samples.SQL + "SELECT package, version, published_at FROM mrel")
def packument_times(p):
    return packuments.version_times(samples.packuments(p))


@query(samples.SQL + f"""SELECT package, version, {O.name('dep')} AS dependency, {samples._RANGE}[r + 1] AS range, kind FROM mdecl
    UNION ALL SELECT package, version, 'ghost' || part, '^1.0.0', 'runtime' FROM mrel WHERE part % 7 = 0""")
def declared_dependencies(p):
    return packuments.dependencies(samples.packuments(p))


@query(samples.SQL + "SELECT key, published_at, CASE WHEN ln % 2 = 1 THEN 'sha512-' || part || '-' || ln ELSE 'x' || part || '-' || ln END AS integrity, ln = 3 AS deprecated, publisher FROM mrel")
def packument_releases(p):
    return packuments.releases(samples.packuments(p)).select("key", "published_at", "integrity", "deprecated", "publisher")


@query(samples.SQL + "SELECT package, min(publisher) AS username, min(publisher) || '@x.org' AS email FROM mrel GROUP BY package")
def packument_maintainers(p):
    return packuments.maintainers(samples.packuments(p))


@query(samples.SQL + f"""SELECT osv_id AS id, CASE event_id % 3 WHEN 0 THEN i || '/' || f || '/' WHEN 1 THEN i || '//' || f ELSE i || '//;' || f || '//' END AS intervals
    FROM (SELECT *, {samples._VERSION}[1 + k % 3] AS i, {samples._VERSION}[3 + k % 5] AS f FROM madv)""")
def advisory_events(p):
    """Events that open and fix, open and end with a last affected version, or open twice."""
    rows = p.table("events").where("event_type = 'error'").withColumn("k", F.from_json("props", "k int")["k"])
    number, opened, second = F.col("event_id"), samples._at(samples.VERSIONS, F.col("k") % 3), samples._at(samples.VERSIONS, 2 + F.col("k") % 5)
    kind = F.when(number % 3 == 0, "fixed").when(number % 3 == 1, "last_affected").otherwise("introduced")
    events = F.to_json(F.array(F.create_map(F.lit("introduced"), opened), F.create_map(kind, second)))
    folded = advisories.fold_events(F.from_json(events, f"array<{advisories.EVENT}>"))
    text = F.array_join(F.transform(folded, lambda i: F.concat_ws("/", i["introduced"], i["fixed"], i["last_affected"])), ";")
    return rows.select(F.concat(F.lit("A-"), number).alias("id"), text.alias("intervals"))


@query(samples.SQL + f"SELECT osv_id, severity, published_at, summary, cwe, aliases, {O.name('part')} AS package, 1 AS intervals, 0 AS versions FROM stands")
def advisory_parse(p):
    return advisories.parse(advisories.read_documents(samples.advisories(p))).select(
        "osv_id", "severity", "published_at", "summary", "cwe", "aliases", "package", F.size("intervals").alias("intervals"), F.size("versions").alias("versions")
    )


def _pins(files: DataFrame) -> DataFrame:
    return lockfiles.pins(files).select("path", "kind", "format_version", "name", "version", "direct")


def _lock_sql(path: str, kind: str, form: str, direct: str, more: str = "") -> str:
    return samples.SQL + f"SELECT 'orders/' || source || '/{path}' AS path, '{kind}' AS kind, '{form}' AS format_version, name, version, {direct} AS direct FROM item_of {more}"


@query(_lock_sql("package-lock.json", "npm", "3", "top AND named"))
def lockfile_npm(p):
    return _pins(samples.npm(p))


@query(_lock_sql("package-lock.json", "npm", "1", "outermost AND named"))
def lockfile_npm_v1(p):
    return _pins(samples.npm_nested(p))


@query(_lock_sql("yarn.lock", "yarn", "1", "named"))
def lockfile_yarn(p):
    return _pins(samples.yarn(p))


@query(_lock_sql("yarn.lock", "yarn", "6", "named"))
def lockfile_yarn_berry(p):
    return _pins(samples.berry(p))


@query(_lock_sql("pnpm-lock.yaml", "pnpm", "9.0", "named", "UNION ALL SELECT DISTINCT 'orders/' || source || '/pnpm-lock.yaml', 'pnpm', '9.0', 'plain', '0.0.1', FALSE FROM item_of"))
def lockfile_pnpm(p):
    return _pins(samples.pnpm(p))


@query(samples.SQL + "SELECT 'npm' AS kind, source, array_to_string(list_sort(list(DISTINCT name) FILTER (declared)), ',') AS names FROM item_of GROUP BY source")
def declared_names(p):
    rows = samples.npm_nested(p).select(F.split("path", "/")[1].cast("long").alias("source"), lockfiles.declared_names(F.col("manifest")).alias("names"))
    return rows.select(F.lit("npm").alias("kind"), "source", F.nullif(F.array_join(F.sort_array("names"), ","), F.lit("")).alias("names"))


@query("SELECT 'orders/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '/package-lock.json' WHEN o_orderkey % 3 = 1 THEN '/pnpm-lock.yaml' ELSE '/yarn.lock' END AS path FROM orders")
def lockfile_precedence(p):
    """Every order's folder has a yarn.lock and other files, two thirds a better lockfile beside it."""
    key = F.col("o_orderkey")
    better = F.when(key % 3 == 0, F.array(F.lit("/package-lock.json"), F.lit("\\pnpm-lock.yaml"))).when(key % 3 == 1, F.array(F.lit("\\pnpm-lock.yaml"))).otherwise(F.array().cast("array<string>"))
    found = p.table("orders").select(key, F.explode(F.concat(F.array(F.lit("/yarn.lock"), F.lit("/readme")), better)).alias("file"))
    return lockfiles.preferred(found.select(F.concat(F.lit("orders/"), key.cast("string"), "file").alias("path"), F.lit("").alias("document"))).select("path")


def _ingested(p: Projection) -> ingest.Ingested:
    return p.shared("ingested", lambda: ingest.build(samples.packuments(p), p.services, samples.lockfiles(p), samples.advisories(p), versions_kept=samples.KEPT, windows_kept=samples.WINDOWS))


@query(samples.SQL + "SELECT * FROM mdep")
def ingest_graph(p):
    """Dependency edges from package documents with real ranges."""
    return _ingested(p).graph.dependencies


@query(samples.SQL + "SELECT * FROM mdep")
def ingest_refresh(p):
    """The same edges, brought up to date: first a tenth of the packages had other documents and another tenth none."""
    number = F.regexp_extract(F.get_json_object("document", "$.name"), r"(\d+)$", 1).cast("long")
    now = written(samples.packuments(p), "packuments")
    before = now.where(number % 10 != 5).withColumn("document", F.when(number % 10 == 4, F.regexp_replace("document", "2\\.1\\.0", "3.0.0")).otherwise(F.col("document")))
    folder = f"{shared_folder(p.spark)}/refresh-{uuid.uuid4().hex}"
    rest = (p.services, samples.lockfiles(p), samples.advisories(p))
    for documents in (before, now):
        made = snapshots.refresh(folder, documents, *rest, versions_kept=samples.KEPT, windows_kept=samples.WINDOWS)
    return made.graph.dependencies


@query(samples.SQL + "SELECT service || ':' || path AS source, r.key AS target, name AS package, m.version, direct FROM mpins m JOIN kept r ON r.package = name AND r.version = m.version")
def ingest_pins(p):
    return _ingested(p).graph.pins.select("source", "target", "package", "version", "direct")


@query(samples.SQL + "SELECT * FROM maffects")
def ingest_affects(p):
    return _ingested(p).graph.affects


@query(samples.SQL + """SELECT 'Package' AS label, count(DISTINCT package) AS n FROM mrel UNION ALL SELECT 'Release', count(*) FROM kept
    UNION ALL SELECT 'Maintainer', count(*) FROM (SELECT DISTINCT publisher FROM kept UNION SELECT min(publisher) FROM mrel GROUP BY part) UNION ALL SELECT 'Service', count(*) FROM customer
    UNION ALL SELECT 'Lockfile', count(DISTINCT source) FROM item_of UNION ALL SELECT 'Advisory', count(DISTINCT osv_id) FROM maffects""")
def ingest_census(p):
    return census(_ingested(p).graph)


@query(samples.SQL + """, req AS (SELECT DISTINCT dep, r FROM facts)
    SELECT 'declared' AS counter, count(*) AS n FROM facts
    UNION ALL SELECT 'unresolvable_ranges', count(*) FROM req WHERE r = 8
    UNION ALL SELECT 'unsatisfied_ranges', count(*) FROM req WHERE r <> 8 AND NOT EXISTS (SELECT 1 FROM mwin w WHERE w.part = req.dep AND w.r = req.r)
    UNION ALL SELECT 'unwritten_targets', count(*) FROM mraw WHERE target NOT IN (SELECT key FROM kept)
    UNION ALL SELECT 'depends_on', count(*) FROM mdep WHERE rel_type = 'DEPENDS_ON' UNION ALL SELECT 'dev_depends_on', count(*) FROM mdep WHERE rel_type = 'DEV_DEPENDS_ON'
    UNION ALL SELECT 'packages', count(DISTINCT package) FROM mrel UNION ALL SELECT 'releases', count(*) FROM kept
    UNION ALL SELECT 'maintainers', count(*) FROM (SELECT DISTINCT publisher FROM kept UNION SELECT min(publisher) FROM mrel GROUP BY part)
    UNION ALL SELECT 'services', count(*) FROM customer UNION ALL SELECT 'lockfiles', count(DISTINCT source) FROM item_of
    UNION ALL SELECT 'pins', count(*) FROM mpins m JOIN kept r ON r.package = name AND r.version = m.version UNION ALL SELECT 'direct_pins', count(*) FROM mpins WHERE direct
    UNION ALL SELECT 'unmatched_pins', count(DISTINCT (name, version)) FROM mpins WHERE NOT EXISTS (SELECT 1 FROM kept r WHERE r.package = name AND r.version = mpins.version)
    UNION ALL SELECT 'advisory_records', count(*) FROM madv UNION ALL SELECT 'advisory_malformed', count(*) FROM madv WHERE event_id % 17 = 0
    UNION ALL SELECT 'advisories_parsed', count(*) FROM stands UNION ALL SELECT 'advisories', count(DISTINCT osv_id) FROM maffects
    UNION ALL SELECT 'advisories_out_of_scope', count(*) FROM stands WHERE osv_id NOT IN (SELECT osv_id FROM maffects) UNION ALL SELECT 'affects', count(*) FROM maffects""")
def ingest_counters(p):
    return _ingested(p).counters
