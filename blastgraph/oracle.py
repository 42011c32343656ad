"""The projection and the questions over it in SQL, for checking results side by side."""

from __future__ import annotations

OPEN_END = 4_102_444_800


def name(x: str) -> str:
    return f"(CASE {x} % 10 WHEN 3 THEN '@s/pkg' || ({x} // 10) WHEN 7 THEN 'pkg-' || ({x} // 10) ELSE 'pkg' || {x} END)"


BASE = f"""WITH RECURSIVE parts AS (SELECT p_partkey AS part, {name('p_partkey')} AS name FROM part),
rel AS (
    SELECT l_partkey AS part, l_linenumber AS ln, {name('l_partkey')} AS package, '1.' || l_linenumber || '.0' AS version,
        {name('l_partkey')} || '@1.' || l_linenumber || '.0' AS key, CAST(epoch(min(l_shipdate)) AS BIGINT) AS published_at, min(l_suppkey) AS publisher
    FROM lineitem GROUP BY l_partkey, l_linenumber),
can AS (
    SELECT DISTINCT s_name AS maintainer, {name('l_partkey')} AS package
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1 AND l_quantity > 45),
lock AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS key, 'orders/' || o_orderkey AS path, c_name AS service, CAST(epoch(o_orderdate) AS BIGINT) AS committed_at
    FROM orders JOIN customer ON o_custkey = c_custkey),
pins AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS source, {name('l_partkey')} AS package, '1.' || l_linenumber || '.0' AS version,
        bool_or(l_returnflag = 'A') AS direct, {name('l_partkey')} || '@1.' || l_linenumber || '.0' AS target
    FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber),
decl AS (
    SELECT key AS source, published_at, part // 2 AS dep, 'runtime' AS kind FROM rel WHERE part > 0
    UNION SELECT key, published_at, part // 3, 'runtime' FROM rel WHERE part > 0
    UNION SELECT key, published_at, part // 5, 'dev' FROM rel WHERE part > 0 AND part % 4 = 0),
raised AS (
    SELECT *, max(ln) OVER (PARTITION BY part ORDER BY published_at, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM rel),
win AS (
    SELECT part, package, version, published_at AS valid_from,
        lead(published_at, 1, {OPEN_END}) OVER (PARTITION BY part ORDER BY published_at, version) AS valid_to
    FROM raised WHERE best IS NULL OR ln > best),
dep AS (
    SELECT CASE kind WHEN 'dev' THEN 'DEV_DEPENDS_ON' ELSE 'DEPENDS_ON' END AS rel_type, d.source, w.package || '@' || w.version AS target,
        '*' AS range, w.version AS resolved_to, kind, greatest(w.valid_from, d.published_at) AS valid_from, w.valid_to
    FROM decl d JOIN win w ON d.dep = w.part WHERE greatest(w.valid_from, d.published_at) < w.valid_to
    QUALIFY row_number() OVER (PARTITION BY d.source, w.part, kind ORDER BY w.valid_to DESC, w.valid_from DESC) <= 2),
adv AS (
    SELECT 'ADV-' || event_id AS osv_id, CASE WHEN value < 25 THEN 'LOW' WHEN value < 50 THEN 'MODERATE' WHEN value < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
        CAST(floor(epoch(ts)) AS BIGINT) AS published_at, event_id % (SELECT count(*) FROM part) AS part, CAST(json_extract(props, '$.k') AS INTEGER) AS k
    FROM events WHERE event_type = 'error'),
affects AS (
    SELECT osv_id, severity, a.published_at, r.key AS target, r.package, r.version, '1.' || (1 + k % 3) || '.0' AS introduced, '1.' || (3 + k % 5) || '.0' AS fixed_in
    FROM adv a JOIN rel r USING (part) WHERE r.ln >= 1 + k % 3 AND r.ln < 3 + k % 5),
depc AS (
    SELECT p.name AS package, count(DISTINCT s.package) AS dependents
    FROM parts p LEFT JOIN (SELECT r.package, t.package AS to_package FROM dep JOIN rel r ON r.key = dep.source JOIN rel t ON t.key = dep.target) s
        ON s.to_package = p.name AND s.package <> p.name
    GROUP BY p.name),
bad AS (SELECT key, package, version, published_at FROM rel WHERE package = (SELECT {name('max(p_partkey) // $SHARE')} FROM part)),
"""


def base(share: int = 40) -> str:
    return BASE.replace("$SHARE", str(share))


def prefixes(hops: int, where: str = "TRUE", live: str = "greatest(p.valid_from, d.valid_from) < least(p.valid_to, d.valid_to)") -> str:
    """Chains back from the bad releases."""
    return f"""pre AS (
    SELECT key AS target, key AS head, 0 AS hops, CAST(0 AS BIGINT) AS valid_from, CAST({OPEN_END} AS BIGINT) AS valid_to, [key] AS keys, FALSE AS build_time,
        CAST([] AS STRUCT(rel_type VARCHAR, holder VARCHAR, depends_on VARCHAR, version VARCHAR)[]) AS links FROM bad
    UNION ALL
    SELECT p.target, d.source, p.hops + 1, greatest(p.valid_from, d.valid_from), least(p.valid_to, d.valid_to), list_prepend(d.source, p.keys),
        p.build_time OR d.rel_type = 'DEV_DEPENDS_ON',
        list_prepend({{'rel_type': d.rel_type, 'holder': d.source, 'depends_on': p.head, 'version': d.resolved_to}}, p.links)
    FROM pre p JOIN dep d ON d.target = p.head
    WHERE p.hops < {hops} AND NOT list_contains(p.keys, d.source) AND {where} AND {live})"""


PATHS = """, paths AS (
    SELECT l.service, l.key AS lockfile, l.path, p.target, p.head AS entry, p.hops + 2 AS hops, p.valid_from, p.valid_to, n.direct AND p.hops = 0 AS direct,
        p.build_time, l.service || ' > ' || l.path || ' > ' || array_to_string(p.keys, ' > ') AS chain, n.direct AS pin_direct, n.version AS pin_version, p.links
    FROM pre p JOIN pins n ON n.target = p.head JOIN lock l ON l.key = n.source)
"""


def blast(hops: int = 6, as_of: int | None = None, build: bool = True, share: int = 40) -> str:
    kind = "TRUE" if build else "d.rel_type = 'DEPENDS_ON'"
    live = "greatest(p.valid_from, d.valid_from) < least(p.valid_to, d.valid_to)"
    if as_of is not None:
        live = f"greatest(p.valid_from, d.valid_from) <= {as_of} AND least(p.valid_to, d.valid_to) > {as_of}"
    return base(share) + prefixes(hops, kind, live) + PATHS


SERVICES = """SELECT p.service, CAST(min(hops) AS BIGINT) AS shortest, count(*) AS paths, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets,
    array_to_string(list_sort(list(DISTINCT entry)), ',') AS entries, bool_or(direct) AS direct, bool_or(NOT build_time) AS runtime, any_value(c_mktsegment) AS criticality
FROM paths p JOIN customer ON c_name = p.service GROUP BY p.service"""
SHOWN = f"""SELECT service, target, entry, CAST(hops AS BIGINT) AS hops, chain, valid_from, CASE WHEN valid_to < {OPEN_END} THEN valid_to END AS valid_to, direct, build_time FROM paths"""


def plain(sql: str, share: int = 40) -> str:
    """A question that needs no chains."""
    return base(share) + "none AS (SELECT 1) " + sql


def values(columns: str, rows: list[tuple]) -> str:
    """Expected rows that are fixed by hand."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def osa(a: str, b: str) -> str:
    """Edit distance with adjacent transpositions of two text columns: a table filled row by row, of which the
    last two rows are carried."""
    state = "{{'two': {two}, 'one': {one}, 'i': {i}}}"
    none = "CAST([] AS INTEGER[])"
    first = state.format(two=none, one=f"list_transform(range(0, length({b}) + 1), lambda j: CAST(j AS INTEGER))", i="CAST(0 AS INTEGER)")
    rest = f"list_transform(range(1, length({a}) + 1), lambda i: {state.format(two=none, one=none, i='CAST(i AS INTEGER)')})"
    swapped = f"t.i > 1 AND j[1] > 1 AND substr({a}, t.i, 1) = substr({b}, j[1] - 1, 1) AND substr({a}, t.i - 1, 1) = substr({b}, j[1], 1)"
    cell = f"least(row[-1] + 1, s.one[j[1] + 1] + 1, s.one[j[1]] + CASE WHEN substr({a}, t.i, 1) = substr({b}, j[1], 1) THEN 0 ELSE 1 END, CASE WHEN {swapped} THEN s.two[j[1] - 1] + 1 ELSE 999 END)"
    line = f"list_reduce(list_prepend([t.i], list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)])), lambda row, j: list_append(row, CAST({cell} AS INTEGER)))"
    return f"list_reduce(list_prepend({first}, {rest}), lambda s, t: {{'two': s.one, 'one': {line}, 'i': t.i}}).one[-1]"


def nearest(bad: str, ceiling: int = 12, limit: int = 25) -> str:
    """For each case of ``bad`` (case, package) the names nearest to its packages."""
    return f"""SELECT "case", package, distance FROM (
        SELECT b."case", n.name AS package, CAST(least(min({osa('n.name', 'b.package')}), {ceiling + 1}) AS BIGINT) AS distance FROM {bad} b, parts n
        WHERE NOT EXISTS (SELECT 1 FROM {bad} o WHERE o."case" = b."case" AND o.package = n.name) GROUP BY b."case", n.name)
        QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY distance, package) <= {limit}"""


#: The recent incidents, their releases as the bad ones, the chains to them, and scores of name similarity.
EVALUATED = BASE.split("bad AS (")[0] + """inc AS (
    SELECT DISTINCT osv_id, severity, published_at FROM (SELECT * FROM affects ORDER BY published_at DESC, osv_id, target LIMIT 80) ORDER BY published_at DESC, osv_id LIMIT 20),
hit AS (SELECT DISTINCT osv_id, target AS key, package FROM affects JOIN inc USING (osv_id)),
bad AS (SELECT key, package, version, published_at FROM rel WHERE key IN (SELECT key FROM hit)),
""" + prefixes(6) + f""", met AS (
    SELECT h.osv_id, l.service, p.keys FROM pre p JOIN pins n ON n.target = p.head JOIN lock l ON l.key = n.source JOIN hit h ON h.key = p.target),
e AS (SELECT DISTINCT osv_id, r.package AS item FROM (SELECT osv_id, unnest(keys) AS key FROM met) m JOIN rel r USING (key)),
wrong AS (SELECT DISTINCT osv_id AS "case", package FROM hit),
f AS (SELECT "case" AS osv_id, package AS item FROM ({nearest('wrong')})),
n AS (
    SELECT osv_id, count(*) FILTER (e.i IS NOT NULL AND f.i IS NOT NULL) AS matched, count(*) FILTER (f.i IS NULL) AS missed, count(*) FILTER (e.i IS NULL) AS invented
    FROM (SELECT *, item AS i FROM e) e FULL JOIN (SELECT *, item AS i FROM f) f USING (osv_id, item) GROUP BY osv_id),
cases AS (
    SELECT inc.osv_id, severity, (SELECT count(DISTINCT service) FROM met WHERE met.osv_id = inc.osv_id) AS exposed, TRUE AS agrees, matched, missed, invented,
        CASE WHEN matched + invented > 0 THEN matched / (matched + invented) ELSE 1 END AS precision, CASE WHEN matched + missed > 0 THEN matched / (matched + missed) ELSE 1 END AS recall
    FROM inc JOIN n USING (osv_id))
"""
