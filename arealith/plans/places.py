"""Queries of linkage, geometry and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealith.functions.columns import EARTH_KM
from arealith.operators import geometry as G
from arealith.operators import linkage as L
from arealith.operators import pyramid
from arealith.operators import spatial as S
from arealith.operators.bridges import bridges
from arealith.operators.components import connected_components
from arealith.operators.validity import faults
from arealith.plans.areas import LAGGED, MORAN, NATIONS, QUEEN, SUPPLIERS, WEIGHTS, queen, rounded, supplier_values
from arealith.sources.tables import cut, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LEGAL, TYPES = ("incorporated", "inc", "limited", "ltd"), ("widget", "ring", "bolt", "gear", "plate", "rod", "gizmo", "gadget")

# ---- linkage: parts as roster (odd keys, dressed up) and reference (even keys), blocks of brands


def _parts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), "p_name", "p_type")
    k, n = F.col("id") % 12, F.col("p_name")
    # Dressed names: legal words, names longer than one of the pool, names with a sign that is kept (&) and with marks that are not.
    name = (
        F.when(k == 1, F.concat(F.upper(n), F.lit(" Inc.")))
        .when(k == 7, F.concat(n, F.lit(" grand")))
        .when(k.isin(3, 9), F.concat(F.lit("The "), n))
        .when(k.isin(5, 11), F.concat(F.substring_index(n, " ", -1), F.lit(", Ltd")))
        .when(k.isin(2, 8), F.concat(n, F.lit(" deluxe")))
        .when(k == 4, F.replace(n, F.lit(" "), F.lit(" & ")))
        .when(k == 10, F.replace(n, F.lit(" "), F.lit("-")))
        .otherwise(n)
    )
    return p.select("id", "block", name.alias("name"), "p_type", L.normalised(name, LEGAL, TYPES).alias("norm"))


#: The marks among ASCII signs; & and the like stay.
_BARE = r"regexp_replace(lower(name), '[\s()\[\]{}<>,.!?:;~_/\\|-]', '', 'g')"
_WITHOUT = lambda x, words: (lambda f: f(f, x, sorted(words, key=lambda w: (-len(w), w))))(lambda f, x, ws: f(f, f"replace({x}, '{ws[0]}', '')", ws[1:]) if ws else x)
_PARTS = f"""p0 AS (SELECT p_partkey AS id, p_brand AS block, p_type, CASE WHEN k = 1 THEN upper(p_name) || ' Inc.' WHEN k = 7 THEN p_name || ' grand' WHEN k IN (3, 9) THEN 'The ' || p_name WHEN k IN (5, 11) THEN split_part(p_name, ' ', -1) || ', Ltd'
 WHEN k IN (2, 8) THEN p_name || ' deluxe' WHEN k = 4 THEN replace(p_name, ' ', ' & ') WHEN k = 10 THEN replace(p_name, ' ', '-') ELSE p_name END AS name FROM (SELECT *, p_partkey % 12 AS k FROM part)),
p1 AS (SELECT *, {_BARE} AS before, {_WITHOUT(_BARE, LEGAL)} AS after FROM p0),
p AS (SELECT id, block, name, p_type, CASE WHEN {_WITHOUT("after", TYPES)} = '' THEN before ELSE after END AS norm FROM p1)"""


@query("name_normalise", f"WITH {_PARTS} SELECT id, name, norm, {_WITHOUT('norm', TYPES)} = '' AS type_only FROM p")
def query_name_normalise(spark, sf):
    return _parts(spark, sf).select("id", "name", "norm", L.type_word_only(F.col("norm"), TYPES).alias("type_only"))


def _link(spark, sf):
    p = cut(_parts(spark, sf))  # every tier reads it
    roster = p.filter("id % 2 = 1").select("id", "block", "norm")
    ref = p.filter("id % 2 = 0").select("id", "block", "norm", F.when(F.col("id") % 4 == 0, 1).otherwise(2).alias("source"))
    return L.tiered_linkage(roster, ref, p.filter("id % 35 = 7 and id % 2 = 1").select("id", (F.col("id") - 1).alias("ref_id")), TYPES)


_LINK = f"""{_PARTS}, ro AS (SELECT * FROM p WHERE id % 2 = 1), re AS (SELECT *, CASE WHEN id % 4 = 0 THEN 1 ELSE 2 END AS source FROM p WHERE id % 2 = 0),
pa AS (SELECT ro.id, re.id AS ref, re.source * 2 - 2 AS k FROM ro JOIN re ON ro.block = re.block AND ro.norm = re.norm
 UNION ALL SELECT ro.id, re.id, re.source * 2 - 1 FROM ro JOIN re ON ro.block = re.block AND (ends_with(ro.norm, re.norm) OR ends_with(re.norm, ro.norm))
 WHERE least(length(ro.norm), length(re.norm)) >= 5 AND {_WITHOUT("(CASE WHEN length(ro.norm) <= length(re.norm) THEN ro.norm ELSE re.norm END)", TYPES)} <> ''),
ti AS (SELECT id, k, count(*) AS n, min(ref) AS ref FROM pa GROUP BY id, k), be AS (SELECT id, min(CASE WHEN n = 1 THEN k END) AS k, max(n) AS most FROM ti GROUP BY id),
li AS (SELECT ro.id, CASE WHEN ro.id % 35 = 7 THEN ro.id - 1 ELSE ti.ref END AS ref_id, CASE WHEN ro.id % 35 = 7 OR ti.ref IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status,
 CASE WHEN ro.id % 35 = 7 THEN 'override' WHEN ti.ref IS NOT NULL THEN ['exact/1', 'suffix/1', 'exact/2', 'suffix/2'][be.k + 1] WHEN most > 1 THEN 'multiple_candidates_in_block' ELSE 'no_name_match' END AS method
 FROM ro LEFT JOIN be ON be.id = ro.id LEFT JOIN ti ON ti.id = be.id AND ti.k = be.k),
lk AS (SELECT id, status, method, ref_id, method <> 'override' AND ref_id IS NOT NULL AND count(CASE WHEN method <> 'override' THEN 1 END) OVER (PARTITION BY ref_id) > 1 AS contested FROM li)"""


@query("tiered_linkage", f"WITH {_LINK} SELECT * FROM lk")
def query_tiered_linkage(spark, sf):
    return _link(spark, sf)


@query("linkage_stage_report", f"""WITH {_LINK} SELECT method AS stage, count(*) AS roster_rows, count(DISTINCT ref_id) AS refs, sum(CASE WHEN contested THEN 1 ELSE 0 END)::BIGINT AS contested
FROM lk
GROUP BY method""")
def query_linkage_stage_report(spark, sf):
    return _link(spark, sf).groupBy(F.col("method").alias("stage")).agg(F.count("*").alias("roster_rows"), F.countDistinct("ref_id").alias("refs"), F.sum(F.col("contested").cast("long")).alias("contested"))


@query("resolve_codes", f"""WITH {_PARTS}, c AS (SELECT block, norm, count(DISTINCT p_type) AS n, min(p_type) AS code
FROM p
WHERE id % 2 = 0
GROUP BY ALL)
SELECT p.id, CASE WHEN n = 1 THEN code END AS code, CASE WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'several codes' ELSE '' END AS reason
FROM p
LEFT
JOIN c USING (block, norm)
WHERE id % 2 = 1""")
def query_resolve_codes(spark, sf):
    p = _parts(spark, sf)
    return L.resolved_codes(p.filter("id % 2 = 1").select("id", "block", "norm"), p.filter("id % 2 = 0").select("block", "norm", F.col("p_type").alias("code")))


@query("prefix_proposals", f"""WITH {_PARTS}, q AS (SELECT a.id, b.id AS candidate, row_number() OVER (PARTITION BY a.id
ORDER BY length(b.norm), b.norm, b.id) AS rank
FROM p a
JOIN p b ON a.block = b.block AND a.norm <> b.norm AND a.id % 2 = 1 AND b.id % 2 = 0 AND length(a.norm) >= 4 AND starts_with(b.norm, a.norm))
SELECT *
FROM q
WHERE rank <= 3""")
def query_prefix_proposals(spark, sf):
    p = _parts(spark, sf).select("id", "block", "norm")
    return L.prefix_proposals(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"))


@query("fuzzy_proposals")
def query_fuzzy_proposals(spark, sf):
    p = cut(_parts(spark, sf).select("id", "block", "norm"))
    return L.proposals(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"))


@query("fuzzy_candidates", f"""WITH {_PARTS}, f AS (SELECT DISTINCT block, norm, id % 2 AS side FROM p WHERE norm <> ''), ch AS (SELECT block, norm, side, c, count(*) AS n FROM (SELECT *, unnest(string_split(norm, '')) AS c FROM f) GROUP BY ALL),
co AS (SELECT a.block, a.norm AS a, b.norm AS b, sum(least(a.n, b.n)) AS shared FROM ch a JOIN ch b ON a.block = b.block AND a.c = b.c AND a.side = 1 AND b.side = 0 AND a.norm <> b.norm GROUP BY ALL)
SELECT block, a, b FROM co WHERE 2 * shared >= 0.68 * (length(a) + length(b)) - 1e-9""")
def query_fuzzy_candidates(spark, sf):
    p = _parts(spark, sf).select("id", "block", "norm")
    return L.fuzzy_candidates(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"))


#: Full-width forms of the parts' names between words of the two lists: every term of each in turn.
_WIDE = [chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz"]


@query("name_normalise_wide", f"""WITH t AS (SELECT p_partkey AS id, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS bare, {list(L.LEGAL_TERMS)!r}[(p_partkey % {len(L.LEGAL_TERMS)})::INTEGER + 1] AS legal, {list(L.TYPE_WORDS)!r}[(p_partkey % {len(L.TYPE_WORDS)})::INTEGER + 1] AS kind FROM part)
SELECT id, CASE WHEN id % 5 = 0 THEN legal || replace(kind, 'ー', '') ELSE bare || replace(kind, 'ー', '') END AS norm, false AS type_only FROM t""")
def query_name_normalise_wide(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("id") % len(words)).cast("int"))
    wide = F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz", "".join(_WIDE))
    name = F.concat(pick(L.LEGAL_TERMS), F.lit("　"), F.when(F.col("id") % 5 == 0, "").otherwise(wide), F.lit("・"), pick(L.TYPE_WORDS))
    norm = L.normalised(L.nfkc(name))
    return p.select("id", norm.alias("norm")).select("id", "norm", L.type_word_only(F.col("norm")).alias("type_only"))


@query("crosswalk_validate", """WITH x AS (SELECT p_partkey AS id, p_type AS basis, p_brand AS code, p_name
FROM part)
SELECT 'basis' AS rule, CAST(id AS VARCHAR) AS code
FROM x
WHERE basis NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD')
UNION ALL SELECT 'unique key', p_name || '|' || code
FROM x
GROUP BY p_name, code HAVING count(*) > 1
UNION ALL SELECT 'code rule', CAST(id AS VARCHAR)
FROM x
WHERE basis = 'PROMO' AND NOT regexp_matches(code, '^Brand#1[0-9]$')""")
def query_crosswalk_validate(spark, sf):
    x = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    one = x.filter(~F.col("p_type").isin("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD")).select(F.lit("basis").alias("rule"), key.alias("code"))
    two = x.groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("unique key"), F.concat_ws("|", "p_name", "p_brand"))
    three = x.filter((F.col("p_type") == "PROMO") & ~F.col("p_brand").rlike("^Brand#1[0-9]$")).select(F.lit("code rule"), key)
    return one.union(two).union(three)


# ---- validity: a polygon a supplier, sound and with every kind of fault


def _drawn():
    """Rings by the supplier's number modulo 9: vertices as offsets."""
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    return {
        0: [[square(0, 8)]],
        1: [[[(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)]]],  # crosses itself
        2: [[[(0, 0), (8, 0), (8, 8), (0, 8)]]],  # not closed
        3: [[square(0, 8), square(10, 12)]],  # a hole outside
        4: [[square(0, 8), [(0, 4), (4, 2), (4, 6), (0, 4)]]],  # a hole that touches its ring: sound
        5: [[[(0, 0), (8, 0), (8, 8), (4, 8), (4, 12), (4, 8), (0, 8), (0, 0)]]],  # a spike
        6: [[[(0, 0), (8, 0), (8, 8), (4, 0), (0, 8), (0, 0)]]],  # touches itself
        7: [[square(0, 8), square(6, 10)], [square(20, 24)]],  # a hole across its ring
        8: [[[(0, 0), (8, 0), (8, 0), (8, 8), (0, 8), (0, 0)]], [[(20, 0), (24, 0), (20, 0)]]],  # a vertex twice: sound; a part of no area
    }


def _shapes(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"))
    x, y = (F.col("code") % 10 * 32).cast("double"), (F.floor(F.col("code") / 10) * 32).cast("double")
    ring = lambda r: F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in r))
    shape = lambda parts: F.array(*(F.array(*(ring(r) for r in part)) for part in parts))
    kinds = _drawn()
    out = F.when(F.col("code") % 9 == 0, shape(kinds[0]))
    for k in range(1, 9):
        out = out.when(F.col("code") % 9 == k, shape(kinds[k]))
    return s.select("code", out.alias("parts"))


def _validity_sql() -> str:
    rows = ", ".join(f"({k}, {p}, {r}, {v}, {x}::DOUBLE, {y}::DOUBLE)" for k, parts in _drawn().items() for p, part in enumerate(parts) for r, ring in enumerate(part) for v, (x, y) in enumerate(ring))
    turn = lambda p, q, r: f"sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    within = lambda s, p: f"({p}x BETWEEN least({s}ax, {s}ex) AND greatest({s}ax, {s}ex) AND {p}y BETWEEN least({s}ay, {s}ey) AND greatest({s}ay, {s}ey))"
    common = lambda c: f"least(greatest(m.a{c}, m.e{c}), greatest(n.a{c}, n.e{c})) - greatest(least(m.a{c}, m.e{c}), least(n.a{c}, n.e{c}))"
    return f"""WITH k(kind, part, ring, v, dx, dy) AS (VALUES {rows}),
p AS (SELECT s_suppkey AS code, part, ring, v, dx + s_suppkey % 10 * 32 AS x, dy + s_suppkey // 10 * 32 AS y FROM supplier JOIN k ON kind = s_suppkey % 9),
s0 AS (SELECT code, part, ring, v, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM p WINDOW w AS (PARTITION BY code, part, ring ORDER BY v)),
s AS (SELECT code, part, ring, row_number() OVER (PARTITION BY code, part, ring ORDER BY v) - 1 AS seg, count(*) OVER (PARTITION BY code, part, ring) AS segs, ax, ay, ex, ey FROM s0 WHERE ex IS NOT NULL AND (ax <> ex OR ay <> ey)),
t AS (SELECT m.code, m.part, m.ring, m.part = n.part AND m.ring = n.ring AS same, n.seg - m.seg = 1 OR (m.seg = 0 AND n.seg = m.segs - 1) AS follows,
 {turn("m.a", "m.e", "n.a")} AS t0, {turn("m.a", "m.e", "n.e")} AS t1, {turn("n.a", "n.e", "m.a")} AS t2, {turn("n.a", "n.e", "m.e")} AS t3, {common("x")} AS wide, {common("y")} AS high,
 {within("m.", "n.a")} AS i0, {within("m.", "n.e")} AS i1, {within("n.", "m.a")} AS i2, {within("n.", "m.e")} AS i3
 FROM s m JOIN s n ON m.code = n.code AND (m.part, m.ring, m.seg) < (n.part, n.ring, n.seg)),
f AS (SELECT code, part, ring, CASE WHEN t0 * t1 < 0 AND t2 * t3 < 0 THEN 'crossing' WHEN t0 = 0 AND t1 = 0 AND greatest(wide, high) > 0 AND least(wide, high) >= 0 THEN 'overlap'
 WHEN ((t0 = 0 AND i0) OR (t1 = 0 AND i1) OR (t2 = 0 AND i2) OR (t3 = 0 AND i3)) AND same AND NOT follows THEN 'self-touch' END AS fault FROM t),
r AS (SELECT code, part, ring, count(*) AS n, arg_min(x, v) <> arg_max(x, v) OR arg_min(y, v) <> arg_max(y, v) AS open FROM p GROUP BY ALL),
o AS (SELECT h.code, h.part, h.ring, h.v, h.x, h.y, bool_or({turn("s.a", "s.e", "h.")} = 0 AND h.x BETWEEN least(ax, ex) AND greatest(ax, ex) AND h.y BETWEEN least(ay, ey) AND greatest(ay, ey)) AS edge,
 count(CASE WHEN (ay > h.y) <> (ey > h.y) AND h.x < (ex - ax) * (h.y - ay) / (ey - ay) + ax THEN 1 END) % 2 AS odd FROM p h JOIN s ON s.code = h.code AND s.part = h.part AND s.ring = 0 WHERE h.ring > 0 GROUP BY ALL)
SELECT code, fault, part, ring, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY ALL
UNION ALL SELECT code, 'too few vertices', part, ring, 1 FROM r WHERE n < 4 UNION ALL SELECT code, 'not closed', part, ring, 1 FROM r WHERE open
UNION ALL SELECT code, 'hole outside', part, ring, 1 FROM (SELECT code, part, ring, arg_min(odd, v) AS odd FROM o WHERE NOT edge GROUP BY ALL) WHERE odd = 0"""


@query("polygon_faults", _validity_sql())
def query_polygon_faults(spark, sf):
    return faults(cut(_shapes(spark, sf)))


# ---- geometry: nations as squares of two degrees (every third with a hole), embeddings as points


def _polygons(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_nationkey").alias("ord"), (130.0 + 2 * (F.col("n_nationkey") % 5)).alias("x"), (30.0 + 2 * F.expr("n_nationkey div 5")).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    square = lambda a, b: F.array(at(a, a), at(b, a), at(b, b), at(a, b), at(a, a))
    return n.select("code", "ord", F.array(F.when(F.col("code") % 3 == 0, F.array(square(0, 2), square(0.5, 1.5))).otherwise(F.array(square(0, 2)))).alias("parts"))


def _points(spark, sf, *more):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), *more)
    return e.select("id", (135 + 12 * F.col("a")).alias("lon"), (35 + 12 * F.col("b")).alias("lat"), *e.columns[3:])


_POINTS = "pt AS (SELECT vec_id AS id, 135 + 12 * embedding[1]::DOUBLE AS lon, 35 + 12 * embedding[2]::DOUBLE AS lat FROM embeddings)"
_KM = f"2 * {EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query("pip_assign", f"""WITH {NATIONS}, {_POINTS}, sq AS (SELECT id AS code, 130.0 + 2 * c AS x, 30.0 + 2 * r AS y FROM v),
ri AS (SELECT code, x AS x0, x + 2 AS x1, y AS y0, y + 2 AS y1 FROM sq UNION ALL SELECT code, x + 0.5, x + 1.5, y + 0.5, y + 1.5 FROM sq WHERE code % 3 = 0),
ed AS (SELECT code, x0 AS ax, y0 AS ay, x1 AS gx, y0 AS gy FROM ri UNION ALL SELECT code, x1, y0, x1, y1 FROM ri UNION ALL SELECT code, x1, y1, x0, y1 FROM ri UNION ALL SELECT code, x0, y1, x0, y0 FROM ri),
h AS (SELECT pt.id, code FROM pt JOIN ed ON ((ay > lat) <> (gy > lat)) AND lon < (gx - ax) * (lat - ay) / (gy - ay) + ax GROUP BY pt.id, code HAVING count(*) % 2 = 1)
SELECT pt.id, min(code) AS code FROM pt LEFT JOIN h ON h.id = pt.id GROUP BY pt.id""")
def query_pip_assign(spark, sf):
    return pyramid.assign_points(_points(spark, sf).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), _polygons(spark, sf))


@query("distance_band", f"WITH {_POINTS} SELECT * FROM (SELECT a.id AS src, b.id AS dst, round({_KM}, 6) AS km FROM pt a JOIN pt b ON a.id <> b.id) WHERE km > 0 AND km <= 60")
def query_distance_band(spark, sf):
    return rounded(G.close_pairs(_points(spark, sf), 60.0), "km")


@query("knn", f"""WITH {_POINTS}, d AS (SELECT a.id AS src, b.id AS dst, {_KM} AS km
FROM pt a
JOIN pt b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY src
ORDER BY round(km, 9), dst) AS rank
FROM d)
SELECT src, dst, round(km, 6) AS km, rank
FROM k
WHERE rank <= 4""")
def query_knn(spark, sf):
    return rounded(pyramid.nearest(_points(spark, sf), 4), "km")


@query("weight_sensitivity", f"""WITH {_POINTS}, v AS (SELECT vec_id AS id, embedding[3]::DOUBLE AS x FROM embeddings), d AS (SELECT a.id AS src, b.id AS dst, {_KM} AS km FROM pt a JOIN pt b ON a.id <> b.id),
e AS (SELECT src, dst FROM d WHERE km > 0 AND km <= 30), {WEIGHTS}, {LAGGED}, {MORAN}
SELECT '30 km' AS weights, n, round(i, 6) + 0.0 AS i, (SELECT count(*) FROM l WHERE degree = 0) AS isolates FROM moran""")
def query_weight_sensitivity(spark, sf):
    m = S.band_moran(_points(spark, sf, F.col("embedding")[2].cast("double").alias("x")), 30.0)
    return rounded(m.select(F.lit("30 km").alias("weights"), "n", "i", "isolates"), "i")


def _estates(spark, sf):
    """A supplier's land: a square with a hole off its middle, for every other one a second part."""
    v = supplier_values(spark, sf).select("id", (130 + 4.0 * F.col("c")).alias("x"), (10 + 4.0 * F.col("r")).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    box = lambda x0, y0, x1, y1: F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))
    one = F.array(box(0, 0, 2, 2), box(1, 1, 1.5, 1.5))
    two = F.array(F.reverse(box(2, 0, 4, 1)))
    return v.select("id", F.when(F.col("id") % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("parts"))


_ESTATES = "s AS (SELECT id, 130 + 4.0::DOUBLE * c AS x, 10 + 4.0::DOUBLE * r AS y, id % 2 = 0 AS two FROM v)"


@query("centroids", f"""WITH {SUPPLIERS}, {_ESTATES}, a AS (SELECT *, CASE WHEN two THEN 2 ELSE 0 END AS more
FROM s)
SELECT id AS code, round((4 * (x + 1) - 0.25 * (x + 1.25) + more * (x + 3)) / (3.75 + more), 6) AS x, round((4 * (y + 1) - 0.25 * (y + 1.25) + more * (y + 0.5)) / (3.75 + more), 6) AS y
FROM a""")
def query_centroids(spark, sf):
    return rounded(_estates(spark, sf).select(F.col("id").alias("code"), G.centroid(F.col("parts")).alias("p")).select("code", "p.x", "p.y"), "x", "y")


@query("bounding_boxes", f"WITH {SUPPLIERS}, {_ESTATES} SELECT id AS code, x AS x0, CASE WHEN two THEN x + 4 ELSE x + 2 END AS x1, y AS y0, y + 2 AS y1 FROM s")
def query_bounding_boxes(spark, sf):
    return _estates(spark, sf).select(F.col("id").alias("code"), G.bounds(F.col("parts")).alias("b")).select("code", "b.*")


# ---- one field under many definitions of neighbours: suppliers as places on the sphere

_PLACES = "pl AS (SELECT id, x, r, c, 130 + 0.1::DOUBLE * c AS lon, -60 + 0.1::DOUBLE * (r % 1200) AS lat FROM v)"
_BANDS, _NEAREST = (10.5, 12.0, 20.0), (4, 6)


def _choice_sql(name, edges):
    km = f"(SELECT a.id AS src, b.id AS dst, {_KM} AS km FROM pl a JOIN pl b ON a.id <> b.id)"
    return f"""(WITH {SUPPLIERS}, {_PLACES}, {edges.format(km=km)}, {WEIGHTS}, {LAGGED}, {MORAN} SELECT '{name}' AS weights, n, round(i, 6) + 0.0 AS i, round(p, 6) + 0.0 AS p, (SELECT count(*)
FROM l
WHERE degree = 0) AS isolates
FROM moran)"""


_CHOICES = {"queen": QUEEN}
_CHOICES |= {f"{b:g} km": f"e AS (SELECT src, dst FROM {{km}} WHERE km > 0 AND km <= {b})" for b in _BANDS}
_CHOICES |= {f"k = {k}": f"e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(km, 9), dst) AS rank FROM {{km}}) WHERE rank <= {k})" for k in _NEAREST}


@query("weight_choices", " UNION ALL ".join(f"SELECT * FROM {_choice_sql(n, e)}" for n, e in _CHOICES.items()))
def query_weight_choices(spark, sf):
    """Moran's I, p and the number of isolates by queen contiguity, three distance bands and two numbers of nearest neighbours."""
    v = cut(supplier_values(spark, sf).select("id", "x", "r", "c", (130 + 0.1 * F.col("c")).alias("lon"), (-60 + 0.1 * (F.col("r") % 1200)).alias("lat")))
    edges = {"queen": queen(v)}
    edges |= {f"{b:g} km": G.close_pairs(v, b) for b in _BANDS}
    near = cut(pyramid.nearest(v, max(_NEAREST)))
    edges |= {f"k = {k}": near.filter(F.col("rank") <= k) for k in _NEAREST}
    out = None
    for name, e in edges.items():
        e = cut(e.select("src", "dst"))
        alone = S.degrees(e, v).agg(F.sum((F.col("degree") == 0).cast("long")).alias("isolates"))
        one = S.global_moran(v, S.row_weights(e)).select(F.lit(name).alias("weights"), "n", "i", "p").crossJoin(F.broadcast(alone))
        out = one if out is None else out.union(one)
    return rounded(out, "i", "p")


def _vertices(spark, sf):
    s = supplier_values(spark, sf).withColumn("off", 0.00005 * (F.col("id") % 3))
    corner = [F.struct((F.col("c") + dx + F.col("off")).cast("double").alias("x"), (F.col("r") + dy).cast("double").alias("y")) for dx in (0, 1) for dy in (0, 1)]
    return s.select("id", F.explode(F.array(*corner)).alias("p")).select("id", "p.x", "p.y")


_VERT = f"{SUPPLIERS}, ve AS (SELECT id, c + dx + 0.00005::DOUBLE * (id % 3) AS x, r + dy AS y FROM v, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))"


@query("snap_sensitivity", f"""WITH {_VERT}, pr AS (SELECT DISTINCT a.id AS src, b.id AS dst, s
FROM ve a
JOIN ve b ON a.id <> b.id, (VALUES (0.0), (0.0001), (0.001)) t(s)
WHERE abs(a.x - b.x) < 0.01 AND a.y = b.y AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= s * s)
SELECT round(t.s, 6)::DOUBLE AS snap, count(pr.src) AS edges
FROM (VALUES (0.0), (0.0001), (0.001)) t(s)
LEFT
JOIN pr ON pr.s = t.s
GROUP BY t.s""")
def query_snap_sensitivity(spark, sf):
    v = _vertices(spark, sf)
    out = None
    for s in (0.0, 0.0001, 0.001):
        one = G.shared_vertex_edges(v, s).agg(F.lit(s).alias("snap"), F.count("*").alias("edges"))
        out = one if out is None else out.union(one)
    return out


_SNAPS = (0.0, 0.0001, 0.001)


@query("snap_adoption", f"""WITH {_VERT}, pr AS (SELECT DISTINCT a.id AS src, b.id AS dst, s FROM ve a JOIN ve b ON a.id <> b.id, (VALUES (0.0), (0.0001), (0.001)) t(s) WHERE abs(a.x - b.x) < 0.01 AND a.y = b.y AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= s * s),
k AS (SELECT src, dst, bool_or(s = 0.0) AS a, bool_or(s = 0.0001) AS b, bool_or(s = 0.001) AS c FROM pr GROUP BY src, dst), d AS (SELECT coalesce(sum(CASE WHEN a <> b THEN 1 END), 0)::BIGINT AS d0, coalesce(sum(CASE WHEN b <> c THEN 1 END), 0)::BIGINT AS d1, coalesce(sum(CASE WHEN a <> c THEN 1 END), 0)::BIGINT AS d2 FROM k)
SELECT d0 AS first_second, d1 AS second_third, d2 AS first_third, CASE WHEN d0 = 0 THEN 0.0::DOUBLE ELSE 0.0001::DOUBLE END AS adopted FROM d""")
def query_snap_adoption(spark, sf):
    """How many edges three snapping distances differ in; the first is adopted where the second changes nothing, the third is a control."""
    v = cut(_vertices(spark, sf))
    all_ = None
    for k, s in enumerate(_SNAPS):
        one = G.shared_vertex_edges(v, s).select("src", "dst", *(F.lit(j == k).alias(f"s{j}") for j in range(3)))
        all_ = one if all_ is None else all_.union(one)
    by = all_.groupBy("src", "dst").agg(*(F.max(f"s{j}").alias(f"s{j}") for j in range(3)))
    differ = lambda a, b: F.coalesce(F.sum((F.col(a) != F.col(b)).cast("long")), F.lit(0))
    out = by.agg(differ("s0", "s1").alias("first_second"), differ("s1", "s2").alias("second_third"), differ("s0", "s2").alias("first_third"))
    return out.withColumn("adopted", F.when(F.col("first_second") == 0, _SNAPS[0]).otherwise(_SNAPS[1]))


# ---- graphs: supplier lattice broken at every fifth row, or joined by one edge


@query("components", f"""WITH RECURSIVE {SUPPLIERS}, {QUEEN.replace('e AS', 'q AS', 1)}, e AS (SELECT src, dst
FROM q
JOIN v a ON a.id = src
JOIN v b ON b.id = dst
WHERE a.r // 3 = b.r // 3),
t AS (SELECT id, id AS root
FROM v UNION SELECT e.dst, t.root
FROM t
JOIN e ON e.src = t.id)
SELECT id, min(root) AS component
FROM t
GROUP BY id""")
def query_components(spark, sf):
    v = supplier_values(spark, sf)
    row = v.select("id", "r")
    e = queen(v).join(row.withColumnRenamed("id", "src"), "src").join(row.select(F.col("id").alias("dst"), F.col("r").alias("r2")), "dst").filter("r div 3 = r2 div 3")
    c = connected_components(e.select("src", "dst"))
    return v.select("id").join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("component_sizes", f"""WITH {SUPPLIERS}, c AS (SELECT id, min(id) OVER (PARTITION BY r // 3) AS component, r
FROM v)
SELECT component, count(*) AS size, count(DISTINCT r) AS row_count
FROM c
GROUP BY component""")
def query_component_sizes(spark, sf):
    v = supplier_values(spark, sf)
    c = QUERIES["components"](spark, sf)
    return v.join(c, "id").groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("r").alias("row_count"))


@query("component_regions", f"""WITH {SUPPLIERS}, c AS (SELECT v.id, min(v.id) OVER (PARTITION BY r // 3) AS component, n_regionkey AS region FROM v JOIN supplier ON s_suppkey = v.id JOIN nation ON n_nationkey = s_nationkey), g AS (SELECT component, region, count(*) AS n FROM c GROUP BY ALL)
SELECT component, sum(n)::BIGINT AS size, rank() OVER (ORDER BY sum(n) DESC, component) AS place, string_agg(region || ' ' || n, '; ' ORDER BY n DESC, region) AS regions FROM g GROUP BY component""")
def query_component_regions(spark, sf):
    """Components, the largest first, with the regions that they are made of."""
    from arealith.operators.ranks import numbered

    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    of = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey").join(nation, "s_nationkey")
    g = QUERIES["components"](spark, sf).join(of, "id").groupBy("component", "region").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "region"))), lambda p: F.concat_ws(" ", p["region"], -p["less"]))
    by = g.groupBy("component").agg(F.sum("n").alias("size"), F.array_join(parts, "; ").alias("regions"))
    ordered = numbered(by.withColumn("less", -F.col("size")), "at", "less", "component")
    return ordered.select("component", "size", (F.col("at") + 1).alias("place"), "regions")


@query("isolates_are_components", f"""WITH {SUPPLIERS}, {QUEEN.replace('e AS', 'q AS', 1)}, e AS (SELECT src, dst
FROM q
WHERE src % 7 <> 3 AND dst % 7 <> 3),
a AS (SELECT id
FROM v
WHERE id NOT IN (SELECT src
FROM e))
SELECT count(*) AS isolates, count(*) AS single, 0::BIGINT AS differ
FROM a""")
def query_isolates_are_components(spark, sf):
    """Areas without neighbours and components of one area, which must be the same."""
    v = supplier_values(spark, sf)
    e = cut(queen(v).filter("src % 7 <> 3 and dst % 7 <> 3"))
    c = v.select("id").join(connected_components(e), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    single = c.groupBy("component").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("component").alias("id"), F.lit(1).alias("single"))
    alone = S.degrees(e, v).filter("degree = 0").select("id", F.lit(1).alias("alone"))
    both = alone.join(single, "id", "full_outer")
    return both.agg(F.count("alone").alias("isolates"), F.count("single").alias("single"), F.count(F.when(F.col("alone").isNull() | F.col("single").isNull(), 1)).alias("differ"))


def _supply(spark, sf):
    """Suppliers under depots of half their number, every third one with a road to the next."""
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"))
    road = v.filter("src % 3 = 1").select("src", (F.col("src") + 1).alias("dst"))
    return v.filter("src > 0").select("src", F.expr("src div 2").alias("dst")).union(road.join(v.select(F.col("src").alias("dst")), "dst").select("src", "dst"))


@query("bridges", """WITH RECURSIVE k AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT a.s_suppkey, b.s_suppkey FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 3 = 1),
e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM k), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT a, b, a AS id FROM e UNION SELECT t.a, t.b, s.b FROM t JOIN s ON s.a = t.id AND NOT (least(s.a, s.b) = t.a AND greatest(s.a, s.b) = t.b)),
n AS (SELECT a, b, count(*) AS side, bool_or(id = b) AS back FROM t GROUP BY a, b), w AS (SELECT count(DISTINCT a) AS total FROM s)
SELECT n.a, n.b, least(side, total - side) AS small, greatest(side, total - side) AS large, x.s_nationkey <> y.s_nationkey AS crosses FROM n, w, supplier x, supplier y WHERE NOT back AND x.s_suppkey = n.a AND y.s_suppkey = n.b""")
def query_bridges(spark, sf):
    """Bridges with the sizes of their sides, and whether they cross a border of nations."""
    of = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    out = bridges(_supply(spark, sf))
    for s in "ab":
        out = out.join(of.select(F.col("s_suppkey").alias(s), F.col("s_nationkey").alias(f"{s}_nation")), s)
    return out.select("a", "b", "small", "large", (F.col("a_nation") != F.col("b_nation")).alias("crosses"))


@query("linkage_checks", f"""WITH {_LINK} SELECT 'one row for each roster row' AS "check", (SELECT count(*) FROM ro) AS expected, (SELECT count(DISTINCT id) FROM lk) AS actual
UNION ALL SELECT 'matched and unmatched add up', (SELECT count(*) FROM ro), (SELECT count(*) FROM lk WHERE status = 'matched') + (SELECT count(*) FROM lk WHERE status = 'unmatched')
UNION ALL SELECT 'matched rows have a reference', (SELECT count(*) FROM lk WHERE status = 'matched'), (SELECT count(ref_id) FROM lk)
UNION ALL SELECT 'references are known', (SELECT count(ref_id) FROM lk), (SELECT count(*) FROM lk JOIN p ON p.id = ref_id)
UNION ALL SELECT 'contested come in groups', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lk WHERE ref_id IS NOT NULL GROUP BY ref_id HAVING count(*) > 1)), (SELECT count(*) FROM lk WHERE contested)""")
def query_linkage_checks(spark, sf):
    k = cut(_link(spark, sf))
    p = _parts(spark, sf)
    count = lambda d: d.agg(F.count("*").alias("n"))
    groups = k.filter("ref_id is not null").groupBy("ref_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    roster, matched = count(p.filter("id % 2 = 1")), count(k.filter("status = 'matched'"))
    checks = [
        ("one row for each roster row", roster, k.agg(F.countDistinct("id").alias("n"))),
        ("matched and unmatched add up", roster, count(k.filter("status in ('matched', 'unmatched')"))),
        ("matched rows have a reference", matched, count(k.filter("ref_id is not null"))),
        ("references are known", count(k.filter("ref_id is not null")), count(k.join(p.select(F.col("id").alias("ref_id")), "ref_id", "left_semi"))),
        ("contested come in groups", groups, count(k.filter("contested"))),
    ]
    out = None
    for name, a, b in checks:
        one = a.select(F.lit(name).alias("check"), F.col("n").alias("expected")).crossJoin(F.broadcast(b.select(F.col("n").alias("actual"))))
        out = one if out is None else out.union(one)
    return out


_PEOPLE = f"""{_LINK}, w AS (SELECT lk.id, status, method, ref_id, p_size AS n, p.block, re.block AS ref_block, lk.id % 4 = 1 AS care
FROM lk
JOIN part ON p_partkey = lk.id
JOIN p ON p.id = lk.id
LEFT
JOIN p re ON re.id = ref_id)"""


@query("linkage_conditions", f"""WITH {_PEOPLE}, c AS (SELECT block, sum(n) AS everyone, coalesce(sum(CASE WHEN status = 'matched' THEN n END), 0) AS mapped, coalesce(sum(CASE WHEN status = 'matched' AND care THEN n END), 0) AS care FROM w GROUP BY block),
k AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY everyone) + (count(*) OVER (PARTITION BY everyone) - 1) / 2.0 AS b FROM (SELECT round(mapped / everyone, 9) AS s, everyone FROM c))
SELECT 'same rows as the roster' AS condition, (SELECT count(*) FROM ro) = (SELECT count(DISTINCT id) FROM lk) AS ok UNION ALL SELECT 'people by status add up', (SELECT sum(n) FROM w) = (SELECT sum(p_size) FROM part WHERE p_partkey % 2 = 1)
UNION ALL SELECT 'areas add up to matched people', (SELECT sum(mapped) FROM c) = (SELECT sum(n) FROM w WHERE status = 'matched') UNION ALL SELECT 'areas are those of the reference', (SELECT count(DISTINCT block) FROM w) = (SELECT count(DISTINCT block) FROM re)
UNION ALL SELECT 'references lie in the own area', (SELECT count(*) FROM w WHERE ref_id IS NOT NULL AND method <> 'override' AND block <> ref_block) = 0 UNION ALL SELECT 'areas have the roster''s people', (SELECT sum(everyone) FROM c) = (SELECT sum(n) FROM w)
UNION ALL SELECT 'missing is not patterned', (SELECT abs(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0)) < 0.3 FROM k) UNION ALL SELECT 'overrides hold', (SELECT count(*) FROM w WHERE (id % 35 = 7) <> (method = 'override')) = 0
UNION ALL SELECT 'care is not more than all', (SELECT count(*) FROM c WHERE care > mapped) = 0""")
def query_linkage_conditions(spark, sf):
    """The nine conditions that a finished linkage has to meet, each with its verdict."""
    from arealith.operators import audit as A

    parts = cut(_parts(spark, sf).select("id", "block"))
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n"))
    w = _link(spark, sf).join(size, "id").join(parts, "id").join(parts.select(F.col("id").alias("ref_id"), F.col("block").alias("ref_block")), "ref_id", "left").withColumn("care", F.col("id") % 4 == 1)
    w = cut(w)
    matched = F.col("status") == "matched"
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    c = cut(w.groupBy("block").agg(F.sum("n").alias("everyone"), zero(matched).alias("mapped"), zero(matched & F.col("care")).alias("care")))
    ranks = A.average_ranks(A.average_ranks(c.withColumn("s", F.round(F.col("mapped") / F.col("everyone"), 9)), "s", "a"), "everyone", "b")
    roster = size.filter("id % 2 = 1")
    ref = parts.filter("id % 2 = 0")
    bad = F.col("ref_id").isNotNull() & (F.col("method") != "override") & (F.col("block") != F.col("ref_block"))
    facts = [
        roster.agg(F.count("*").alias("rows"), F.sum("n").alias("people")),
        w.agg(F.countDistinct("id").alias("linked"), F.sum("n").alias("all_n"), zero(matched).alias("matched_n"), F.countDistinct("block").alias("areas"), F.sum(bad.cast("long")).alias("elsewhere"), F.sum(((F.col("id") % 35 == 7) != (F.col("method") == "override")).cast("long")).alias("unheld")),
        c.agg(F.sum("everyone").alias("area_people"), F.sum("mapped").alias("area_mapped"), F.sum((F.col("care") > F.col("mapped")).cast("long")).alias("upside_down")),
        ref.agg(F.countDistinct("block").alias("ref_areas")),
        A.correlation(ranks, "a", "b"),
    ]
    one = facts[0]
    for f in facts[1:]:
        one = one.crossJoin(F.broadcast(f))
    conditions = [
        ("same rows as the roster", "rows = linked"), ("people by status add up", "all_n = people"), ("areas add up to matched people", "area_mapped = matched_n"), ("areas are those of the reference", "areas = ref_areas"),
        ("references lie in the own area", "elsewhere = 0"), ("areas have the roster's people", "area_people = all_n"), ("missing is not patterned", "abs(r) < 0.3"), ("overrides hold", "unheld = 0"), ("care is not more than all", "upside_down = 0"),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.expr(e).alias("ok")) for n, e in conditions))).alias("c")).select("c.*")
