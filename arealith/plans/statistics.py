"""Queries of weights, autocorrelation, hot spots and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealith.functions.columns import hot_cold
from arealith.operators import spatial as S
from arealith.plans.areas import LAGGED, MORAN, NATIONS, QUEEN, ROOK, SUPPLIERS, WEIGHTS, erfc_sql, nation_values, queen, queen_weights, rounded, supplier_values

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(*names, digits=6):
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


@query("lattice_queen", f"WITH {SUPPLIERS}, {QUEEN} SELECT src, dst FROM e")
def query_lattice_queen(spark, sf):
    return queen(supplier_values(spark, sf))


@query("lattice_rook", f"WITH {SUPPLIERS}, {ROOK} SELECT src, dst FROM e")
def query_lattice_rook(spark, sf):
    return S.lattice_edges(supplier_values(spark, sf).select("id", "r", "c"), False)


@query("edge_faults", f"""WITH {SUPPLIERS}, {QUEEN}, f AS (SELECT src, dst
FROM e
WHERE NOT (src = 3 AND dst = 4)
UNION ALL SELECT 7, -99)
SELECT src, dst, 'asymmetric' AS fault
FROM f
WHERE NOT EXISTS (SELECT 1
FROM f b
WHERE b.src = f.dst AND b.dst = f.src)
UNION ALL SELECT src, dst, 'unknown id'
FROM f
WHERE dst NOT IN (SELECT id
FROM v)""")
def query_edge_faults(spark, sf):
    v = supplier_values(spark, sf)
    broken = queen(v).filter("not (src = 3 and dst = 4)").union(spark.range(1).select(F.lit(7), F.lit(-99)))
    return S.edge_faults(broken, v).select("src", "dst", "fault")


@query("degree_summary", f"""WITH {SUPPLIERS}, {QUEEN}, d AS (SELECT v.id, count(e.dst) AS degree
FROM v
LEFT
JOIN e ON e.src = v.id
GROUP BY v.id)
SELECT count(*) AS areas, sum(degree)::BIGINT AS edges, round(avg(degree), 6) AS mean_degree, min(degree) AS min_degree, max(degree) AS max_degree
FROM d""")
def query_degree_summary(spark, sf):
    v = supplier_values(spark, sf)
    return S.degrees(queen(v), v).agg(F.count("*").alias("areas"), F.sum("degree").alias("edges"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


@query("row_weights", f"WITH {SUPPLIERS}, {QUEEN}, {WEIGHTS}, {LAGGED}, {MORAN.strip()} SELECT {_r('s0', 's1')}, round((SELECT s2 FROM s2), 6) + 0.0 AS s2 FROM sw")
def query_row_weights(spark, sf):
    return rounded(S.weight_sums(queen_weights(supplier_values(spark, sf))), "s0", "s1", "s2")


@query("spatial_lag", f"WITH {SUPPLIERS}, {QUEEN}, {WEIGHTS}, {LAGGED} SELECT id, {_r('z', 'lag')}, degree FROM l")
def query_spatial_lag(spark, sf):
    v = supplier_values(spark, sf)
    return rounded(S.lagged(v, queen_weights(v)).select("id", "z", "lag", "degree"), "z", "lag")


@query("global_moran", f"WITH {NATIONS}, {QUEEN}, {WEIGHTS}, {LAGGED}, {MORAN} SELECT n, {_r('i', 'expected', 'variance', 'zscore', 'p')} FROM moran")
def query_global_moran(spark, sf):
    v = nation_values(spark, sf)
    return rounded(S.global_moran(v, queen_weights(v)), "i", "expected", "variance", "zscore", "p")


@query("global_moran_suppliers", f"WITH {SUPPLIERS}, {QUEEN}, {WEIGHTS}, {LAGGED}, {MORAN} SELECT n, {_r('i', 'expected', 'variance', 'zscore', 'p')} FROM moran")
def query_global_moran_suppliers(spark, sf):
    v = supplier_values(spark, sf)
    return rounded(S.global_moran(v, queen_weights(v)), "i", "expected", "variance", "zscore", "p")


_CUT = "e AS (SELECT src, dst FROM q WHERE src NOT IN (0, 24) AND dst NOT IN (0, 24))"
_CUT = QUEEN.replace("e AS", "q AS", 1) + ", " + _CUT


@query("moran_isolates", f"WITH {NATIONS}, {_CUT}, {WEIGHTS}, {LAGGED}, {MORAN} SELECT n, {_r('i', 'expected', 'variance', 'p')}, round(i * 25.0 / n, 6) + 0.0 AS i_unadjusted FROM moran")
def query_moran_isolates(spark, sf):
    v = nation_values(spark, sf)
    w = S.row_weights(queen(v).filter("src not in (0, 24) and dst not in (0, 24)"))
    whole = S.global_moran(v, w, adjust_n=False).select(F.col("i").alias("i_unadjusted"))
    out = S.global_moran(v, w).crossJoin(F.broadcast(whole)).drop("zscore")
    return rounded(out, "i", "expected", "variance", "p", "i_unadjusted")


@query("lisa", f"""WITH {NATIONS}, {QUEEN}, {WEIGHTS}, {LAGGED},
 k AS (SELECT count(*)::DOUBLE AS n, sum(z * z) / count(*) AS m2 FROM l),
 t AS (SELECT id, x, z, lag, z / m2 * lag AS i, -z * z * w1 / ((n - 1) * m2) AS ei, (z / m2) * (z / m2) * (n / (n - 2)) * (w2 - w1 * w1 / (n - 1)) * (m2 - z * z / (n - 1)) AS vi FROM l, k)
SELECT id, {_r('x', 'i')}, CASE WHEN round(z, 12) > 0 THEN 'High' ELSE 'Low' END || '-' || CASE WHEN round(lag, 12) > 0 THEN 'High' ELSE 'Low' END AS quadrant,
 round(CASE WHEN vi > 0 THEN {erfc_sql('(abs(i - ei) / sqrt(vi) / sqrt(2.0))')} END, 6) + 0.0 AS p FROM t""")
def lisa(spark, sf):
    v = nation_values(spark, sf)
    return rounded(S.local_moran(v, queen_weights(v)), "x", "i", "p").select("id", "x", "i", "quadrant", "p")


_LISA_S = SQL["lisa"].replace(NATIONS, SUPPLIERS)


@query("lisa_suppliers", _LISA_S)
def query_lisa_suppliers(spark, sf):
    v = supplier_values(spark, sf)
    return rounded(S.local_moran(v, queen_weights(v)), "x", "i", "p").select("id", "x", "i", "quadrant", "p")


@query("sig_count", f"SELECT count(*) AS areas, sum(CASE WHEN p < 0.05 THEN 1 ELSE 0 END)::BIGINT AS significant FROM ({_LISA_S})")
def query_sig_count(spark, sf):
    v = supplier_values(spark, sf)
    return S.local_moran(v, queen_weights(v)).agg(F.count("*").alias("areas"), F.sum(F.when(F.round("p", 6) < 0.05, 1).otherwise(0)).alias("significant"))


_GI = """
g AS (SELECT v.id, v.x, sum(j.x) AS around, count(*)::DOUBLE AS c FROM v JOIN (SELECT src, dst FROM e UNION ALL SELECT id, id FROM v) s ON s.src = v.id JOIN v j ON j.id = s.dst GROUP BY v.id, v.x),
h AS (SELECT avg(x) AS mean, stddev_pop(x) AS s, count(*)::DOUBLE AS n FROM v),
gi AS (SELECT id, x, CASE WHEN c > 1 THEN (around - mean * c) / (s * sqrt((n * c - c * c) / (n - 1))) END AS gi FROM g, h)"""


@query("gi_star", f"WITH {NATIONS}, {QUEEN}, {_GI} SELECT id, {_r('x', 'gi')} FROM gi")
def query_gi_star(spark, sf):
    v = nation_values(spark, sf)
    return rounded(S.gi_star(v, queen(v)), "x", "gi")


@query("gi_labels", f"""WITH {SUPPLIERS}, {QUEEN}, {_GI} SELECT id, round(gi, 6) + 0.0 AS gi, CASE WHEN gi IS NULL THEN 'isolated' WHEN gi > 1.96 THEN 'hot' WHEN gi < -1.96 THEN 'cold' ELSE 'not significant' END AS label
FROM gi""")
def query_gi_labels(spark, sf):
    v = supplier_values(spark, sf)
    return rounded(S.gi_star(v, queen(v)).select("id", "gi", hot_cold(F.col("gi")).alias("label")), "gi")


@query("gi_counterfactual", f"""WITH {NATIONS.replace('v AS', 'v0 AS')}, v AS (SELECT id, r, c, CASE WHEN id = 12 THEN x * 10 ELSE 100 END AS x
FROM v0), {QUEEN}, {_GI} SELECT id, {_r('x', 'gi')}
FROM gi""")
def query_gi_counterfactual(spark, sf):
    v = nation_values(spark, sf).withColumn("x", F.when(F.col("id") == 12, F.col("x") * 10).otherwise(100.0))
    return rounded(S.gi_star(v, queen(v)), "x", "gi")


#: The keyed permutation of ranks, with the number so far as the state of two folds: over rounds, and over walks.
_HALF = "('0x' || substr(md5('1|' || b || '|' || r || '|' || {v}), 1, 8))::BIGINT"
_MIXED = f"""list_reduce(list_prepend({{x}}, [0, 1, 2, 3, 4, 5]::BIGINT[]), lambda y, r: CASE WHEN r % 2 = 0 THEN xor(y, ({_HALF.format(v='(y & ((1::BIGINT << low) - 1))')} & ((1::BIGINT << (bits - low)) - 1)) << low)
 ELSE xor(y, {_HALF.format(v='(y >> low)')} & ((1::BIGINT << low) - 1)) END)"""
_WALKED = f"list_reduce(list_prepend({_MIXED.format(x='own')}, range(2, 61)), lambda x, w: CASE WHEN x < n THEN x ELSE {_MIXED.format(x='x')} END)"


@query("moran_permutation", f"""WITH {SUPPLIERS}, {QUEEN}, {WEIGHTS},
 n AS (SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS k FROM v), b AS (SELECT range AS b FROM range(1, 1000)),
 q AS (SELECT b, id, k AS own, n, bits, ceil(bits / 2)::INTEGER AS low FROM n, b, (SELECT n, greatest(length(bin(n - 1)), 1) AS bits FROM (SELECT count(*) AS n FROM v))),
 d AS (SELECT b, id, {_WALKED} AS k FROM q),
 a AS (SELECT d.b, d.id, n.x FROM d JOIN n USING (k) UNION ALL SELECT 0, id, x FROM v),
 z AS (SELECT b, id, x - (SELECT avg(x) FROM v) AS z FROM a),
 i AS (SELECT zi.b, (SELECT count(DISTINCT src) / sum(w) FROM w) * sum(w * zi.z * zj.z) / (SELECT sum(z * z) FROM z WHERE b = 0) AS i FROM w JOIN z zi ON zi.id = src JOIN z zj ON zj.id = dst AND zj.b = zi.b GROUP BY zi.b),
 o AS (SELECT i AS own FROM i WHERE b = 0)
SELECT round(any_value(own), 6) AS i, count(*) AS draws, sum(CASE WHEN round(i, 10) >= round(own, 10) THEN 1 ELSE 0 END)::BIGINT AS ge, round((sum(CASE WHEN round(i, 10) >= round(own, 10) THEN 1 ELSE 0 END) + 1.0) / (count(*) + 1), 6) AS p FROM i, o WHERE b > 0""")
def query_moran_permutation(spark, sf):
    v = supplier_values(spark, sf)
    return rounded(S.moran_permutations(v, queen_weights(v), 999), "i", "p")


_COND = """ k AS (SELECT sum(z * z) / count(*) AS m2, count(*) - 1 AS others FROM l), n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS nr FROM l),
 o AS (SELECT id AS t, nr AS own_at, z AS zt, degree, m2, others, z / m2 * lag AS i, 2 * degree >= others AS dense FROM n, k WHERE degree > 0), b AS (SELECT range AS b FROM range(1, 100)),
 a AS (SELECT o.*, b, unnest(range(1, CASE WHEN dense THEN others ELSE 4 * degree + 16 END + 1)) AS k FROM o, b),
 h AS (SELECT *, ('0x' || substr(md5('1|' || b || '|' || t || '|' || k), 1, 8))::BIGINT AS h FROM a),
 f AS (SELECT t, own_at, zt, degree, m2, i, b, CASE WHEN dense THEN k - 1 ELSE h % others END AS r, min(CASE WHEN dense THEN h ELSE k END) AS o FROM h GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY t, b ORDER BY o, r) AS n FROM f),
 s AS (SELECT t, b, i, zt / m2 * avg(n.z) AS sim FROM p JOIN n ON n.nr = p.r + CASE WHEN p.r >= own_at THEN 1 ELSE 0 END WHERE p.n <= p.degree GROUP BY t, b, i, zt, m2)
SELECT t AS id, round(i, 6) + 0.0 AS i, count(*) AS draws, sum(CASE WHEN round(abs(sim), 10) >= round(abs(i), 10) THEN 1 ELSE 0 END)::BIGINT AS ge, round((sum(CASE WHEN round(abs(sim), 10) >= round(abs(i), 10) THEN 1 ELSE 0 END) + 1.0) / (count(*) + 1), 6) AS p FROM s GROUP BY t, i"""


@query("lisa_cond_perm", f"WITH {NATIONS}, {QUEEN}, {WEIGHTS}, {LAGGED}, {_COND}")
def query_lisa_cond_perm(spark, sf):
    v = nation_values(spark, sf).select("id", "r", "c", "x")
    return rounded(S.local_permutations(v, queen_weights(v), 99), "i", "p")


@query("lisa_cond_perm_suppliers", f"WITH {SUPPLIERS}, {QUEEN}, {WEIGHTS}, {LAGGED}, {_COND}")
def query_lisa_cond_perm_suppliers(spark, sf):
    v = supplier_values(spark, sf)
    return rounded(S.local_permutations(v, queen_weights(v), 99), "i", "p")


@query("smooth_field", f"""WITH {NATIONS}, {QUEEN}, s AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM v),
 a AS (SELECT src AS id, avg(x) AS x FROM s JOIN v ON v.id = dst GROUP BY src), b AS (SELECT src AS id, avg(x) AS x FROM s JOIN a ON a.id = dst GROUP BY src)
SELECT id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) + 0.0 AS x FROM b""")
def query_smooth_field(spark, sf):
    v = nation_values(spark, sf)
    return rounded(S.standardised(S.smoothed(v, queen(v), 2)), "x")


@query("maup_two_levels", f"""WITH {NATIONS}, g AS (SELECT region AS id, sum(population) AS population, sum(observed) AS observed FROM v GROUP BY region), {QUEEN}, {WEIGHTS}, {LAGGED}, {MORAN},
 rv AS (SELECT id, observed::DOUBLE / population AS x FROM g), re AS (SELECT a.id AS src, b.id AS dst FROM rv a JOIN rv b ON (a.id - b.id + 5) % 5 IN (1, 4)),
 rz AS (SELECT id, x - avg(x) OVER () AS z FROM rv), rl AS (SELECT a.id, any_value(a.z) AS z, avg(b.z) AS lag FROM rz a JOIN re ON src = a.id JOIN rz b ON b.id = dst GROUP BY a.id)
SELECT 'nation' AS level, n, round(i, 6) + 0.0 AS i FROM moran UNION ALL SELECT 'region', count(*), round(sum(z * lag) / sum(z * z), 6) + 0.0 FROM rl""")
def query_maup_two_levels(spark, sf):
    v = nation_values(spark, sf)
    up = v.groupBy(F.col("region").alias("id")).agg((F.sum("observed").cast("double") / F.sum("population")).alias("x"))
    ring = up.select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % 5, (F.col("id") + 4) % 5)).alias("dst"))
    levels = [("nation", S.global_moran(v, queen_weights(v))), ("region", S.global_moran(up, S.row_weights(ring)))]
    parts = [m.select(F.lit(level).alias("level"), "n", "i") for level, m in levels]
    return rounded(parts[0].unionByName(parts[1]), "i")


@query("numerator_sensitivity", """WITH s AS (SELECT c_nationkey AS id, o_orderstatus AS series, count(*) AS n
FROM orders
JOIN customer ON c_custkey = o_custkey
GROUP BY ALL),
p AS (SELECT c_nationkey AS id, count(*) AS population
FROM customer
GROUP BY ALL),
t AS (SELECT series, s.id, n::DOUBLE / population AS rate
FROM s
JOIN p USING (id))
SELECT series, id, round(rate, 6) AS rate, round(rate / avg(rate) OVER (PARTITION BY series), 6) AS against_mean, rank() OVER (PARTITION BY series
ORDER BY round(rate, 9) DESC) AS place
FROM t""")
def query_numerator_sensitivity(spark, sf):
    from pyspark.sql import Window

    from arealith.sources.tables import table

    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    counts = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderstatus").alias("series"), "id").agg(F.count("*").alias("n"))
    t = counts.join(customer.groupBy("id").agg(F.count("*").alias("population")), "id").withColumn("rate", F.col("n").cast("double") / F.col("population"))
    by = Window.partitionBy("series")
    out = t.select("series", "id", "rate", (F.col("rate") / F.avg("rate").over(by)).alias("against_mean"), F.rank().over(by.orderBy(F.round("rate", 9).desc())).cast("long").alias("place"))
    return rounded(out, "rate", "against_mean")


@query("truth_crosstab", """SELECT source, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS clean, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) > count(*) / 2.0 AS mostly_good
FROM labels
JOIN documents USING (doc_id)
GROUP BY source""")
def query_truth_crosstab(spark, sf):
    from arealith.sources.tables import table

    m = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    one = lambda c, v: F.sum(F.when(F.col(c) == v, 1).otherwise(0))
    return m.groupBy("source").agg(one("toxic", 0).alias("clean"), one("toxic", 1).alias("toxic_"), (one("quality", 1) > F.count("*") / 2).alias("mostly_good")).withColumnRenamed("toxic_", "toxic")


def flagship(spark, sf):
    """LISA and Gi* of every nation."""
    v = nation_values(spark, sf)
    gi = S.gi_star(v, queen(v)).select("id", "gi", hot_cold(F.col("gi")).alias("label"))
    return rounded(S.local_moran(v, queen_weights(v)).join(gi, "id"), "x", "i", "p", "gi").select("id", "x", "i", "quadrant", "p", "gi", "label")


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""SELECT s.*, g.gi, CASE WHEN g.gi IS NULL THEN 'isolated' WHEN g.gi > 1.96 THEN 'hot' WHEN g.gi < -1.96 THEN 'cold' ELSE 'not significant' END AS label
FROM ({SQL['lisa']}) s
JOIN ({SQL['gi_star']}) g ON g.id = s.id"""

_I = lambda x: f"""(SELECT sum(z * lag) / sum(z * z)
FROM (SELECT a.id, any_value(a.z) AS z, avg(b.z) AS lag
FROM (SELECT id, x - avg(x) OVER () AS z
FROM {x}) a
JOIN e ON src = a.id
JOIN (SELECT id, x - avg(x) OVER () AS z
FROM {x}) b ON b.id = dst
GROUP BY a.id))"""  # noqa: E731


@query("sweep_monotone", f"""WITH {SUPPLIERS}, {QUEEN}, s AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM v), x1 AS (SELECT src AS id, avg(x) AS x FROM s JOIN v ON v.id = dst GROUP BY src), x2 AS (SELECT src AS id, avg(x) AS x FROM s JOIN x1 ON x1.id = dst GROUP BY src),
 i AS (SELECT 0 AS passes, {_I('v')} AS i UNION ALL SELECT 1, {_I('x1')} UNION ALL SELECT 2, {_I('x2')})
SELECT passes, round(i, 6) AS i, coalesce(round(i, 9) > lag(round(i, 9)) OVER (ORDER BY passes), true) AS rises FROM i""")
def query_sweep_monotone(spark, sf):
    from pyspark.sql import Window

    v = supplier_values(spark, sf)
    e, w, out = queen(v), queen_weights(v), None
    for passes in range(3):
        one = S.global_moran(S.smoothed(v.select("id", "x"), e, passes), w).select(F.lit(passes).alias("passes"), "i")
        out = one if out is None else out.union(one)
    rises = F.round("i", 9) > F.lag(F.round("i", 9)).over(Window.orderBy("passes"))  # a row for each pass
    return rounded(out.withColumn("rises", F.coalesce(rises, F.lit(True))), "i")


# ---- unit and weight sensitivity in full: every level and series, every definition of neighbours

_SERIES = {"care": "WHERE o_orderstatus = 'F'", "all": ""}
_RING = "e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON (a.id - b.id + 5) % 5 IN (1, 4))"


def _level_sql(level, series):
    cells = NATIONS.replace("oc AS (SELECT o_custkey, count(*) AS n FROM orders", f"oc AS (SELECT o_custkey, count(*) AS n FROM orders {_SERIES[series]}").replace("v AS (", "v0 AS (")
    if level == "nation":
        v, e = "v AS (SELECT id, r, c, x FROM v0)", QUEEN
    else:
        v, e = "v AS (SELECT region AS id, sum(observed)::DOUBLE / sum(population) AS x FROM v0 GROUP BY region)", _RING
    labels = "lb AS (SELECT CASE WHEN gi IS NULL THEN 'isolated' WHEN gi > 1.96 THEN 'hot' WHEN gi < -1.96 THEN 'cold' ELSE 'not significant' END AS label FROM gi)"
    lisa = SQL["lisa"].split(LAGGED, 1)[1].lstrip(",\n ")
    own = f"{cells}, {v}, {e}, {WEIGHTS}, {LAGGED}, {MORAN}, {_GI}, {labels}, lc AS (WITH {lisa})"
    counts = ", ".join(f"(SELECT count(*) FROM lb WHERE label = '{k}') AS {n}" for k, n in (("hot", "hot"), ("cold", "cold"), ("not significant", "neither"), ("isolated", "isolated")))
    return f"""(WITH {own} SELECT '{level}' AS level, '{series}' AS series, n, round(i, 6) + 0.0 AS i, round(p, 6) + 0.0 AS p, {counts}, (SELECT count(*)
FROM lc
WHERE p < 0.05) AS significant
FROM moran)"""


@query("maup_series", " UNION ALL ".join(f"SELECT * FROM {_level_sql(level, series)}" for level in ("nation", "region") for series in _SERIES))
def query_maup_series(spark, sf):
    """Moran's I with p, classes of Gi* and significant local p by level and series."""
    from arealith.sources.tables import cut, table

    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("all"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("care"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id")).join(orders, "c_custkey", "left")
    base = nation_values(spark, sf).select("id", "r", "c", "region", "population")
    base = cut(base.join(customer.groupBy("id").agg(F.coalesce(F.sum("all"), F.lit(0)).alias("all"), F.coalesce(F.sum("care"), F.lit(0)).alias("care")), "id", "left").na.fill(0))
    out = None
    for level in ("nation", "region"):
        for series in _SERIES:
            if level == "nation":
                v = base.select("id", "r", "c", F.coalesce(F.try_divide(F.col(series).cast("double"), F.col("population").cast("double")), F.lit(0.0)).alias("x"))
                e = queen(v)
            else:
                v = base.groupBy(F.col("region").alias("id")).agg((F.sum(series).cast("double") / F.sum("population")).alias("x"))
                e = v.select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % 5, (F.col("id") + 4) % 5)).alias("dst"))
            w = S.row_weights(e)
            label = S.gi_star(v, e).select(hot_cold(F.col("gi")).alias("label"))
            counts = label.agg(*(F.sum((F.col("label") == k).cast("long")).alias(n) for k, n in (("hot", "hot"), ("cold", "cold"), ("not significant", "neither"), ("isolated", "isolated"))))
            local = S.local_moran(v, w).agg(F.sum((F.round("p", 6) < 0.05).cast("long")).alias("significant"))
            one = S.global_moran(v, w).select(F.lit(level).alias("level"), F.lit(series).alias("series"), "n", "i", "p").crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(local))
            out = one if out is None else out.union(one)
    return rounded(out.na.fill({"significant": 0}), "i", "p")
