"""Queries of rates, ratios, joins, aggregates, windows, sets and balance checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arealith.functions import columns as C
from arealith.operators import audit as A
from arealith.operators.ranks import numbered, quantiles, running
from arealith.plans.areas import NATIONS, nation_counts, nation_values, rounded
from arealith.sources.tables import cut, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("nation_rate", f"WITH {NATIONS} SELECT id, name, round(observed * 100000.0 / nullif(population, 0), 6) AS rate FROM v")
def query_nation_rate(spark, sf):
    return rounded(nation_counts(spark, sf).select("id", "name", C.rate(F.col("observed"), F.col("population")).alias("rate")), "rate")


_SIR = """t AS (SELECT sum(observed)::DOUBLE / sum(population) AS crude
FROM v),
s AS (SELECT id, region, population, observed, crude * population AS expected, CASE WHEN crude * population > 0 THEN observed / (crude * population) ELSE 0 END AS sir
FROM v, t)"""


def _sir(spark, sf):
    v = nation_counts(spark, sf)
    crude = v.agg((F.sum("observed").cast("double") / F.sum("population")).alias("crude"))
    s = v.crossJoin(F.broadcast(crude)).withColumn("expected", F.col("crude") * F.col("population"))
    return s.withColumn("sir", C.ratio(F.col("observed"), F.col("expected")))


@query("nation_sir", f"WITH {NATIONS}, {_SIR} SELECT id, round(expected, 6) AS expected, round(sir, 6) AS sir, round(exp(-expected / 100), 6) AS p0 FROM s")
def query_nation_sir(spark, sf):
    return rounded(_sir(spark, sf).select("id", "expected", "sir", F.exp(-F.col("expected") / 100).alias("p0")), "expected", "sir", "p0")


@query("sir_bins", """WITH a AS (SELECT c_nationkey, c_mktsegment, count(*) AS pop FROM customer GROUP BY ALL), o AS (SELECT c_nationkey, c_mktsegment, count(*) AS obs FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
 t AS (SELECT a.*, coalesce(obs, 0) AS obs FROM a LEFT JOIN o USING (c_nationkey, c_mktsegment)), e AS (SELECT *, pop * (sum(obs) OVER ())::DOUBLE / (sum(pop) OVER ()) AS ex FROM t),
 b AS (SELECT obs, CASE WHEN ex > 0 AND ex <= 50 THEN 1 WHEN ex > 50 AND ex <= 100 THEN 2 WHEN ex > 100 AND ex <= 150 THEN 3 WHEN ex > 150 THEN 4 END AS bin, obs / ex AS sir FROM e)
SELECT bin, count(*) AS n, round(avg(sir), 6) AS mean_sir, round(avg(CASE WHEN sir > 1 THEN 100.0 ELSE 0 END), 6) AS share_above FROM b GROUP BY bin""")
def query_sir_bins(spark, sf):
    key = ["c_nationkey", "c_mktsegment"]
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))  # before they meet customers
    t = table(spark, sf, "customer").select("c_custkey", *key).join(orders, "c_custkey", "left").groupBy(*key).agg(F.count("*").alias("pop"), F.coalesce(F.sum("n"), F.lit(0)).alias("obs"))
    crude = t.agg((F.sum("obs").cast("double") / F.sum("pop")).alias("crude"))
    b = t.crossJoin(F.broadcast(crude)).withColumn("ex", F.col("pop") * F.col("crude")).select(C.cut_right(F.col("ex"), [0, 50, 100, 150, float("inf")]).alias("bin"), (F.col("obs") / F.col("ex")).alias("sir"))
    return rounded(b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("sir").alias("mean_sir"), F.avg(F.when(F.col("sir") > 1, 100.0).otherwise(0.0)).alias("share_above")), "mean_sir", "share_above")


@query("care_all_series", """SELECT n_nationkey AS id, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS care, count(o_orderkey) AS total
FROM nation
LEFT
JOIN customer ON c_nationkey = n_nationkey
LEFT
JOIN orders ON o_custkey = c_custkey
GROUP BY ALL""")
def query_care_all_series(spark, sf):
    by = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("care"), F.count("*").alias("total"))
    got = by.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("care").alias("care"), F.sum("total").alias("total"))
    return table(spark, sf, "nation").join(got, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("id"), F.coalesce("care", F.lit(0)).alias("care"), F.coalesce("total", F.lit(0)).alias("total"))


@query("zero_fill_parts", """SELECT p_partkey, count(l_orderkey) AS lines, round(coalesce(sum(l_quantity), 0), 6) AS quantity
FROM part
LEFT
JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R'
GROUP BY p_partkey""")
def query_zero_fill_parts(spark, sf):
    sold = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    out = table(spark, sf, "part").select("p_partkey").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").na.fill({"lines": 0, "quantity": 0.0})
    return rounded(out.select("p_partkey", "lines", "quantity"), "quantity")


@query("ffill_marker", """SELECT event_id, user_id, max_by_id AS marker FROM (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS max_by_id, event_type FROM events) WHERE event_type <> 'purchase'""")
def query_ffill_marker(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return e.withColumn("marker", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).filter("event_type <> 'purchase'").select("event_id", "user_id", "marker")


@query("coord_classify", """WITH t AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'north' WHEN 2 THEN '0' WHEN 3 THEN CAST(35.0 + s_suppkey % 7 AS VARCHAR) WHEN 4 THEN '20' ELSE NULL END AS lat, CASE s_suppkey % 6 WHEN 2 THEN '0.0' ELSE CAST(139 AS VARCHAR) END AS lon FROM supplier)
SELECT id, CASE WHEN trim(coalesce(lat, '')) = '' OR trim(coalesce(lon, '')) = '' THEN 'missing' WHEN try_cast(lat AS DOUBLE) IS NULL OR try_cast(lon AS DOUBLE) IS NULL THEN 'unparseable' WHEN try_cast(lat AS DOUBLE) = 0 AND try_cast(lon AS DOUBLE) = 0 THEN 'sentinel' WHEN try_cast(lat AS DOUBLE) > 20 AND try_cast(lat AS DOUBLE) < 46 AND try_cast(lon AS DOUBLE) > 122 AND try_cast(lon AS DOUBLE) < 154 THEN 'ok' ELSE 'out_of_range' END AS class FROM t""")
def query_coord_classify(spark, sf):
    k = F.col("s_suppkey") % 6
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, "").when(k == 1, "north").when(k == 2, "0").when(k == 3, (35.0 + F.col("s_suppkey") % 7).cast("string")).when(k == 4, "20").alias("lat"), F.when(k == 2, "0.0").otherwise("139").alias("lon"))
    return t.select("id", C.coordinate_class(F.col("lat"), F.col("lon")).alias("class"))


@query("code_prefixes", """SELECT s_suppkey AS id, lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code, substring(lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), 1, 2) AS parent, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN s_suppkey ELSE 0 END AS cell, regexp_replace(s_name, '^[^0-9]*', '') AS tail
FROM supplier""")
def query_code_prefixes(spark, sf):
    k = F.col("s_suppkey")
    cell = F.when(k % 3 == 0, "-").when(k % 3 == 1, k.cast("string"))
    return table(spark, sf, "supplier").select(k.alias("id"), F.lpad(k.cast("string"), 4, "0").alias("code"), C.parent_code(k).alias("parent"), C.safe_int(cell).alias("cell"), F.regexp_replace("s_name", "^[^0-9]*", "").alias("tail"))


@query("rollup_balance", """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT n_nationkey AS nation, n_regionkey AS region, sum(n)::BIGINT AS n FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT 'nation' AS level, CAST(nation AS VARCHAR) AS code, n FROM b UNION ALL SELECT 'region', CAST(region AS VARCHAR), sum(n)::BIGINT FROM b GROUP BY region UNION ALL SELECT 'all', 'all', sum(n)::BIGINT FROM b UNION ALL SELECT 'unbalanced', 'all', (SELECT count(*) FROM lineitem) - (SELECT sum(n) FROM b)::BIGINT""")
def query_rollup_balance(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"))
    by = orders.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    by = by.join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    levels = by.rollup("n_regionkey", "n_nationkey").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    named = levels.select(F.when(F.col("g") == 0, "nation").when(F.col("g") == 1, "region").otherwise("all").alias("level"), F.when(F.col("g") == 0, F.col("n_nationkey").cast("string")).when(F.col("g") == 1, F.col("n_regionkey").cast("string")).otherwise("all").alias("code"), "n")
    gap = table(spark, sf, "lineitem").agg(F.count("*").alias("t")).crossJoin(F.broadcast(by.agg(F.sum("n").alias("n")))).select(F.lit("unbalanced").alias("level"), F.lit("all").alias("code"), (F.col("t") - F.col("n")).alias("n"))
    return named.unionByName(gap)


@query("band_rollup", "SELECT p_brand AS code, " + ", ".join(f"count(CASE WHEN p_size > {10 * k} AND p_size <= {10 * k + 10} THEN 1 END) AS band{k + 1}" for k in range(5)) + ", count(*) - count(CASE WHEN p_size > 0 AND p_size <= 50 THEN 1 END) AS unknown, count(*) AS total, count(CASE WHEN p_size > 30 AND p_size <= 50 THEN 1 END) AS upper FROM part GROUP BY p_brand")
def query_band_rollup(spark, sf):
    bands = [F.count(F.when((F.col("p_size") > 10 * k) & (F.col("p_size") <= 10 * k + 10), 1)).alias(f"band{k + 1}") for k in range(5)]
    b = table(spark, sf, "part").groupBy(F.col("p_brand").alias("code")).agg(*bands, F.count("*").alias("total"))
    known = F.col("band1") + F.col("band2") + F.col("band3") + F.col("band4") + F.col("band5")
    return b.withColumn("unknown", F.col("total") - known).withColumn("upper", F.col("band4") + F.col("band5"))


@query("two_part_total", """SELECT l_linestatus AS code, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS kept, count(*) AS total, count(*) - count(CASE WHEN l_returnflag = 'R' THEN 1 END) - count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS diff
FROM lineitem
GROUP BY 1""")
def query_two_part_total(spark, sf):
    r = F.col("l_returnflag") == "R"
    t = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("code")).agg(F.count(F.when(r, 1)).alias("returned"), F.count(F.when(~r, 1)).alias("kept"), F.count("*").alias("total"))
    return t.withColumn("diff", F.col("total") - F.col("returned") - F.col("kept"))


@query("rel_diff_gate", """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s
FROM lineitem
GROUP BY 1),
t AS (SELECT o_orderkey AS code, o_totalprice AS reference, coalesce(s, 0) AS value
FROM orders
LEFT
JOIN l ON l_orderkey = o_orderkey),
d AS (SELECT code, CASE WHEN value = 0 AND reference = 0 THEN 0 WHEN reference = 0 THEN NULL ELSE abs(value - reference) / abs(reference) END AS diff
FROM t)
SELECT code, round(diff, 6) AS diff
FROM d
WHERE round(diff, 9) > 0.005""")
def query_rel_diff_gate(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    t = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("code"), C.relative_difference(F.coalesce("s", F.lit(0.0)), F.col("o_totalprice")).alias("diff"))
    return rounded(t.filter(F.round("diff", 9) > 0.005), "diff")


@query("reconciliation", """WITH a AS (SELECT c_nationkey AS code, count(*) AS orders
FROM orders
JOIN customer ON c_custkey = o_custkey
GROUP BY 1),
b AS (SELECT c_nationkey AS code, count(DISTINCT l_orderkey) AS with_lines
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
WHERE l_quantity > 10
GROUP BY 1)
SELECT n_nationkey AS code, coalesce(orders, 0) AS expected, coalesce(with_lines, 0) AS actual, coalesce(orders, 0) - coalesce(with_lines, 0) AS diff, CASE WHEN coalesce(orders, 0) < coalesce(with_lines, 0) THEN 'negative' ELSE '' END AS note
FROM nation
LEFT
JOIN a ON a.code = n_nationkey
LEFT
JOIN b ON b.code = n_nationkey""")
def query_reconciliation(spark, sf):
    owner = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    some = table(spark, sf, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda d, n: d.join(owner, F.col("o_custkey") == F.col("c_custkey")).groupBy("code").agg(F.count("*").alias(n))
    a, b = count(orders, "expected"), count(orders.join(some, "o_orderkey", "left_semi"), "actual")
    out = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code")).join(a, "code", "left").join(b, "code", "left").na.fill(0)
    return out.withColumn("diff", F.col("expected") - F.col("actual")).withColumn("note", F.when(F.col("diff") < 0, "negative").otherwise(""))


@query("audit_rows", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT 'orders by customer' AS \"check\", CAST(coalesce(a.k, b.k) AS VARCHAR) AS code, a.n AS expected, b.n AS actual, coalesce(b.n, 0) - coalesce(a.n, 0) AS diff FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def query_audit_rows(spark, sf):
    o = table(spark, sf, "orders")
    by = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return A.compared("orders by customer", by(o), by(o.filter("o_orderstatus <> 'P'")), "k", "n")


@query("coverage_audit", """SELECT c_custkey AS k, 'left only' AS side
FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey
FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'right only'
FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey
FROM customer)""")
def query_coverage_audit(spark, sf):
    return A.coverage(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("parent_check", "SELECT l_partkey AS child, count(DISTINCT l_suppkey) AS parents FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def query_parent_check(spark, sf):
    return A.one_parent(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("child"), "l_suppkey"), "child", "l_suppkey")


@query("spearman", f"""WITH {NATIONS}, r AS (SELECT rank() OVER (ORDER BY population) + (count(*) OVER (PARTITION BY population) - 1) / 2.0 AS a, rank() OVER (ORDER BY observed) + (count(*) OVER (PARTITION BY observed) - 1) / 2.0 AS b
FROM v)
SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS r
FROM r""")
def query_spearman(spark, sf):
    v = nation_counts(spark, sf).select("id", "population", "observed")
    return rounded(A.correlation(A.average_ranks(A.average_ranks(v, "population", "a"), "observed", "b"), "a", "b"), "r")


@query("five_number", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for q, n in ((0, "least"), (0.25, "lower"), (0.5, "middle"), (0.75, "upper"), (1, "most"))) + " FROM lineitem GROUP BY 1")
def query_five_number(spark, sf):
    shares = {"least": 0.0, "lower": 0.25, "middle": 0.5, "upper": 0.75, "most": 1.0}
    return rounded(quantiles(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", shares), *shares)


@query("top_areas_listagg", f"""WITH {NATIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY region
ORDER BY observed DESC, name) AS k, count(*) OVER (PARTITION BY region) AS n
FROM v)
SELECT region, string_agg(name, ', '
ORDER BY k) || CASE WHEN any_value(n) > 3 THEN ' etc.' ELSE '' END AS top
FROM k
WHERE k <= 3
GROUP BY region""")
def query_top_areas_listagg(spark, sf):
    g = nation_counts(spark, sf).groupBy("region").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("observed")).alias("o"), "name"))), 1, 3).alias("t"), F.count("*").alias("n"))
    return g.select("region", F.concat(F.array_join("t.name", ", "), F.when(F.col("n") > 3, " etc.").otherwise("")).alias("top"))


@query("rank_min", """SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey
ORDER BY round(s_acctbal, 0) DESC) AS place, dense_rank() OVER (PARTITION BY s_nationkey
ORDER BY round(s_acctbal, 0) DESC) AS dense
FROM supplier""")
def query_rank_min(spark, sf):
    """Places among a nation's suppliers: counts of distinct values are added up by ranges, no window holds a nation."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", (-F.round("s_acctbal", 0)).alias("v"))
    values = rows.groupBy("s_nationkey", "v").agg(F.count("*").alias("c"))
    at = cut(numbered(running(values, ["s_nationkey", "v"], F.col("c"), "above"), "at", "s_nationkey", "v"))
    first = at.groupBy("s_nationkey").agg(F.min("above").alias("above0"), F.min("at").alias("at0"))
    places = at.join(first, "s_nationkey").select("s_nationkey", "v", (F.col("above") - F.col("above0") + 1).alias("place"), (F.col("at") - F.col("at0") + 1).alias("dense"))
    return rows.join(places, ["s_nationkey", "v"]).select("s_suppkey", "s_nationkey", "place", "dense")


@query("topk_per_group", "SELECT s_nationkey, s_suppkey, s_acctbal, k FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k <= 2")
def query_topk_per_group(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    return table(spark, sf, "supplier").withColumn("k", F.row_number().over(w).cast("long")).filter("k <= 2").select("s_nationkey", "s_suppkey", "s_acctbal", "k")


@query("top_and_bottom", """(SELECT 'top' AS side, o_orderkey, o_totalprice
FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 8)
UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice
FROM orders
ORDER BY o_totalprice, o_orderkey LIMIT 8)""")
def query_top_and_bottom(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    top = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(8).select(F.lit("top").alias("side"), "*")
    return top.union(o.orderBy("o_totalprice", "o_orderkey").limit(8).select(F.lit("bottom"), "*"))


@query("set_ops", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'minus' AS op, count(*) AS n FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)) UNION ALL SELECT 'both', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def query_set_ops(spark, sf):
    pick = lambda s: table(spark, sf, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct()
    a, b = pick("F"), pick("O")
    parts = {"minus": a.subtract(b), "symmetric": a.subtract(b).union(b.subtract(a)), "both": a.intersect(b), "either": a.union(b).distinct()}
    out = None
    for name, d in parts.items():
        one = d.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("ordered_labels", f"""WITH {NATIONS} SELECT id, name, row_number() OVER (ORDER BY round(x, 9), name) AS place, CASE WHEN round(x, 9) > lag(round(x, 9)) OVER (ORDER BY round(x, 9), name) THEN true ELSE false END AS rises
FROM v""")
def query_ordered_labels(spark, sf):
    w = Window.orderBy(F.round("x", 9), "name")  # areas: one row for each nation
    return nation_values(spark, sf).select("id", "name", F.row_number().over(w).cast("long").alias("place"), F.coalesce(F.round("x", 9) > F.lag(F.round("x", 9)).over(w), F.lit(False)).alias("rises"))


@query("shrinkage", f"""WITH {NATIONS}, {_SIR}, p AS (SELECT *, (observed + 10) / (expected + 10) AS rr
FROM s)
SELECT id, round(CASE WHEN round(sir, 9) <> 1 THEN abs(rr - 1) / abs(sir - 1) END, 6) AS shrinkage, round(greatest(0.9, least(1.1, sir)), 6) AS clamped
FROM p""")
def query_shrinkage(spark, sf):
    s = _sir(spark, sf).withColumn("rr", (F.col("observed") + 10) / (F.col("expected") + 10))
    out = s.select("id", F.when(F.round("sir", 9) != 1, F.abs(F.col("rr") - 1) / F.abs(F.col("sir") - 1)).alias("shrinkage"), C.clamp(F.col("sir"), 0.9, 1.1).alias("clamped"))
    return rounded(out, "shrinkage", "clamped")


@query("elderly_share", "SELECT c_nationkey AS id, round(10.0 * avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END), 6) AS share10 FROM customer GROUP BY 1")
def query_elderly_share(spark, sf):
    return rounded(table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg((10.0 * F.avg(F.when(F.col("c_acctbal") > 5000, 1.0).otherwise(0.0))).alias("share10")), "share10")


@query("route_rows", """SELECT CASE WHEN p_size % 10 = 1 THEN 'nation' WHEN p_size % 10 IN (0, 2, 3) THEN 'municipality' WHEN p_size % 10 IN (4, 9) THEN 'skipped' ELSE 'error' END AS level, count(*) AS n, min(p_partkey) AS first_id
FROM part
GROUP BY 1""")
def query_route_rows(spark, sf):
    k = F.col("p_size") % 10
    level = F.when(k == 1, "nation").when(k.isin(0, 2, 3), "municipality").when(k.isin(4, 9), "skipped").otherwise("error")
    return table(spark, sf, "part").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


@query("explode_mapping", """WITH g AS (SELECT s_nationkey AS area, string_agg(CAST(s_suppkey AS VARCHAR), ', '
ORDER BY s_suppkey) AS members
FROM supplier
GROUP BY 1),
m AS (SELECT area, CAST(trim(unnest(string_split(members, ','))) AS BIGINT) AS member
FROM g),
t AS (SELECT l_suppkey AS member, count(*) AS n
FROM lineitem
GROUP BY 1)
SELECT area, count(*) AS members, coalesce(sum(n), 0)::BIGINT AS lines, count(*) - count(DISTINCT member) AS repeated
FROM m
LEFT
JOIN t USING (member)
GROUP BY area""")
def query_explode_mapping(spark, sf):
    lists = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ", ").alias("members"))
    m = lists.select("area", F.explode(F.split("members", ",")).alias("m")).select("area", F.trim("m").cast("long").alias("member"))
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("member")).agg(F.count("*").alias("n"))
    return m.join(t, "member", "left").groupBy("area").agg(F.count("*").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), (F.count("*") - F.countDistinct("member")).alias("repeated"))


# ---- fixed base rates, days with most events, mapped orders, counts of rows and totals


@query("fixed_base_ratio", f"""WITH {NATIONS} SELECT id, round(population * 0.008::DOUBLE, 6) AS expected, round(CASE WHEN population > 0 THEN observed / (population * 0.008::DOUBLE) ELSE 0 END, 6) AS ratio
FROM v""")
def query_fixed_base_ratio(spark, sf):
    """Expected counts from a fixed base rate of 800 in 100,000."""
    v = nation_counts(spark, sf).withColumn("expected", F.col("population") * 0.008)
    return rounded(v.select("id", "expected", C.ratio(F.col("observed"), F.col("expected")).alias("ratio")), "expected", "ratio")


@query("busiest_day", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n
FROM events
GROUP BY ALL)
SELECT event_type, max(n) AS most, min(CASE WHEN n = top THEN day END) AS day
FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS top
FROM d)
GROUP BY event_type""")
def query_busiest_day(spark, sf):
    """Each type's day with most events; of equal days the first."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    best = F.max_by("day", F.struct("n", (-F.unix_date("day")).alias("early")))
    return d.groupBy("event_type").agg(F.max("n").alias("most"), best.alias("day"))


_MAPPED = {"MACHINERY": 1, "BUILDING": 2, "HOUSEHOLD": 3}


@query("mapped_order", """SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey
ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 9 END, c_mktsegment, c_custkey) AS place
FROM customer""")
def query_mapped_order(spark, sf):
    """Rows in an order that a mapping of a column gives; values without a place come last, by name."""
    place = F.coalesce(F.create_map(*(F.lit(x) for kv in _MAPPED.items() for x in kv))[F.col("c_mktsegment")], F.lit(9))
    rows = table(spark, sf, "customer").select("c_nationkey", place.alias("rank"), "c_mktsegment", "c_custkey")
    at = cut(numbered(rows, "at", "c_nationkey", "rank", "c_mktsegment", "c_custkey"))
    first = at.groupBy("c_nationkey").agg(F.min("at").alias("first"))
    return at.join(first, "c_nationkey").select("c_mktsegment", "c_custkey", (F.col("at") - F.col("first") + 1).alias("place"))


@query("row_count_checks", """SELECT * FROM (SELECT 'regions' AS "check", 5::BIGINT AS expected, count(*) AS actual FROM region UNION ALL SELECT 'nations', 25, count(*) FROM nation UNION ALL SELECT 'one nation of code 0', 1, count(*) FROM nation WHERE n_nationkey = 0
UNION ALL SELECT 'customers as ids', (SELECT count(DISTINCT c_custkey) FROM customer), count(*) FROM customer UNION ALL SELECT 'suppliers as ids', (SELECT count(DISTINCT s_suppkey) FROM supplier), count(*) FROM supplier)""")
def query_row_count_checks(spark, sf):
    """Tables that must have an exact number of rows, as expected and actual counts."""
    one = lambda name, expected, df: df.agg(F.lit(name).alias("check"), expected.cast("long").alias("expected"), F.count("*").alias("actual"))
    nation = table(spark, sf, "nation")
    parts = [
        one("regions", F.lit(5), table(spark, sf, "region")),
        one("nations", F.lit(25), nation),
        one("one nation of code 0", F.lit(1), nation.filter("n_nationkey = 0")),
        one("customers as ids", F.countDistinct("c_custkey"), table(spark, sf, "customer")),
        one("suppliers as ids", F.countDistinct("s_suppkey"), table(spark, sf, "supplier")),
    ]
    return A.report(parts)


@query("roster_checks", f"""WITH {NATIONS}, t AS (SELECT sum(population)::BIGINT AS people, sum(observed)::BIGINT AS orders, count(*) AS entries, count(CASE WHEN population = 0 THEN 1 END) AS without, sum(observed - population)::BIGINT AS difference FROM v),
known AS (SELECT DISTINCT c_nationkey AS code FROM customer)
SELECT 'people of entries and of the roster' AS "check", people = (SELECT count(*) FROM customer) AS ok FROM t UNION ALL SELECT 'orders of entries and of the roster', orders = (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) FROM t
UNION ALL SELECT 'every entry once', entries = 25 FROM t UNION ALL SELECT 'totals do not fall short', difference >= 0 FROM t UNION ALL SELECT 'no unknown marker', (SELECT count(*) FROM known WHERE code NOT IN (SELECT id FROM v)) = 0 UNION ALL SELECT 'no marker missing', without = 0 FROM t""")
def query_roster_checks(spark, sf):
    """Checks of a roster's entries against its rows: totals, entries, markers."""
    v = nation_counts(spark, sf)
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    facts = v.agg(F.sum("population").alias("people"), F.sum("observed").alias("orders"), F.count("*").alias("entries"), F.sum((F.col("population") == 0).cast("long")).alias("without"), F.sum(F.col("observed") - F.col("population")).alias("difference"))
    rows = [customer.agg(F.count("*").alias("rows")), orders.join(customer, "c_custkey", "left_semi").agg(F.count("*").alias("order_rows")), customer.select("id").distinct().join(v.select("id"), "id", "left_anti").agg(F.count("*").alias("unknown"))]
    for r in rows:
        facts = facts.crossJoin(F.broadcast(r))
    checks = [
        ("people of entries and of the roster", F.col("people") == F.col("rows")),
        ("orders of entries and of the roster", F.col("orders") == F.col("order_rows")),
        ("every entry once", F.col("entries") == 25),
        ("totals do not fall short", F.col("difference") >= 0),
        ("no unknown marker", F.col("unknown") == 0),
        ("no marker missing", F.col("without") == 0),
    ]
    return facts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in checks))).alias("c")).select("c.*")


_WIDTH, _BANDS = 525, 21
_BAND_SQL = ", ".join(f"count(CASE WHEN c_acctbal > {_WIDTH * k - 1000} AND c_acctbal <= {_WIDTH * k + _WIDTH - 1000} THEN 1 END) AS band{k + 1}" for k in range(_BANDS))


@query("bands_of_all_areas", f"""WITH b AS (SELECT c_nationkey AS code, {_BAND_SQL}, count(*) AS total
FROM customer
GROUP BY c_nationkey),
u AS (SELECT *, total - ({' + '.join(f'band{k + 1}' for k in range(_BANDS))}) AS unknown
FROM b)
SELECT *, unknown < 0 AS fault
FROM u
UNION ALL SELECT NULL, {', '.join(f'sum(band{k + 1})::BIGINT' for k in range(_BANDS))}, sum(total)::BIGINT, sum(unknown)::BIGINT, sum(unknown) < 0
FROM u""")
def query_bands_of_all_areas(spark, sf):
    """Counts of 21 bands by area and, added band by band, of all areas (code null); what no band holds must not be negative."""
    x = F.col("c_acctbal")
    bands = [f"band{k + 1}" for k in range(_BANDS)]
    of = [F.count(F.when((x > _WIDTH * k - 1000) & (x <= _WIDTH * k + _WIDTH - 1000), 1)).alias(b) for k, b in enumerate(bands)]
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(*of, F.count("*").alias("total"))
    b = b.withColumn("unknown", F.col("total") - sum((F.col(k) for k in bands[1:]), F.col(bands[0])))
    whole = b.groupBy(F.lit(None).cast("int").alias("code")).agg(*(F.sum(k).alias(k) for k in [*bands, "total", "unknown"]))
    return b.union(whole).withColumn("fault", F.col("unknown") < 0)


@query("mapping_repeats", """WITH g AS (SELECT l_partkey AS area, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ') AS members
FROM lineitem
GROUP BY 1),
m AS (SELECT area, CAST(trim(unnest(string_split(members, ','))) AS BIGINT) AS member
FROM g)
SELECT member, count(*) AS areas, min(area) AS first_area
FROM m
GROUP BY member HAVING count(*) > 1""")
def query_mapping_repeats(spark, sf):
    """Members of comma lists that more than one area names: such keys are errors of a mapping, not counts."""
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("area")).agg(F.array_join(F.collect_set(F.col("l_suppkey").cast("string")), ", ").alias("members"))
    m = lists.select("area", F.explode(F.split("members", ",")).alias("m")).select("area", F.trim("m").cast("long").alias("member"))
    return A.require_unique(m, "member").join(m.groupBy("member").agg(F.min("area").alias("first_area")), "member").select("member", F.col("n").alias("areas"), "first_area")
