"""Area tables out of the driver's tables: nations as a 5 x 5 lattice, suppliers as one of ten columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealith.operators.spatial import lattice_edges, row_weights
from arealith.sources.tables import cut, table


def nation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, r, c, name, region, population, observed)``: customers and their orders of each nation.

    Orders are counted by customer before they meet customers, and by nation before they meet nations.
    """
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("population"), F.sum("n").alias("observed"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.expr("n_nationkey div 5").alias("r"), (F.col("n_nationkey") % 5).cast("long").alias("c"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    out = nation.join(people, F.col("id") == F.col("c_nationkey"), "left")
    out = out.select("id", "r", "c", "name", "region", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("population", "observed")))
    return cut(out)  # statistics use the areas many times; the facts are read once


def nation_values(spark: SparkSession, sf: str) -> DataFrame:
    """Areas with ``x``, orders per customer."""
    return nation_counts(spark, sf).withColumn("x", F.coalesce(F.try_divide(F.col("observed").cast("double"), F.col("population").cast("double")), F.lit(0.0)))


def supplier_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("s_suppkey div 10").alias("r"), (F.col("s_suppkey") % 10).alias("c"), F.col("s_acctbal").alias("x"))


def queen(areas: DataFrame) -> DataFrame:
    return lattice_edges(areas.select("id", "r", "c"), True)


def queen_weights(areas: DataFrame) -> DataFrame:
    return row_weights(queen(areas))


#: DuckDB: the same tables as common table expressions.
NATIONS = """
oc AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
pe AS (SELECT c_nationkey, count(*) AS population, sum(n) AS observed FROM customer LEFT JOIN oc ON o_custkey = c_custkey GROUP BY c_nationkey),
v AS (SELECT n_nationkey AS id, n_nationkey // 5 AS r, n_nationkey % 5 AS c, n_name AS name, n_regionkey AS region,
        coalesce(population, 0)::BIGINT AS population, coalesce(observed, 0)::BIGINT AS observed,
        coalesce(observed::DOUBLE / nullif(population, 0), 0) AS x
      FROM nation LEFT JOIN pe ON c_nationkey = n_nationkey)"""
SUPPLIERS = "v AS (SELECT s_suppkey AS id, s_suppkey // 10 AS r, s_suppkey % 10 AS c, s_acctbal AS x FROM supplier)"
QUEEN = "e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id)"
ROOK = "e AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON abs(a.r - b.r) + abs(a.c - b.c) = 1)"
WEIGHTS = "w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)"
LAGGED = """
z AS (SELECT id, x, x - avg(x) OVER () AS z FROM v),
l AS (SELECT z.id, z.x, z.z, coalesce(sum(w.w * j.z), 0) AS lag, count(w.dst) AS degree, coalesce(sum(w.w), 0) AS w1, coalesce(sum(w.w * w.w), 0) AS w2
      FROM z LEFT JOIN w ON w.src = z.id LEFT JOIN z j ON j.id = w.dst GROUP BY z.id, z.x, z.z)"""


def erfc_sql(x: str) -> str:
    from arealith.functions.columns import ERFC

    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    inner = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        inner = f"({c} + {t} * {inner})"
    tail = f"{t} * exp(-({x}) * ({x}) + {inner})"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2.0 - {tail} END)"


MORAN = f"""
sw AS (SELECT sum(w.w) AS s0, sum(w.w * w.w + w.w * coalesce(b.w, 0)) AS s1 FROM w LEFT JOIN w b ON b.src = w.dst AND b.dst = w.src),
s2 AS (SELECT sum(t * t) AS s2 FROM (SELECT id, sum(w) AS t FROM (SELECT src AS id, w FROM w UNION ALL SELECT dst, w FROM w) GROUP BY id)),
s AS (SELECT count(*)::DOUBLE AS n_all, sum(CASE WHEN degree > 0 THEN 1 ELSE 0 END)::DOUBLE AS n_used, sum(z * lag) AS crossed, sum(z * z) AS ss, sum(z * z * z * z) AS s4 FROM l),
m AS (SELECT n, n / s0 * crossed / ss AS i, -1.0 / (n - 1) AS expected, n_all * s4 / (ss * ss) AS k, s0, s1, s2.s2 FROM (SELECT *, n_used AS n FROM s), sw, s2),
mv AS (SELECT n::BIGINT AS n, i, expected, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected AS variance FROM m),
mz AS (SELECT *, (i - expected) / sqrt(variance) AS zscore FROM mv),
moran AS (SELECT n, i, expected, variance, zscore, 0.5 * {erfc_sql("(zscore / sqrt(2.0))")} AS p FROM mz)"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Named columns rounded, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})
