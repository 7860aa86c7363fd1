"""Queries of count models, smoothing, streaming counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealith.operators import models as M
from arealith.operators import spatial as S
from arealith.operators.scan import clusters
from arealith.operators.standard import standardised
from arealith.plans.areas import LAGGED, MORAN, NATIONS, QUEEN, SUPPLIERS, WEIGHTS, nation_counts, queen, queen_weights, rounded, supplier_values
from arealith.sources.tables import cut, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _counts(spark, sf):
    v = nation_counts(spark, sf)
    crude = v.agg((F.sum("observed").cast("double") / F.sum("population")).alias("crude"))
    return v.crossJoin(F.broadcast(crude)).withColumn("expected", 0.9 * F.col("crude") * F.col("population")).drop("crude")


_GLM = """ex AS (SELECT id, observed, 0.9::DOUBLE * (SELECT sum(observed)::DOUBLE / sum(population)
FROM v0) * population AS expected
FROM v0),
g AS (SELECT ln(sum(observed) / sum(expected)) AS intercept, 1 / sqrt(sum(observed)) AS se
FROM ex)"""


@query("glm_intercept_resid_moran", f"""WITH {NATIONS.replace('v AS', 'v0 AS')}, {_GLM}, v AS (SELECT v0.id, r, c, (ex.observed - expected * exp(intercept)) / sqrt(expected * exp(intercept)) AS x
FROM v0
JOIN ex ON ex.id = v0.id, g), {QUEEN}, {WEIGHTS}, {LAGGED}, {MORAN} SELECT round(intercept, 6) AS intercept, round(se, 6) AS se, n, round(i, 6) + 0.0 AS i, round(p, 6) + 0.0 AS p
FROM g, moran""")
def query_glm_intercept_resid_moran(spark, sf):
    counts = _counts(spark, sf)
    fit = M.intercept_glm(counts)
    m = S.global_moran(M.pearson_residuals(counts, fit), queen_weights(counts)).select("n", "i", "p")
    return rounded(fit.crossJoin(F.broadcast(m)), "intercept", "se", "i", "p")


_RICH = """ri AS (SELECT c_nationkey AS id, 10 * avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s
FROM customer
GROUP BY 1),
d AS (SELECT observed::DOUBLE AS y, expected AS e, s
FROM ex
JOIN ri USING (id)
WHERE expected > 0)"""


def _newton_sql(steps: int = 12) -> str:
    """Newton steps of the two coefficients, one table each."""
    out = "n0 AS (SELECT ln(sum(y) / sum(e)) AS a, 0.0::DOUBLE AS b FROM d)"
    for k in range(steps):
        out += f""", s{k} AS (SELECT a, b, sum(m) AS m0, sum(m * s) AS m1, sum(m * s * s) AS m2, sum(y - m) AS r0, sum((y - m) * s) AS r1
FROM (SELECT *, e * exp(a + b * s) AS m
FROM d, n{k})
GROUP BY a, b), n{k + 1} AS (SELECT a + (m2 * r0 - m1 * r1) / (m0 * m2 - m1 * m1) AS a, b + (m0 * r1 - m1 * r0) / (m0 * m2 - m1 * m1) AS b
FROM s{k})"""
    return out + f", f AS (SELECT 'intercept' AS term, a AS v FROM n{steps} UNION ALL SELECT 'share10', b FROM n{steps})"


@query("glm_covariate", f"WITH {NATIONS.replace('v AS', 'v0 AS')}, {_GLM}, {_RICH}, {_newton_sql()} SELECT term, round(v, 5) AS coefficient, round(exp(v), 5) AS rate_ratio FROM f")
def query_glm_covariate(spark, sf):
    rich = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg((10 * F.avg(F.when(F.col("c_acctbal") > 5000, 1.0).otherwise(0.0))).alias("share10"))
    return rounded(M.covariate_glm(_counts(spark, sf).join(rich, "id"), ["share10"]), "coefficient", "rate_ratio", digits=5)


_RETURNED = """ct AS (SELECT l_suppkey AS id, count(*) AS lines, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS observed
FROM lineitem
GROUP BY 1),
co AS (SELECT v.id, observed, lines * (SELECT sum(observed)::DOUBLE / sum(lines)
FROM ct) AS expected
FROM v
JOIN ct ON ct.id = v.id)"""


_PROBES = 16


def _smooth_sql(model: str, columns: str) -> str:
    """Modes by hundreds of damped rounds of all areas at once, variances by 60 rounds for each hashed vector of signs: other ways to the same bounds."""
    pull, rest, s2, rounds = (0.9, 0.1, 0.0, 400) if model == "leroux" else (1.0, 0.0, 0.1, 1500)
    own = "own + 0.5 * (observed - m - own / 0.1) / (m + 1 / 0.1)" if model == "bym" else "own"
    sign = "CASE WHEN (('0x' || substr(md5(id || '|' || k), 1, 8))::BIGINT + 0.5) / 4294967296.0 < 0.5 THEN 1.0 ELSE -1.0 END::DOUBLE"
    return f"""WITH RECURSIVE {SUPPLIERS}, {QUEEN}, {_RETURNED}, ed AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM co) AND dst IN (SELECT id FROM co)), dg AS (SELECT src AS id, count(*) AS degree FROM ed GROUP BY 1),
a AS (
  SELECT 0 AS round, id, observed, expected, degree, (SELECT ln(sum(observed)::DOUBLE / sum(expected)) FROM co) AS level, 0.0::DOUBLE AS effect, 0.0::DOUBLE AS own FROM co JOIN dg USING (id)
  UNION ALL
  SELECT round + 1, id, observed, expected, degree, level, effect + 0.5 * (observed - m - ({pull} * (degree * effect - around) + {rest} * effect) / 0.5) / (m + ({pull} * degree + {rest}) / 0.5), {own}
  FROM (SELECT x.*, b.around, expected * exp(level + effect + own) AS m FROM a x JOIN (SELECT src, sum(y.effect) AS around FROM ed JOIN a y ON y.id = ed.dst GROUP BY src) b ON b.src = x.id WHERE round < {rounds})
), mo AS (SELECT *, expected * exp(level + effect + own) AS m FROM a WHERE round = {rounds}), di AS (SELECT *, m / (1 + {s2} * m) + ({pull} * degree + {rest}) / 0.5 AS d FROM mo),
z AS (
  SELECT 0 AS round, id, k, d, {sign} AS v, 0.0::DOUBLE AS x FROM di, unnest(range({_PROBES})) u(k)
  UNION ALL
  SELECT round + 1, z1.id, z1.k, d, v, (v + {pull} / 0.5 * around) / d FROM z z1 JOIN (SELECT src, y.k, sum(y.x) AS around FROM ed JOIN z y ON y.id = ed.dst GROUP BY src, y.k) b ON b.src = z1.id AND b.k = z1.k WHERE round < 60
), va AS (SELECT id, avg(v * x) AS mean FROM z WHERE round = 60 GROUP BY id),
sp AS (SELECT id, observed, expected, level, effect + own AS effect, m, sqrt({s2} / (1 + {s2} * m) + greatest(mean, 1 / d) / pow(1 + {s2} * m, 2)) AS sd FROM di JOIN va USING (id)),
ri AS (SELECT id, observed, expected, effect, exp(level + effect) AS risk, sd, exp(level + effect - 1.959963984540054 * sd) AS low, exp(level + effect + 1.959963984540054 * sd) AS high FROM sp)
{columns}"""


def _smooth(spark, sf, model):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("lines"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("observed"))
    share = lines.agg((F.sum("observed").cast("double") / F.sum("lines")).alias("share"))
    v = supplier_values(spark, sf)
    counts = cut(v.select("id").join(lines, "id").crossJoin(F.broadcast(share)).select("id", "observed", (F.col("lines") * F.col("share")).alias("expected")))
    edges = cut(queen(v).join(counts.select(F.col("id").alias("src")), "src", "left_semi").join(counts.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return M.smoothed_risk(counts, edges, model, probes=_PROBES)


_RISKS = "SELECT id, observed, round(expected, 6) AS expected, round(effect, 6) + 0.0 AS effect, round(risk, 6) AS risk, round(sd, 6) AS sd, round(low, 6) AS low, round(high, 6) AS high FROM ri"


@query("car_leroux", _smooth_sql("leroux", _RISKS))
def query_car_leroux(spark, sf):
    return rounded(_smooth(spark, sf, "leroux"), "expected", "effect", "risk", "sd", "low", "high")


@query("bym", _smooth_sql("bym", _RISKS))
def query_bym(spark, sf):
    return rounded(_smooth(spark, sf, "bym"), "expected", "effect", "risk", "sd", "low", "high")


@query("smoothing_information", _smooth_sql("leroux", """, f AS (SELECT sum(-2 * (observed * ln(expected * risk) - expected * risk - lgamma(observed + 1))) AS deviance, sum(expected * risk * sd * sd) AS parameters FROM ri)
SELECT round(deviance, 4) AS deviance, round(parameters, 4) AS parameters, round(deviance + 2 * parameters, 4) AS dic FROM f"""))
def query_smoothing_information(spark, sf):
    """Deviance, effective parameters and their sum of the smoothed risks."""
    return rounded(M.information(_smooth(spark, sf, "leroux")), "deviance", "parameters", "dic", digits=4)


_DRAWS, _RADIUS, _CLUSTERS = 19, 12.0, 3


def _scan_sql() -> str:
    llr = lambda o, e, t: f"CASE WHEN {o} * ({t} - {e}) > ({t} - {o}) * {e} THEN CASE WHEN {o} > 0 THEN {o} * ln({o} / {e}) ELSE 0 END + CASE WHEN {t} - {o} > 0 THEN ({t} - {o}) * ln(({t} - {o}) / ({t} - {e})) ELSE 0 END ELSE 0 END"
    out = f"""WITH {SUPPLIERS}, ct AS (SELECT l_suppkey AS id, count(*) AS people, count(CASE WHEN l_returnflag = 'R' AND l_quantity > 46 THEN 1 END) AS cases FROM lineitem GROUP BY 1),
ar AS (SELECT v.id, r::DOUBLE AS y, c::DOUBLE AS x, coalesce(people, 0)::BIGINT AS people, coalesce(cases, 0)::BIGINT AS cases FROM v LEFT JOIN ct USING (id)),
pe AS (SELECT *, (sum(people) OVER (ORDER BY id) - people)::BIGINT AS first FROM ar), wh AS (SELECT sum(people)::BIGINT AS all_people, sum(cases)::BIGINT AS all_cases FROM ar),
ca AS (SELECT draw, ('0x' || substr(md5('1|' || draw || '|' || id || '|' || k), 1, 12))::BIGINT % all_people AS person FROM (SELECT id, unnest(range(1, cases + 1)) AS k FROM ar), range(1, {_DRAWS + 1}) t(draw), wh),
hi AS (SELECT draw, id, count(*) AS cases FROM ca ASOF JOIN (SELECT id, first FROM pe WHERE people > 0) q ON ca.person >= q.first GROUP BY ALL),
co AS (SELECT 0 AS draw, id, people, cases FROM ar UNION ALL SELECT draw, ar.id, people, coalesce(hi.cases, 0) FROM ar CROSS JOIN range(1, {_DRAWS + 1}) t(draw) LEFT JOIN hi USING (draw, id)),
ne AS (SELECT a.id AS centre, b.id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM ar a JOIN ar b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {_RADIUS**2}),
su AS (SELECT DISTINCT draw, centre, d2, count(*) OVER w AS areas, sum(people) OVER w AS people, (sum(cases) OVER w)::BIGINT AS cases FROM ne JOIN co USING (id) WINDOW w AS (PARTITION BY draw, centre ORDER BY d2)),
wi AS (SELECT draw, centre, d2, areas, cases, expected, round({llr("cases", "expected", "all_cases")}, 9) AS llr
 FROM (SELECT *, all_cases::DOUBLE * people / all_people AS expected FROM su, wh WHERE people <= 0.5 * all_people)),
le AS (SELECT draw, max(llr) AS top FROM wi WHERE draw > 0 GROUP BY draw), f1 AS (SELECT * FROM wi WHERE draw = 0 AND llr > 0)"""
    for k in range(1, _CLUSTERS + 1):
        out += f""", b{k} AS (SELECT * FROM f{k} ORDER BY llr DESC, d2, centre LIMIT 1), t{k} AS (SELECT id FROM ne JOIN b{k} ON ne.centre = b{k}.centre AND ne.d2 <= b{k}.d2),
f{k + 1} AS (SELECT f.* FROM f{k} f WHERE NOT EXISTS (FROM ne JOIN t{k} USING (id) WHERE ne.centre = f.centre AND ne.d2 <= f.d2))"""
    rows = " UNION ALL ".join(f"SELECT {k} AS rank, * FROM b{k}" for k in range(1, _CLUSTERS + 1))
    return f"""{out} SELECT rank, centre, d2, areas, cases, round(expected, 6) AS expected, round(llr, 6) AS llr, (1 + (SELECT count(*) FROM le WHERE top >= g.llr)) / {_DRAWS + 1}.0::DOUBLE AS p FROM ({rows}) g"""


@query("scan_clusters", _scan_sql())
def query_scan_clusters(spark, sf):
    """Clusters of large returned lines among suppliers: circles up to half of all lines and a radius of 12 cells."""
    large = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 46)
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("people"), F.count(F.when(large, 1)).alias("cases"))
    areas = supplier_values(spark, sf).select("id", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")).join(lines, "id", "left").na.fill(0, ["people", "cases"])
    return rounded(clusters(cut(areas), _RADIUS, 0.5, _CLUSTERS, _DRAWS), "expected", "llr")


def _quantile_sql(name: str, p: float, shape: str) -> str:
    """Quantiles of gamma variables by halving, over Simpson's rule in the variable's logarithm: another way than Newton's on a series."""
    f = "exp(a * u - exp(u) - lgamma(a))"
    return f"""{name}0 AS (SELECT id, {shape} AS a FROM ys WHERE {shape} > 0),
{name}b AS (
  SELECT 0 AS round, id, a, ln(a) - 6 / sqrt(a) - 8 / a AS lo, ln(a + 8 * sqrt(a) + 8) AS hi FROM {name}0
  UNION ALL
  SELECT round + 1, id, a, CASE WHEN below < {p} THEN mid ELSE lo END, CASE WHEN below < {p} THEN hi ELSE mid END
  FROM (SELECT *, (SELECT h / 3 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {f}) FROM (SELECT k, foot + k * h AS u FROM range(4001) t(k))) AS below
        FROM (SELECT *, (mid - foot) / 4000 AS h FROM (SELECT *, (lo + hi) / 2 AS mid, (lo + hi) / 2 - greatest(40 / a, 40 / sqrt(a)) AS foot FROM {name}b WHERE round < 48)))
),
{name} AS (SELECT id, exp((lo + hi) / 2) AS q FROM {name}b WHERE round = 48)"""


@query("standardised_rates", f"""WITH RECURSIVE oc AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
st AS (SELECT c_nationkey AS id, least(greatest(floor((c_acctbal + 1000) / 525), 0), 20) AS band, count(*)::DOUBLE AS n, coalesce(sum(oc.n), 0)::DOUBLE AS d FROM customer LEFT JOIN oc ON o_custkey = c_custkey GROUP BY ALL),
wt AS (SELECT band, sum(n) AS w FROM st GROUP BY 1),
ys AS (SELECT id, sum(d)::BIGINT AS events, sum(n)::BIGINT AS people, sum(w * d / n) / sum(w) AS y, sum(w * w * d / (n * n)) / pow(sum(w), 2) AS v, max(w / n) / sum(w) AS m FROM st JOIN wt USING (band) GROUP BY id),
{_quantile_sql("ql", 0.025, "y * y / nullif(v, 0)")}, {_quantile_sql("qh", 0.975, "(y + m) * (y + m) / (v + m * m)")}
SELECT ys.id, events, people, round(1000.0 * events / people, 4) AS crude, round(1000 * y, 4) AS rate, round(coalesce(1000 * v / nullif(y, 0) * ql.q, 0), 4) AS low, round(1000 * (v + m * m) / (y + m) * qh.q, 4) AS high
FROM ys LEFT JOIN ql USING (id) LEFT JOIN qh USING (id)""")
def query_standardised_rates(spark, sf):
    """Dear orders per thousand customers of each nation, standardised over 21 bands of balance by the bands of all customers."""
    dear = table(spark, sf, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    band = F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 525), F.lit(0)), F.lit(20)).alias("band")
    people = table(spark, sf, "customer").join(dear, "c_custkey", "left")
    strata = cut(people.groupBy(F.col("c_nationkey").alias("id"), band).agg(F.count("*").alias("people"), F.coalesce(F.sum("n"), F.lit(0)).alias("events")))
    return rounded(standardised(strata, strata.select("band", F.col("people").alias("weight")), 1000.0), "crude", "rate", "low", "high", digits=4)


@query("surveillance_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def query_surveillance_windows(spark, sf):
    e = table(spark, sf, "events")
    return rounded(e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("at"), "event_type", "n", "total"), "total")
