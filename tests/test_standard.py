"""Standardised rates and gamma quantiles against numerical integration and sums in Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arealith.operators.standard import gamma_quantile, log_gamma, standardised


def below(a, x):
    """Simpson's rule over the logarithm of the variable."""
    top, foot = math.log(x), math.log(x) - max(40 / a, 40 / math.sqrt(a))
    h = (top - foot) / 20_000
    f = lambda u: math.exp(a * u - math.exp(u) - math.lgamma(a))
    return h / 3 * sum((1 if k in (0, 20_000) else 4 if k % 2 else 2) * f(foot + k * h) for k in range(20_001))


def test_gamma_quantiles(spark):
    shapes = [0.05, 0.3, 0.7, 1.0, 1.5, 4.0, 33.3, 900.0, 250_000.0]
    d = spark.createDataFrame([(a,) for a in shapes], "a double")
    for r in d.select("a", log_gamma(F.col("a")).alias("g"), *(gamma_quantile(p, F.col("a")).alias(n) for n, p in (("low", 0.025), ("high", 0.975)))).collect():
        assert r.g == pytest.approx(math.lgamma(r.a), rel=1e-10, abs=1e-10)
        assert below(r.a, r.low) == pytest.approx(0.025, rel=1e-6) and below(r.a, r.high) == pytest.approx(0.975, rel=1e-6)
    # The exact limits of a Poisson count of one: half the quantiles of chi-square.
    one = d.limit(1).select(gamma_quantile(0.025, F.lit(1.0)).alias("low"), gamma_quantile(0.975, F.lit(2.0)).alias("high")).first()
    assert one.low == pytest.approx(-math.log(0.975)) and one.high == pytest.approx(5.571643, abs=1e-6)


def test_standardised_rates_and_their_edges(spark):
    rng = random.Random(2)
    rows = [(a, b, rng.randrange(0, 400), rng.randrange(0, 9)) for a in range(6) for b in range(21)] * 2
    rows += [(7, 0, 50, 0), (8, 3, 0, 4), (None, 1, 10, 1), (0, None, 10, 1), (1, 99, 10, 1), (2, 4, None, None)]
    weight = {b: 10 + b for b in range(21)}
    strata = spark.createDataFrame(rows, "id int, band int, people int, events int")
    got = {r.id: r for r in standardised(strata, spark.createDataFrame(list(weight.items()), "band int, weight int"), 1000.0).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7, 8, None}
    for a in range(6):
        sums = {b: [sum(r[k] for r in rows if r[:2] == (a, b) and r[k] is not None) for k in (2, 3)] for b in weight}
        sums = {b: s for b, s in sums.items() if s[0] > 0}
        whole = sum(weight[b] for b in sums)
        want = sum(weight[b] / whole * s[1] / s[0] for b, s in sums.items())
        r = got[a]
        assert r.rate == pytest.approx(1000 * want) and r.low < r.rate < r.high
        assert r.crude == pytest.approx(1000 * sum(s[1] for s in sums.values()) / sum(s[0] for s in sums.values()))
    assert got[7].rate == 0 and got[7].low == 0 and got[7].high == pytest.approx(-math.log(0.025) / 50 * 1000)
    assert got[8].people == 0 and got[8].rate is None and got[8].high is None
    assert standardised(strata.limit(0), strata.limit(0).select("band", F.col("people").alias("weight"))).count() == 0
