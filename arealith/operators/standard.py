"""Rates standardised directly by strata, with gamma intervals."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series, eight steps up."""
    up = z + 8.0
    series = (up - 0.5) * F.log(up) - up + 0.9189385332046727 + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * F.pow(up, F.lit(5.0))) - 1 / (1680 * F.pow(up, F.lit(7.0)))
    return series - sum((F.log(z + float(k)) for k in range(8)), F.lit(0.0))


def gamma_quantile(p: float, shape: Column, rounds: int = 14) -> Column:
    """Where a gamma variable of a positive shape and scale 1 stays below with probability ``p``.

    Newton's method on the series of the incomplete gamma function, from the cube-root normal start; the number of
    terms follows the shape (some ten standard deviations).
    """
    log_whole = log_gamma(shape + 1.0)

    def step(x: Column) -> Column:
        terms = F.ceil(F.greatest(x - shape, F.lit(0.0)) + 10 * F.sqrt(x) + 40)
        add = lambda s, n: F.struct((s["t"] * x / (shape + n)).alias("t"), (s["s"] + s["t"] * x / (shape + n)).alias("s"))
        total = F.aggregate(F.sequence(F.lit(1).cast("long"), terms), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), add, lambda s: s["s"])
        front = F.exp(shape * F.log(x) - x - log_whole)  # the density is this times shape / x
        return F.greatest(x / 4, F.least(4 * x, x - (front * total - p) * x / (front * shape)))

    z = NormalDist().inv_cdf(p)
    cube = 1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape))
    start = F.when((shape > 0.5) & (cube > 0.1), shape * cube * cube * cube).otherwise(F.exp((F.log(F.lit(p)) + log_whole) / shape))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda x, _: step(x))


def standardised(strata: DataFrame, standard: DataFrame, per: float = 100_000.0, level: float = 0.95) -> DataFrame:
    """``(id, events, people, crude, rate, low, high)``: directly standardised rates of areas, with gamma intervals (Fay and Feuer).

    strata ``(id, band, people, events)``, standard ``(band, weight)``. A band in which an area has no inhabitants has no rate: its
    weight is dealt to the area's other bands in proportion (events there count nowhere). Bands without a weight, and null ones, are
    left out; an area without inhabitants has null rates. Rows of one area and band are added first, so areas are shuffled once.
    """
    one = strata.groupBy("id", "band").agg(F.sum("people").cast("double").alias("n"), F.sum("events").cast("double").alias("d"))
    known = one.join(standard.groupBy("band").agg(F.sum("weight").cast("double").alias("w")).filter("w > 0"), "band", "left")
    used = (F.col("n") > 0) & F.col("w").isNotNull()
    n, d, w = (F.when(used, F.col(c)) for c in ("n", "d", "w"))
    parts = known.groupBy("id").agg(
        F.coalesce(F.sum(d), F.lit(0.0)).cast("long").alias("events"), F.coalesce(F.sum(n), F.lit(0.0)).cast("long").alias("people"),
        F.sum(w).alias("all"), F.sum(w * d / n).alias("s1"), F.sum(w * w * d / (n * n)).alias("s2"), F.max(w / n).alias("s3"),
    )
    y, v, m = F.col("s1") / F.col("all"), F.col("s2") / (F.col("all") * F.col("all")), F.col("s3") / F.col("all")
    parts = parts.select("id", "events", "people", y.alias("y"), v.alias("v"), m.alias("m"))
    y, v, m = F.col("y"), F.col("v"), F.col("m")
    tail = (1 - level) / 2
    low = F.when(y > 0, v / y * gamma_quantile(tail, y * y / v)).when(y == 0, F.lit(0.0))
    high = F.when(y >= 0, (v + m * m) / (y + m) * gamma_quantile(1 - tail, (y + m) * (y + m) / (v + m * m)))
    crude = F.try_divide(F.col("events") * per, F.col("people"))
    return parts.select("id", "events", "people", crude.alias("crude"), (y * per).alias("rate"), (low * per).alias("low"), (high * per).alias("high"))
