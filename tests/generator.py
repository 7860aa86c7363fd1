"""A lattice with a known truth: smoothed noise, planted clusters, populations and counts, all from md5."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealith.functions.columns import hash_uniform
from arealith.operators.spatial import lattice_edges, smoothed, standardised

# Relative risks of the planted labels, and cases per inhabitant of the whole.
RISK = {"HH": 3.0, "LL": 0.3, "HL": 10.0, "LH": 0.2}
BASE = 0.0008


def normal(*keys: Column) -> Column:
    """A standard normal number out of two hashed uniforms (Box and Muller)."""
    u, v = hash_uniform(*keys, F.lit("u")), hash_uniform(*keys, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * pi * v)


def lattice(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    n = spark.range(rows * cols)
    return n.select((F.col("id") + 1).alias("id"), F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"))


def labelled(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Planted labels: 3 x 3 cores of high and low risk, one high cell with a ring of low ones."""
    if min(rows, cols) < 12:
        raise ValueError("the planted clusters need 12 rows and columns")
    centre = {"HH": (rows // 4, cols // 4), "LL": (3 * rows // 4, 3 * cols // 4), "HL": (rows // 4, 3 * cols // 4)}
    far = lambda p: F.greatest(F.abs(F.col("r") - p[0]), F.abs(F.col("c") - p[1]))
    label = F.when(far(centre["HH"]) <= 1, "HH").when(far(centre["LL"]) <= 1, "LL").when(far(centre["HL"]) == 0, "HL").when(far(centre["HL"]) == 1, "LH").otherwise("background")
    return cells.withColumn("truth", label)


def simulated(spark: SparkSession, rows: int = 18, cols: int = 19, passes: int = 3, seed: int = 20260818) -> DataFrame:
    """``(id, r, c, truth, population, expected, observed, sir, z)``; a count is the hashed quantile of its Poisson law."""
    cells = labelled(lattice(spark, rows, cols), rows, cols)
    noise = cells.select("id", normal(F.lit(seed), F.col("id")).alias("x"))
    field = standardised(smoothed(noise, lattice_edges(cells.select("id", "r", "c")), passes)).withColumnRenamed("x", "z")
    size = F.when(F.col("id") % 17 == 0, 900.0).otherwise(F.greatest(F.lit(3000.0), F.exp(10.2 + 0.7 * normal(F.lit(seed), F.lit("p"), F.col("id")))))
    risk = F.coalesce(*(F.when(F.col("truth") == k, v) for k, v in RISK.items()), F.exp(0.4 * F.col("z")))
    out = cells.join(field, "id").withColumn("population", F.floor(size)).withColumn("expected", F.col("population") * BASE).withColumn("mean", F.col("expected") * risk)
    # Counts by a normal quantile with the mean and variance of the Poisson law above 30, by its cumulative law below.
    u = hash_uniform(F.lit(seed), F.lit("o"), F.col("id"))
    zero = F.struct(F.lit(0).alias("k"), F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("below"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(120)), zero, lambda s, k: F.when(s["below"] < u, F.struct(k.alias("k"), (s["p"] * F.col("mean") / k).alias("p"), (s["below"] + s["p"] * F.col("mean") / k).alias("below"))).otherwise(s))
    large = F.greatest(F.lit(0.0), F.round(F.col("mean") + F.sqrt("mean") * normal(F.lit(seed), F.lit("n"), F.col("id"))))
    out = out.withColumn("observed", F.when(F.col("mean") < 30, step["k"].cast("long")).otherwise(large.cast("long")))
    return out.select("id", "r", "c", "truth", "population", "expected", "observed", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).otherwise(0.0).alias("sir"), "z")
