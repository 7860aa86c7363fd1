"""Balance checks that yield audit rows: ``(check, code, expected, actual, diff)``; no row means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.operators.ranks import running


def compared(name: str, expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Rows in which two tables of (key, value) differ or that one of them lacks."""
    e = expected.select(F.col(key).alias("code"), F.col(value).alias("expected"))
    a = actual.select(F.col(key).alias("code"), F.col(value).alias("actual"))
    both = e.join(a, "code", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(F.lit(name).alias("check"), F.col("code").cast("string").alias("code"), "expected", "actual", (zero("actual") - zero("expected")).alias("diff"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right only")))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_parent(mapping: DataFrame, child: str, parent: str) -> DataFrame:
    """Children with more than one parent."""
    return mapping.groupBy(child).agg(F.countDistinct(parent).alias("parents")).filter("parents > 1")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def rule(name: str, df: DataFrame, broken: Column, code: str) -> DataFrame:
    """Rows of a table that break a rule."""
    return df.filter(broken).select(F.lit(name).alias("check"), F.col(code).cast("string").alias("code"))


def report(parts: list[DataFrame]) -> DataFrame:
    """All checks' rows in one table of fixed columns, empty if all pass."""
    return reduce(DataFrame.unionByName, parts)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks with ties, by prefix counts over ranges of the distinct values."""
    c = running(df.groupBy(value).agg(F.count("*").alias("_c")), [value], F.col("_c"), "_before")
    return df.join(c.select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(name)), value)


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's correlation; 0 where a side is constant."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.agg(F.coalesce(r, F.lit(0.0)).alias("r"))
