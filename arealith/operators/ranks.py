"""Running sums, numbers and exact quantiles in a global order, without a window that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealith.sources.tables import cut


def running(df: DataFrame, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` (whole numbers) over all rows before a row in the order of the columns.

    Rows are dealt to ranges; sums within a range are added to those of the ranges before it, of which there is one
    row each. Rows that tie in all columns are taken in any order.
    """
    dealt = df.withColumn("_amount", amount.cast("long")).repartitionByRange(*order)
    placed = cut(dealt.withColumn("_range", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("_amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = placed.groupBy("_range").agg(F.sum("_amount").alias("_amount"))
    base = sums.select("_range", before(Window.orderBy("_range")).alias("_base"))  # a row for each range
    inside = placed.withColumn(name, before(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(base), "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base", "_amount")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds numbers from 0 in the order of the columns."""
    return running(df, order, F.lit(1), name)


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(group, *shares)``: exact quantiles with linear interpolation, by ranks of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = running(counts, [group, value], F.col("c"), "at")
    whole = ranked.groupBy(group).agg(F.min("at").alias("first"), F.sum("c").alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in shares.items()))).alias("a")
    asked = whole.select(group, "first", "n", asked).withColumn("pos", F.col("a.q") * (F.col("n") - 1))
    at = F.col("at") - F.col("first")
    covers = lambda rank: (at <= rank) & (rank < at + F.col("c"))
    low, high = F.floor("pos"), F.ceil("pos")
    near = ranked.join(asked, group).filter(covers(low) | covers(high))
    found = near.groupBy(group, "a.k").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.first("pos").alias("pos"))
    one = found.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos")))
    return one.groupBy(group).agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in shares))
