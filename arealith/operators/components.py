"""Connected components of an edge table of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealith.sources.tables import cut


#: From so many edges on, a node may have more of them than a task should read.
HUB_EDGES = 10_000


def _star(edges: DataFrame, large: bool, hubs: bool = False) -> DataFrame:
    """One star step. The minimum is aggregated before the join, so a hub costs a partial aggregate, not a group.

    Where ``hubs`` are to be expected the minima are stored, so that Spark can split a hub's rows in the join.
    """
    if large:
        by = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        by = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = by.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    low = cut(low) if hubs else low
    joined = by.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id that occurs in ``edges``; component is the smallest id reachable.

    Nulls and self-loops carry no link. Each round is two joins and a reliable checkpoint; the loop
    ends when a round leaves the edge set as it was (a fingerprint of bounded size is compared).
    An id that occurs only in self-loops is not listed.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    e = cut(e.distinct())
    before = (e.count(),)
    for _ in range(rounds):
        e = cut(_star(_star(e, True, before[0] >= HUB_EDGES), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
