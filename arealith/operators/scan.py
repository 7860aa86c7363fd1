"""Spatial scan statistic: circular windows of all centres and sizes, the likeliest cluster, secondary ones, Monte Carlo tests.

Areas are ``(id, x, y, people, cases)`` with whole numbers of people and cases. A centre's windows are its nearest areas, all of a
distance at a time, up to a radius and a share of the people. Near areas are found on grid cells of the radius, so the work is
areas x areas within the radius (x draws), not areas x areas. A draw deals every case to a person by a hashed number, the same in
every engine, and only counts by area go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealith.operators.ranks import running
from arealith.sources.tables import cut


def near_areas(areas: DataFrame, radius: float) -> DataFrame:
    """``(centre, id, d2)``: areas within the radius of a centre, itself included, and their squared distances."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("step")
    centres = areas.select(F.col("id").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"), cell("x").alias("gx"), cell("y").alias("gy"), around)
    centres = centres.select("centre", "cx", "cy", (F.col("gx") + F.col("step.a")).alias("gx"), (F.col("gy") + F.col("step.b")).alias("gy"))
    both = centres.join(areas.select("id", "x", "y", cell("x").alias("gx"), cell("y").alias("gy")), ["gx", "gy"])
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return both.select("centre", "id", d2.alias("d2")).filter(F.col("d2") <= radius**2)


def log_likelihood(inside: Column, expected: Column, total: Column) -> Column:
    """Logarithm of the likelihood ratio of a window with more cases than expected; 0 of any other."""
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    more = inside * (total - expected) > (total - inside) * expected
    return F.when(more, term(inside, expected) + term(total - inside, total - expected)).otherwise(0.0)


def windows(near: DataFrame, counts: DataFrame, most: float) -> DataFrame:
    """``(draw, centre, d2, areas, cases, expected, llr)`` of all windows of at most that share of the people.

    ``counts``: ``(draw, id, people, cases)`` for every draw and area.
    """
    whole = counts.groupBy("draw").agg(F.sum("people").alias("all_people"), F.sum("cases").alias("all_cases"))  # a row a draw
    ring = near.join(counts, "id").groupBy("draw", "centre", "d2").agg(F.count("*").alias("n"), F.sum("people").alias("p"), F.sum("cases").alias("c"))
    upto = Window.partitionBy("draw", "centre").orderBy("d2").rowsBetween(Window.unboundedPreceding, 0)
    sums = ring.select("draw", "centre", "d2", *(F.sum(a).over(upto).alias(b) for a, b in (("n", "areas"), ("p", "people"), ("c", "cases")))).join(F.broadcast(whole), "draw")
    expected = F.col("all_cases").cast("double") * F.col("people") / F.col("all_people")
    rows = sums.filter(F.col("people") <= most * F.col("all_people")).withColumn("expected", expected)
    llr = F.round(log_likelihood(F.col("cases").cast("double"), F.col("expected"), F.col("all_cases").cast("double")), 9)
    return rows.select("draw", "centre", "d2", "areas", "cases", "expected", llr.alias("llr"))


def dealt(areas: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """``(draw, id, people, cases)``: draw 0 as given, in the others every case at a person by a hashed number.

    People are numbered through the areas in the order of ids, so an area is a range of numbers; ranges and numbers meet on
    slices of about one area's size.
    """
    at = cut(running(areas.select("id", "people", "cases"), ["id"], F.col("people"), "first"))
    whole = at.agg(F.sum("people").alias("all"), F.greatest(F.sum("people") / F.count("*"), F.lit(1)).cast("long").alias("slice"))
    placed = at.filter("people > 0").crossJoin(F.broadcast(whole))
    slice_of = lambda c: F.expr(f"({c}) div slice")
    ranges = placed.select("id", "first", "people", F.explode(F.sequence(slice_of("first"), slice_of("first + people - 1"))).alias("at"))
    case = at.filter("cases > 0").crossJoin(F.broadcast(whole)).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cases")))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("draw", "id", "k"))))
    person = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("all")
    case = case.select("draw", person.alias("person"), "slice").select("draw", "person", slice_of("person").alias("at"))
    hit = case.join(ranges, "at").filter("person >= first and person < first + people").groupBy("draw", "id").agg(F.count("*").alias("drawn"))
    every = areas.select("id", "people").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = every.join(hit, ["draw", "id"], "left").select("draw", "id", "people", F.coalesce("drawn", F.lit(0)).alias("cases"))
    return areas.select(F.lit(0).alias("draw"), "id", "people", F.col("cases").cast("long").alias("cases")).union(drawn)


def clusters(areas: DataFrame, radius: float, most: float = 0.5, number: int = 3, draws: int = 99, seed: int = 1) -> DataFrame:
    """``(rank, centre, d2, areas, cases, expected, llr, p)``: the likeliest windows, none of which shares an area with one before it.

    Ties go to the smaller window, then to the smaller id. p compares a window with the likeliest one of each draw. A window
    with no more cases than expected is no cluster. Areas without people count as areas only.
    """
    near = cut(near_areas(areas, radius))
    counts = cut(dealt(areas, draws, seed))
    own = cut(windows(near, counts.filter("draw = 0"), most).drop("draw").filter("llr > 0"))
    least = cut(windows(near, counts.filter("draw > 0"), most).groupBy("draw").agg(F.max("llr").alias("top")))
    found, free = None, own
    for rank in range(1, number + 1):
        best = cut(free.orderBy(F.desc("llr"), "d2", "centre").limit(1).withColumn("rank", F.lit(rank)))
        found = best if found is None else found.union(best)
        taken = near.join(F.broadcast(best.select("centre", F.col("d2").alias("upto"))), "centre").filter("d2 <= upto").select("id")
        blocked = near.join(taken, "id").groupBy("centre").agg(F.min("d2").alias("block"))
        free = free.join(blocked, "centre", "left").filter("block is null or d2 < block").drop("block")
    tops = least.agg(F.collect_list("top").alias("tops"))  # a number a draw
    p = (F.size(F.filter("tops", lambda t: t >= F.col("llr"))) + 1) / (draws + 1)
    return found.crossJoin(F.broadcast(tops)).select("rank", "centre", "d2", "areas", "cases", "expected", "llr", p.alias("p"))
