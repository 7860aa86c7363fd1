"""Validity of polygons: rings that are not closed, segments that cross, overlap or touch, holes outside their ring.

Polygons are ``(code, parts)`` with parts of rings of vertices, the first ring of a part its outer one. The segments of a polygon
are laid on grid cells of about its mean segment's size, each on the cells that it passes, and only segments of a cell are compared. Signs of
orientations tell crossings from touching ends; they are exact for coordinates whose products are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.operators.geometry import bounds, in_ring

_ENDS = ("ax", "ay", "bx", "by")


def segments(polygons: DataFrame) -> DataFrame:
    """``(code, part, ring, seg, segs, ax, ay, bx, by)`` without segments of no length; ``segs`` counts those of the ring."""
    parts = polygons.select("code", F.posexplode("parts").alias("part", "rings"))
    rings = parts.select("code", "part", F.posexplode("rings").alias("ring", "at"))
    step = lambda i: F.struct(F.get("at", i)["x"].alias("ax"), F.get("at", i)["y"].alias("ay"), F.get("at", i + 1)["x"].alias("bx"), F.get("at", i + 1)["y"].alias("by"))
    every = F.when(F.size("at") > 1, F.transform(F.sequence(F.lit(0), F.size("at") - 2), step))
    long = F.filter(every, lambda s: (s["ax"] != s["bx"]) | (s["ay"] != s["by"]))
    rows = rings.select("code", "part", "ring", long.alias("long")).select("code", "part", "ring", F.size("long").alias("segs"), F.posexplode("long").alias("seg", "s"))
    return rows.select("code", "part", "ring", "seg", "segs", "s.*")


def on_cells(rows: DataFrame) -> DataFrame:
    """Segments with the grid cells ``(cx, cy)`` that they pass; the grid's step is the polygon's mean length of a segment's box."""
    steps = rows.groupBy("code").agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))).alias("cell"))
    s = rows.join(steps, "code")
    at = lambda v: F.floor(v / F.col("cell"))
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    s = s.withColumn("cx", F.explode(F.sequence(at(low), at(high))))
    # Heights of the segment within the column, a little wider than rounding could make them.
    left, right = F.greatest(F.col("cx") * F.col("cell"), low), F.least((F.col("cx") + 1) * F.col("cell"), high)
    rise = F.when(high > low, (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    height = lambda x: F.col("ay") + (x - F.col("ax")) * rise
    bottom = F.when(high > low, F.greatest(F.least(height(left), height(right)), F.least("ay", "by"))).otherwise(F.least("ay", "by"))
    top = F.when(high > low, F.least(F.greatest(height(left), height(right)), F.greatest("ay", "by"))).otherwise(F.greatest("ay", "by"))
    slack = F.col("cell") * 1e-9
    return s.withColumn("cy", F.explode(F.sequence(at(bottom - slack), at(top + slack)))).drop("cell")


def turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """1, 0 or -1: on which side of the line from p to q the point r lies."""
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def segment_faults(polygons: DataFrame) -> DataFrame:
    """``(code, fault, part, ring, n)``: pairs of segments that cross or overlap, and those of one ring that touch out of turn.

    Rings may touch each other in points. ``part`` and ``ring`` are of the earlier segment of a pair.
    """
    s = on_cells(segments(polygons))
    key = ["part", "ring", "seg"]
    a = s.select("code", "cx", "cy", *(F.col(c).alias(f"{c}1") for c in (*key, "segs", *_ENDS)))
    b = s.select("code", "cx", "cy", *(F.col(c).alias(f"{c}2") for c in (*key, *_ENDS)))
    pairs = a.join(b, ["code", "cx", "cy"]).filter(F.struct(*(f"{c}1" for c in key)) < F.struct(*(f"{c}2" for c in key))).drop("cx", "cy").distinct()
    one, two = ([F.col(f"{c}{k}") for c in _ENDS] for k in (1, 2))
    t = [turn(*one, two[0], two[1]), turn(*one, two[2], two[3]), turn(*two, one[0], one[1]), turn(*two, one[2], one[3])]
    within = lambda s, x, y: x.between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & y.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    cross = (t[0] * t[1] < 0) & (t[2] * t[3] < 0)
    common = lambda i: F.least(F.greatest(one[i], one[i + 2]), F.greatest(two[i], two[i + 2])) - F.greatest(F.least(one[i], one[i + 2]), F.least(two[i], two[i + 2]))
    overlap = (t[0] == 0) & (t[1] == 0) & (F.greatest(common(0), common(1)) > 0) & (F.least(common(0), common(1)) >= 0)
    touch = ((t[0] == 0) & within(one, two[0], two[1])) | ((t[1] == 0) & within(one, two[2], two[3])) | ((t[2] == 0) & within(two, one[0], one[1])) | ((t[3] == 0) & within(two, one[2], one[3]))
    same = (F.col("part1") == F.col("part2")) & (F.col("ring1") == F.col("ring2"))
    follows = (F.col("seg2") - F.col("seg1") == 1) | ((F.col("seg1") == 0) & (F.col("seg2") == F.col("segs1") - 1))
    fault = F.when(cross, "crossing").when(overlap, "overlap").when(touch & same & ~follows, "self-touch")
    return pairs.withColumn("fault", fault).filter("fault is not null").groupBy("code", "fault", F.col("part1").alias("part"), F.col("ring1").alias("ring")).agg(F.count("*").alias("n"))


def ring_faults(polygons: DataFrame) -> DataFrame:
    """``(code, fault, part, ring, n)``: rings whose ends differ, rings of fewer than four vertices, and holes that leave their outer ring.

    A hole is outside when its first vertex that is not on the outer ring is outside; holes that cross their ring are crossings.
    """
    parts = polygons.select("code", F.posexplode("parts").alias("part", "rings"))
    rings = parts.select("code", "part", "rings", F.posexplode("rings").alias("ring", "at"))
    last = F.get("at", F.size("at") - 1)
    few = rings.filter(F.size("at") < 4).select("code", F.lit("too few vertices").alias("fault"), "part", "ring")
    unclosed = rings.filter((F.size("at") > 0) & (F.get("at", F.lit(0)) != last)).select("code", F.lit("not closed"), "part", "ring")
    outer = F.get("rings", F.lit(0))

    def on_outer(p: Column) -> Column:
        def holds(i: Column) -> Column:
            a, b = F.get(outer, i), F.get(outer, i + 1)
            return (turn(a["x"], a["y"], b["x"], b["y"], p["x"], p["y"]) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

        return F.exists(F.sequence(F.lit(0), F.size(outer) - 2), holds)

    free = F.get(F.filter("at", lambda p: ~on_outer(p)), F.lit(0))
    holes = rings.filter((F.col("ring") > 0) & (F.size(outer) > 1)).withColumn("free", free)
    outside = holes.filter(F.col("free").isNotNull() & ~in_ring(F.col("free.x"), F.col("free.y"), outer)).select("code", F.lit("hole outside"), "part", "ring")
    return few.union(unclosed).union(outside).withColumn("n", F.lit(1).cast("long"))


def faults(polygons: DataFrame) -> DataFrame:
    """All faults of polygons, one row for each kind and ring; a sound polygon has none."""
    return ring_faults(polygons).union(segment_faults(polygons))


def sound(polygons: DataFrame) -> DataFrame:
    """``(code, valid, x0, x1, y0, y1)`` of every polygon."""
    bad = faults(polygons).select("code").distinct().withColumn("bad", F.lit(True))
    return polygons.select("code", bounds(F.col("parts")).alias("b")).join(bad, "code", "left").select("code", F.col("bad").isNull().alias("valid"), "b.*")
