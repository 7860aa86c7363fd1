"""Geometry over arrays: polygons are parts of rings of (x, y) vertices; joins go through grid cells."""

from __future__ import annotations

from math import radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.functions.columns import great_circle_km

RINGS = "array<array<array<struct<x:double,y:double>>>>"


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast; the y test is half open, which alone decides points on an edge."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + n - 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"])

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda odd, i: odd != crosses(i))


def in_polygon(x: Column, y: Column, parts: Column) -> Column:
    """In the outer ring of some part and in none of its holes."""
    return F.exists(parts, lambda rings: in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), lambda h: in_ring(x, y, h)))


def bounds(parts: Column) -> Column:
    """Bounding box of all vertices."""
    flat = F.flatten(F.flatten(parts))
    low = lambda f: F.array_min(F.transform(flat, f))
    high = lambda f: F.array_max(F.transform(flat, f))
    return F.struct(low(lambda p: p["x"]).alias("x0"), high(lambda p: p["x"]).alias("x1"), low(lambda p: p["y"]).alias("y0"), high(lambda p: p["y"]).alias("y1"))


def _moments(ring: Column) -> Column:
    """Twice the area and its moments of a ring, without sign (shoelace formula)."""
    n = F.size(ring)

    def step(s: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        c = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (a["x"] + b["x"]) * c).alias("x"), (s["y"] + (a["y"] + b["y"]) * c).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    way = lambda s: F.when(s["a"] < 0, -1.0).otherwise(1.0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda s: F.struct((way(s) * s["a"]).alias("a"), (way(s) * s["x"]).alias("x"), (way(s) * s["y"]).alias("y")))


def centroid(parts: Column) -> Column:
    """Planar centroid of all parts, by area, holes taken off; null without area."""
    signed = F.flatten(F.transform(parts, lambda rings: F.transform(rings, lambda ring, k: F.struct(_moments(ring).alias("m"), F.when(k == 0, 1.0).otherwise(-1.0).alias("w")))))
    total = lambda c: F.aggregate(signed, F.lit(0.0), lambda s, r: s + r["w"] * r["m"][c])
    return F.struct(F.try_divide(total("x"), 3 * total("a")).alias("x"), F.try_divide(total("y"), 3 * total("a")).alias("y"))


#: Kilometres of a degree of latitude on the sphere, a little less than it is.
DEGREE_KM = 111.19


def near_cells(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of points ``(id, lon, lat)`` and ``(dst, lon2, lat2)`` that may lie within ``km`` of each other on the sphere.

    The grid has rows of that height; a row's cells are as wide as the distance is at the row's latitude nearest to a
    pole, seen from the row next to it, a whole number of cells around the globe, and wrap at the date line. Where a
    pole is within reach, a row is one cell.
    """
    dlat = km / DEGREE_KM
    row = lambda lat: F.floor((lat + 90.0) / dlat)
    # Bound on the difference in longitude of two points within km: sin(d / 2) / cos(latitude farthest from the equator).
    top = lambda r: F.greatest(F.abs(r * dlat - 90.0), F.abs((r + 1) * dlat - 90.0))
    share = lambda r: F.lit(float(sin(radians(min(dlat, 180.0) / 2)))) / F.cos(F.radians(F.least(top(r), F.lit(89.999))))
    cells = lambda r: F.when(share(r) < 1, F.greatest(F.floor(360.0 / (2.0 * F.degrees(F.asin(F.least(share(r), F.lit(1.0)))))), F.lit(1))).otherwise(F.lit(1)).cast("long")
    column = lambda lon, n: F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)
    b = right.withColumn("cy", row(F.col("lat2"))).withColumn("cx", column(F.col("lon2"), cells(F.col("cy"))))
    a = left.withColumn("cy", F.explode(F.array(*(row(F.col("lat")) + k for k in (-1, 0, 1))))).withColumn("_n", cells(F.col("cy")))
    # The point's own latitude may be nearer to a pole than the row: then it looks as many cells around as its reach asks for.
    own = F.lit(float(sin(radians(min(dlat, 180.0) / 2)))) / F.cos(F.radians(F.least(F.abs(F.col("lat")), F.lit(89.999))))
    reach = F.when(own < 1, F.ceil(2.0 * F.degrees(F.asin(F.least(own, F.lit(1.0)))) / 360.0 * F.col("_n"))).otherwise(F.col("_n"))
    reach = F.least(F.greatest(reach, F.lit(1)), F.floor(F.col("_n") / 2)).cast("long")
    at = column(F.col("lon"), F.col("_n"))
    around = F.array_distinct(F.transform(F.sequence(-reach, reach), lambda k: F.pmod(at + k, F.col("_n"))))
    return a.withColumn("cx", F.explode(around)).join(b, ["cy", "cx"]).drop("cx", "cy", "_n")


def _within(points: DataFrame, other: DataFrame, km: float) -> DataFrame:
    """Pairs of points ``(id, lon, lat)`` with others ``(dst, lon2, lat2)`` and their ``km``, 0 < distance <= km."""
    d = great_circle_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    near = near_cells(points, other, km).filter((F.col("id") != F.col("dst")) & (F.abs(F.col("lat2") - F.col("lat")) <= km / DEGREE_KM))
    return near.withColumn("km", d).filter((F.col("km") > 0) & (F.col("km") <= km))


def close_pairs(points: DataFrame, km: float) -> DataFrame:
    """``(src, dst, km)``: ordered pairs of points ``(id, lon, lat)`` at 0 < distance <= km on the sphere, through a grid of that size."""
    other = points.select(F.col("id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return _within(points.select("id", "lon", "lat"), other, km).select(F.col("id").alias("src"), "dst", "km")


def band_sums(points: DataFrame, km: float) -> DataFrame:
    """``(id, degree, total)``: how many others ``close_pairs`` gives a point ``(id, lon, lat, x)``, and the sum of their x.

    Points without any are left out. Pairs are summed where they are found and never written: what is shuffled grows with the points.
    """
    other = points.select(F.col("id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("x").alias("x2"))
    return _within(points.select("id", "lon", "lat"), other, km).groupBy("id").agg(F.count("*").alias("degree"), F.sum("x2").alias("total"))


def shared_vertex_edges(vertices: DataFrame, snap: float = 0.0) -> DataFrame:
    """``(src, dst)``: polygons that share a boundary vertex, or have two within ``snap``.

    vertices ``(id, x, y)``. Without snap an equi-join on coordinates; else on grid cells of that size.
    """
    v = vertices.distinct()
    if snap == 0:
        pairs = v.join(v.select(F.col("id").alias("dst"), "x", "y"), ["x", "y"])
    else:
        grid = v.withColumn("cx", F.floor(F.col("x") / snap)).withColumn("cy", F.floor(F.col("y") / snap))
        around = grid.withColumn("cx", F.explode(F.array(*(F.col("cx") + k for k in (-1, 0, 1))))).withColumn("cy", F.explode(F.array(*(F.col("cy") + k for k in (-1, 0, 1)))))
        other = grid.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
        pairs = around.join(other, ["cx", "cy"]).filter((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= snap * snap)
    return pairs.filter("id <> dst").select(F.col("id").alias("src"), "dst").distinct()
