"""Grids whose cells follow the density of points: a pyramid of counts gives every place its cell.

Points in polygons and nearest neighbours go through it, so that a city is many keys and a desert is one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.functions.columns import great_circle_km
from arealith.sources.tables import cut


def at_depth(index: Sequence[Column], depth: int, deepest: int) -> Column:
    """The cell at a depth that holds the cell ``index`` of the deepest grid."""
    return F.struct(F.lit(depth).alias("d"), F.array(*(F.shiftright(i, deepest - depth) for i in index)).alias("at"))


def listed(df: DataFrame, index: Sequence[Column], depths: Sequence[int], name: str = "cell") -> DataFrame:
    """A row for each depth, with the cell there."""
    return df.withColumn(name, F.explode(F.array(*(at_depth(index, d, depths[-1]) for d in depths))))


def with_leaves(places: DataFrame, key: Sequence[str], index: Sequence[Column], depths: Sequence[int], most: int) -> DataFrame:
    """Distinct places with their ``leaf``, the largest cell of at most ``most`` of them (or the deepest)."""
    cells = listed(places, index, depths).select(*key, "cell")
    fits = cells.groupBy("cell").agg(F.count("*").alias("n")).filter((F.col("n") <= most) | (F.col("cell.d") == depths[-1])).select("cell")
    return places.join(cells.join(fits, "cell").groupBy(*key).agg(F.min("cell").alias("leaf")), list(key))


# ---- points in polygons

_PIP_DEPTHS = (0, 3, 6, 9)


def assign_points(points: DataFrame, polygons: DataFrame, cell: float = 0.5, most: int = 50_000) -> DataFrame:
    """``(id, code)``: the first polygon by ``ord`` (then ``code``) that holds each point; null outside all and without coordinates.

    points ``(id, x, y)``, polygons ``(code, ord, parts)``. Distinct places are dealt to cells, which are split where they hold
    more than ``most``. A polygon goes to a cell as those of its edges that a ray from the cell may cross; edges that every such
    ray crosses are only counted, so a cell inside a polygon gets no edge of it and its places need no ray cast.
    """
    index = [F.floor(F.col(c) / cell * 2 ** _PIP_DEPTHS[-1]) for c in ("x", "y")]
    places = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select("x", "y").distinct()
    placed = cut(with_leaves(places, ["x", "y"], index, _PIP_DEPTHS, most))
    base = lambda k: F.floor(F.col(k) / cell)
    boxes = placed.groupBy("leaf").agg(*(f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))), F.first(base("x")).alias("cx"), F.first(base("y")).alias("cy"))

    shapes = polygons.select("code", "ord", "parts", F.xxhash64("parts").alias("shape")).dropDuplicates(["code", "ord", "shape"])
    key = ["code", "ord", "shape"]
    rings = shapes.select(*key, F.posexplode("parts").alias("part", "rings")).select(*key, "part", F.posexplode("rings").alias("ring", "v")).filter(F.size("v") > 0)
    sides = F.transform("v", lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get("v", (i + F.size("v") - 1) % F.size("v")).alias("b")))
    edges = rings.select(*key, "part", "ring", F.explode(sides).alias("e")).select(*key, "part", "ring", "e.ax", "e.ay", F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    low, high = (lambda c: F.least(f"a{c}", f"b{c}")), (lambda c: F.greatest(f"a{c}", f"b{c}"))
    span = lambda c: F.sequence(F.floor(low(c) / cell), F.floor(high(c) / cell))
    extent = edges.groupBy(*key).agg(F.min(low("x")).alias("ax"), F.max(high("x")).alias("bx"), F.min(low("y")).alias("ay"), F.max(high("y")).alias("by"))
    covered = extent.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    meets = (F.col("x0") <= F.col("bx")) & (F.col("x1") >= F.col("ax")) & (F.col("y0") <= F.col("by")) & (F.col("y1") >= F.col("ay"))
    pairs = boxes.join(covered, ["cx", "cy"]).filter(meets).drop("ax", "ay", "bx", "by", "cx")

    # Where an edge meets a height is computed with rounding, so an edge is to the left or right of a cell only beyond a margin.
    margin = 1e-9 * (1 + F.abs("ax") + F.abs("bx"))
    near = pairs.join(edges.withColumn("cy", F.explode(span("y"))), [*key, "cy"]).filter((high("y") > F.col("y0")) & (low("y") <= F.col("y1")) & (high("x") >= F.col("x0") - margin))
    sure = (low("x") > F.col("x1") + margin) & (low("y") <= F.col("y0")) & (high("y") > F.col("y1"))
    clipped = near.groupBy("leaf", *key, "part", "ring").agg((F.sum(F.when(sure, 1).otherwise(0)) % 2 == 1).alias("odd"), F.collect_list(F.when(~sure, F.struct("ax", "ay", "bx", "by"))).alias("edges"))
    clipped = clipped.groupBy("leaf", *key).agg(F.collect_list(F.struct("part", "ring", "odd", "edges")).alias("rings"))

    x, y = F.col("x"), F.col("y")
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] == e["ay"], F.lit(1.0)).otherwise(e["by"] - e["ay"]) + e["ax"])
    odd = lambda r: F.aggregate(r["edges"], r["odd"], lambda s, e: s != crosses(e))
    hole = lambda r: F.exists("rings", lambda h: (h["part"] == r["part"]) & (h["ring"] > 0) & odd(h))
    inside = F.exists("rings", lambda r: (r["ring"] == 0) & odd(r) & ~hole(r))
    first = placed.join(clipped, "leaf").filter(inside).groupBy("x", "y").agg(F.min_by("code", F.struct("ord", "code")).alias("code"))
    return points.select("id", "x", "y").join(first, ["x", "y"], "left").select("id", "code")


# ---- nearest neighbours on the sphere

_NEAR_DEPTHS = tuple(range(4, 25, 2))
#: Chords of the unit sphere are compared with this slack (some hundredths of a millimetre), distances in kilometres decide.
_SLACK = 1e-11
_AXES = ("x", "y", "z")


def _apart(a: str, b: str, widest: bool) -> Column:
    """Smallest or largest distance between points of two boxes, given as structs of ``x0, x1, ...``."""
    lo, hi = (lambda s, c: F.col(f"{s}.{c}0")), (lambda s, c: F.col(f"{s}.{c}1"))
    if widest:
        gap = lambda c: F.greatest(hi(a, c) - lo(b, c), hi(b, c) - lo(a, c))
    else:
        gap = lambda c: F.greatest(lo(a, c) - hi(b, c), lo(b, c) - hi(a, c), F.lit(0.0))
    return F.sqrt(sum((gap(c) * gap(c) for c in _AXES), F.lit(0.0)))


def _box() -> Column:
    return F.struct(*(f(c).alias(f"{c}{k}") for c in _AXES for k, f in ((0, F.min), (1, F.max))))


def nearest(points: DataFrame, k: int) -> DataFrame:
    """``(src, dst, km, rank)``: the k nearest others of each point ``(id, lon, lat)``, those at its own place included; ties by id.

    Ids are unique. Where fewer than k others exist, all are given; a point without coordinates has no neighbours and is none.
    Distinct places (each with its k + 1 smallest ids) lie in cells of space around the sphere. The smallest cell around a leaf
    that holds k + 1 ids bounds the leaf's search; the leaves that its reach meets bound it again, each by the farthest point of
    one with k + 1 ids; places are compared only between leaves that are left. A far point so meets rows of leaves, not places.
    """
    deepest, top = _NEAR_DEPTHS[-1], _NEAR_DEPTHS[0]
    known = points.filter("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").select("id", "lon", "lat")
    few = known.withColumn("_r", F.row_number().over(_by("lon", "lat", order=["id"]))).filter(F.col("_r") <= k + 1).drop("_r")
    phi, lam = F.radians("lat"), F.radians("lon")
    place = few.groupBy("lon", "lat").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    place = place.withColumns({"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi), "w": F.size("ids")})
    side = 2.0**deepest
    index = [F.least(F.floor((F.col(c) + 1) / 2 * side), F.lit(int(side) - 1)) for c in _AXES]
    placed = cut(with_leaves(place, ["lon", "lat"], index, _NEAR_DEPTHS, 4 * (k + 1)).withColumn("index", F.array(*index)))

    by_leaf = placed.groupBy("leaf").agg(F.sum("w").alias("w"), _box().alias("box"), F.min("index").alias("index"))
    by_leaf = cut(by_leaf)
    within = listed(by_leaf, [F.get("index", F.lit(i)) for i in range(3)], _NEAR_DEPTHS).filter("cell.d <= leaf.d")
    merged = F.struct(*(f(f"box.{c}{j}").alias(f"{c}{j}") for c in _AXES for j, f in ((0, F.min), (1, F.max))))
    full = within.groupBy("cell").agg(F.sum("w").alias("all"), merged.alias("around")).filter(F.col("all") >= k + 1).select("cell", "around")
    bound = within.select("leaf", "box", "cell").join(full, "cell").withColumn("reach", _apart("box", "around", True)).groupBy("leaf").agg(F.max(F.struct("cell.d", "reach")).alias("g"))
    asks = by_leaf.join(bound, "leaf", "left").select("leaf", "box", F.coalesce("g.d", F.lit(top)).alias("g"), (F.coalesce("g.reach", F.lit(2.0)) + _SLACK).alias("reach"))

    # Cells of depth g within reach of the leaf's box, of those that the sphere passes through.
    width = F.lit(2.0) / F.pow(F.lit(2.0), F.col("g"))
    clip = lambda v: F.least(F.greatest(F.floor((v + 1) / width), F.lit(0)), (F.lit(2.0) / width).cast("long") - 1)
    for c in _AXES:
        asks = asks.withColumn(f"c{c}", F.explode(F.sequence(clip(F.col(f"box.{c}0") - F.col("reach")), clip(F.col(f"box.{c}1") + F.col("reach")))))
    bounds = {f"{c}{j}": F.col(f"c{c}") * width - 1 + j * width for c in _AXES for j in (0, 1)}
    asks = asks.withColumn("asked", F.struct(*(v.alias(n) for n, v in bounds.items()))).filter(_apart("box", "asked", False) <= F.col("reach"))
    far = sum((F.pow(F.greatest(F.abs(bounds[f"{c}0"]), F.abs(bounds[f"{c}1"])), F.lit(2.0)) for c in _AXES), F.lit(0.0))
    close = sum((F.pow(F.greatest(bounds[f"{c}0"], -bounds[f"{c}1"], F.lit(0.0)), F.lit(2.0)) for c in _AXES), F.lit(0.0))
    asks = asks.filter((far >= 1 - 1e-9) & (close <= 1 + 1e-9))
    # Leaves below such a cell are listed under all cells around them; larger ones are found from the cells around the asked one.
    up = lambda d: F.struct(F.lit(d).alias("d"), F.array(*(F.expr(f"shiftright(c{c}, cast(g - {d} as int))") for c in _AXES)).alias("at"))
    around = F.filter(F.array(*(F.struct((F.col("g") != d).alias("own"), up(d).alias("cell")) for d in _NEAR_DEPTHS)), lambda s: s["cell"]["d"] <= F.col("g"))
    asks = asks.select("leaf", "box", "reach", F.explode(around).alias("s")).select("leaf", "box", "reach", "s.own", "s.cell").distinct()
    other = within.select("leaf", "cell", F.lit(False).alias("own"), "w", "box").union(by_leaf.select("leaf", F.col("leaf").alias("cell"), F.lit(True), "w", "box"))
    other = other.withColumnsRenamed({"leaf": "leaf2", "box": "box2", "w": "w2"})
    met = asks.join(other, ["own", "cell"]).select("leaf", "leaf2", "box", "box2", "reach", "w2").filter(_apart("box", "box2", False) <= F.col("reach"))
    nearer = F.min(F.when(F.col("w2") >= k + 1, _apart("box", "box2", True) + _SLACK)).over(_by("leaf"))
    met = met.withColumn("reach", F.least("reach", nearer)).filter(_apart("box", "box2", False) <= F.col("reach")).select("leaf", "leaf2", "reach")

    here = placed.select("leaf", "lon", "lat", *_AXES)
    there = placed.select(F.col("leaf").alias("leaf2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), *(F.col(c).alias(f"{c}2") for c in _AXES), "ids")
    chord = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in _AXES), F.lit(0.0)))
    found = here.join(met, "leaf").join(there, "leaf2").filter(chord <= F.col("reach"))
    found = found.select("lon", "lat", great_circle_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("km"), F.explode("ids").alias("dst"))
    lists = found.withColumn("_r", F.row_number().over(_by("lon", "lat", order=[F.round("km", 9), "dst"]))).filter(F.col("_r") <= k + 1)
    lists = lists.groupBy("lon", "lat").agg(F.sort_array(F.collect_list(F.struct("_r", "dst", "km"))).alias("near"))
    kept = known.join(lists, ["lon", "lat"]).select(F.col("id").alias("src"), F.posexplode(F.slice(F.filter("near", lambda n: n["dst"] != F.col("id")), 1, k)).alias("rank", "n"))
    return kept.select("src", "n.dst", "n.km", (F.col("rank") + 1).cast("long").alias("rank"))


def _by(*keys: str, order: Sequence[str | Column] = ()):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order) if order else Window.partitionBy(*keys)
