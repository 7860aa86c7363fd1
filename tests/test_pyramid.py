"""Points in polygons and nearest neighbours in cells that follow density, against brute force."""

import math
import random

from pyspark.sql import functions as F

from arealith.functions.columns import EARTH_KM
from arealith.operators import geometry as G
from arealith.operators import pyramid


def star(rng, x, y, size, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]
    return [*ring, ring[0]]


def test_a_city_in_a_country_with_holes(spark):
    rng = random.Random(3)
    country = [[star(rng, 10, 10, 30, 400), star(rng, 10, 10, 0.4, 30), star(rng, 14, 12, 1, 9)], [star(rng, -40, 0, 5, 40)]]
    rows = [("country", 9, country), ("country", 9, country)]
    rows += [(f"ward {k}", k % 7, [[star(rng, 10.0 + 0.01 * (k % 5), 10.0 + 0.01 * (k // 5), 0.012, 12)]]) for k in range(25)]
    rows += [("lattice", 3, [[[(9.0, 9.0), (11.0, 9.0), (11.0, 11.0), (9.0, 11.0), (9.0, 9.0)]]]), ("none", 0, []), ("null", 0, None)]
    polygons = spark.createDataFrame(rows, f"code string, ord int, parts {G.RINGS}")
    places = [(rng.gauss(10.02, 0.02), rng.gauss(10.02, 0.02)) for _ in range(700)] + [(rng.uniform(-60, 45), rng.uniform(-25, 45)) for _ in range(400)]
    places += [(x, y) for x in (9.0, 10.0, 11.0) for y in (9.0, 10.0, 11.0)] + [(10.02, 10.02)] * 50 + [(None, 1.0), (1.0, None), (float("nan"), 0.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, x double, y double").repartition(4).cache()
    want = points.join(polygons, G.in_polygon(F.col("x"), F.col("y"), F.col("parts"))).groupBy("id").agg(F.min(F.struct("ord", "code")).alias("m"))
    want = {r.id: r.m.code for r in want.collect()}
    for most in (20, 50_000):
        got = {r.id: r.code for r in pyramid.assign_points(points, polygons, 0.5, most).collect()}
        assert len(got) == len(places) and {i: c for i, c in got.items() if c is not None} == want
    assert len(set(want.values())) > 10
    assert pyramid.assign_points(points.limit(0), polygons).count() == 0
    assert {r.code for r in pyramid.assign_points(points, polygons.limit(0)).collect()} == {None}


def test_leaves_follow_density(spark):
    rng = random.Random(5)
    places = [(round(rng.gauss(0, 0.05), 6), round(rng.gauss(0, 0.05), 6)) for _ in range(900)] + [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(100)]
    d = spark.createDataFrame(sorted(set(places)), "x double, y double")
    index = [F.floor(F.col(c) / 0.5 * 512) for c in "xy"]
    n = [r["count"] for r in pyramid.with_leaves(d, ["x", "y"], index, (0, 3, 6, 9), 40).groupBy("leaf").count().collect()]
    assert sum(n) == len(set(places)) and max(n) <= 40


def test_nearest_by_density(spark):
    rng = random.Random(8)
    places = [(rng.gauss(139.7, 0.05), rng.gauss(35.6, 0.05)) for _ in range(250)] + [(rng.gauss(2.3, 0.001), rng.gauss(48.9, 0.001)) for _ in range(60)]
    places += [(139.7, 35.6)] * 30 + [(float(rng.randrange(3)), float(rng.randrange(3))) for _ in range(40)]
    places += [(-120.0, -40.0), (180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (50.0, 90.0), (0.0, -90.0), (-40.3, 35.6)]
    points = spark.createDataFrame([(3 * i % 509, *p) for i, p in enumerate(places)] + [(900, None, 0.0), (901, 0.0, None)], "id long, lon double, lat double").repartition(4).cache()
    rows = [tuple(r) for r in points.collect() if r.id < 900]

    def km(a, b):
        u, v, x, y = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((y - v) / 2) ** 2 + math.cos(v) * math.cos(y) * math.sin((x - u) / 2) ** 2
        return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    for k in (1, 6):
        got = {}
        for r in pyramid.nearest(points, k).collect():
            got.setdefault(r.src, []).append((r["rank"], r.km, r.dst))
        assert set(got) == {r[0] for r in rows}
        for a in rows:
            mine = sorted(got[a[0]])
            want = sorted((round(km(a, b), 9), b[0]) for b in rows if b[0] != a[0])[:k]
            assert [m[0] for m in mine] == list(range(1, k + 1))
            assert all(abs(m[1] - w[0]) < 1e-7 for m, w in zip(mine, want, strict=True))
            if want[-1][0] == 0:
                assert [m[2] for m in mine] == [w[1] for w in want]
    assert pyramid.nearest(points.limit(0), 2).count() == 0
