"""Scan statistic and validity of polygons against brute force."""

import math
import random
from fractions import Fraction

import pytest

from arealith.operators.geometry import RINGS
from arealith.operators.scan import clusters, dealt
from arealith.operators.validity import faults


def llr(o, e, t):
    if o * (t - e) <= (t - o) * e:
        return 0.0
    return (o * math.log(o / e) if o else 0.0) + ((t - o) * math.log((t - o) / (t - e)) if t - o else 0.0)


def test_scan_finds_planted_clusters(spark):
    rng = random.Random(1)
    places = [(i, rng.uniform(0, 10), rng.uniform(0, 10), rng.randrange(50, 200)) for i in range(60)] + [(60, 3.0, 3.0, 0), (61, 3.0, 3.0, 80)]
    hot = lambda x, y: 4.0 if math.hypot(x - 2, y - 2) < 2 else 3.0 if math.hypot(x - 8, y - 7) < 1.5 else 1.0
    rows = [(i, x, y, n, sum(rng.random() < 0.05 * hot(x, y) for _ in range(n))) for i, x, y, n in places]
    areas = spark.createDataFrame(rows, "id long, x double, y double, people long, cases long")
    got = clusters(areas, radius=4.0, most=0.4, number=2, draws=9).collect()
    people, cases = sum(r[3] for r in rows), sum(r[4] for r in rows)
    every = []
    for c in rows:
        near = sorted((round((x - c[1]) ** 2 + (y - c[2]) ** 2, 12), i, n, k) for i, x, y, n, k in rows if (x - c[1]) ** 2 + (y - c[2]) ** 2 <= 16)
        for d in sorted({a[0] for a in near}):
            inside = [a for a in near if a[0] <= d]
            n, k = sum(a[2] for a in inside), sum(a[3] for a in inside)
            if n <= 0.4 * people and k * (people - n) > (cases - k) * n:
                every.append((-round(llr(k, cases * n / people, cases), 9), d, c[0], {a[1] for a in inside}))
    every.sort(key=lambda w: w[:3])
    want = [every[0]]
    want.append(next(w for w in every if not w[3] & want[0][3]))
    assert [(r.centre, r.areas) for r in got] == [(w[2], len(w[3])) for w in want]
    assert all(abs(r.llr + w[0]) < 1e-6 for r, w in zip(got, want, strict=True))
    assert got[0].p == 0.1


def test_draws_deal_all_cases_by_people(spark):
    rows = [(1, 0.0, 0.0, 1000, 300), (2, 1.0, 0.0, 0, 0), (3, 2.0, 0.0, 3000, 100), (4, 3.0, 0.0, 1, 0)]
    d = dealt(spark.createDataFrame(rows, "id long, x double, y double, people long, cases long"), 20).collect()
    by = {}
    for r in d:
        by.setdefault(r.draw, {})[r.id] = r.cases
    assert all(sum(v.values()) == 400 and v[2] == 0 for v in by.values()) and by[0] == {1: 300, 2: 0, 3: 100, 4: 0}
    assert 60 < sum(by[k][1] for k in range(1, 21)) / 20 < 140


def turn(p, q, r):
    v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (v > 0) - (v < 0)


def box(s, p):
    return all(min(s[0][k], s[1][k]) <= p[k] <= max(s[0][k], s[1][k]) for k in (0, 1))


def brute(code, parts):
    segs, out = [], {}
    add = lambda fault, part, ring: out.__setitem__((code, fault, part, ring), out.get((code, fault, part, ring), 0) + 1)
    for p, rings in enumerate(parts):
        for r, ring in enumerate(rings):
            if len(ring) < 4:
                add("too few vertices", p, r)
            if ring and ring[0] != ring[-1]:
                add("not closed", p, r)
            own = [(a, b) for a, b in zip(ring, ring[1:]) if a != b]
            segs += [(p, r, k, len(own), s) for k, s in enumerate(own)]
            if r and len(rings[0]) > 1:
                outer = list(zip(rings[0], rings[0][1:]))
                free = [v for v in ring if not any(turn(*s, v) == 0 and box(s, v) for s in outer)]
                if free:
                    x, y = map(Fraction, free[0])
                    loop = list(zip(rings[0], rings[0][1:] + rings[0][:1]))
                    if sum((a[1] > y) != (b[1] > y) and x < Fraction(b[0] - a[0]) * (y - a[1]) / Fraction(b[1] - a[1]) + a[0] for a, b in loop) % 2 == 0:
                        add("hole outside", p, r)
    for i, (p, r, k, n, s) in enumerate(segs):
        for q, t, m, _, u in segs[i + 1 :]:
            a, b, c, d = turn(*s, u[0]), turn(*s, u[1]), turn(*u, s[0]), turn(*u, s[1])
            wide = [min(max(s[0][z], s[1][z]), max(u[0][z], u[1][z])) - max(min(s[0][z], s[1][z]), min(u[0][z], u[1][z])) for z in (0, 1)]
            meet = (a == 0 and box(s, u[0])) or (b == 0 and box(s, u[1])) or (c == 0 and box(u, s[0])) or (d == 0 and box(u, s[1]))
            if a * b < 0 and c * d < 0:
                add("crossing", p, r)
            elif a == b == 0 and max(wide) > 0 and min(wide) >= 0:
                add("overlap", p, r)
            elif meet and (p, r) == (q, t) and not (m - k == 1 or (k == 0 and m == n - 1)):
                add("self-touch", p, r)
    return out


@pytest.mark.parametrize("size", [6, 60])
def test_faults_equal_brute_force(spark, size):
    rng = random.Random(size)
    rows, want = [], {}
    for code in range(40):
        point = lambda: (float(rng.randrange(size)), float(rng.randrange(size)))
        parts = []
        for _ in range(rng.choice([1, 1, 2])):
            rings = []
            for _ in range(rng.choice([1, 2, 3])):
                ring = [point() for _ in range(rng.choice([2, 3, 4, 6, 12, 30]))]
                rings.append(ring + ring[:1] if rng.random() < 0.8 else ring)
            parts.append(rings)
        rows.append((code, parts))
        want |= brute(code, parts)
    polygons = spark.createDataFrame(rows, f"code long, parts {RINGS}").repartition(3)
    assert {(r.code, r.fault, r.part, r.ring): r.n for r in faults(polygons).collect()} == want
