"""Planted truth, goldens, conservation and edge cases of the areal operators."""

import math
import random
import zipfile
from difflib import SequenceMatcher

import generator as simulator
import numpy as np
import pytest
from pyspark.sql import functions as F

from arealith.functions import columns as C
from arealith.operators import geometry as G
from arealith.operators import linkage as L
from arealith.operators import models as M
from arealith.operators import pyramid
from arealith.operators import spatial as S
from arealith.operators.bridges import bridges
from arealith.operators.components import connected_components
from arealith.operators.ranks import numbered, quantiles
from arealith.sources import files
from arealith.sources.features import geojson_features_of


def lattice(spark, n):
    return spark.range(n * n).select("id", F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("c"))


def test_erfc(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 4.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) <= 2e-7 * max(1, math.erfc(r.x)) for r in got)


def test_constant_field_and_isolates(spark):
    cells = lattice(spark, 4)
    edges = S.lattice_edges(cells).filter("src <> 0 and dst <> 0")
    flat = cells.withColumn("x", F.lit(2.0))
    assert S.global_moran(flat, S.row_weights(edges)).first().i == 0
    assert {r.gi for r in S.gi_star(flat, edges).collect()} == {0.0, None}
    l = {r.id: r for r in S.local_moran(cells.withColumn("x", F.col("id").cast("double")), S.row_weights(edges)).collect()}
    assert l[0].quadrant is None and l[0].p is None and l[15].quadrant == "High-High"


def test_moran_rises_with_smoothing(spark):
    got = []
    for passes in (1, 3):
        d = simulator.simulated(spark, 12, 12, passes)
        e = S.lattice_edges(d.select("id", "r", "c"))
        got.append(S.global_moran(d.select("id", F.col("z").alias("x")), S.row_weights(e)).first().i)
    assert 0 < got[0] < got[1]


def test_planted_clusters_are_found(spark):
    d = simulator.simulated(spark, 14, 14).cache()
    e = S.lattice_edges(d.select("id", "r", "c"))
    gi = S.gi_star(d.select("id", F.col("sir").alias("x")), e).join(d.select("id", "truth"), "id").groupBy("truth").agg(F.avg("gi").alias("g")).collect()
    mean = {r.truth: r.g for r in gi}
    assert mean["HH"] > 1.5 and mean["LL"] < mean["background"]
    with pytest.raises(ValueError):
        simulator.simulated(spark, 5, 20)


def test_coordinate_classes(spark):
    rows = [("35", "139", "ok"), ("", "139", "missing"), (None, None, "missing"), ("x", "1", "unparseable"), ("0", "0.0", "sentinel"), ("20", "139", "out_of_range")]
    df = spark.createDataFrame(rows, "lat string, lon string, want string")
    assert all(r.got == r.want for r in df.select("want", C.coordinate_class(F.col("lat"), F.col("lon")).alias("got")).collect())


def test_points_in_holes_and_parts(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    poly = [("A", 1, [[sq(0.0, 4.0), sq(1.0, 2.0)], [sq(10.0, 11.0)]]), ("B", 2, [[sq(3.0, 6.0)]])]
    pts = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 10.5, 10.5), (4, 3.5, 3.5), (5, 50.0, 0.0), (6, 5.0, 5.0)]
    got = pyramid.assign_points(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(poly, f"code string, ord int, parts {G.RINGS}")).collect()
    assert {r.id: r.code for r in got} == {1: "A", 2: None, 3: "A", 4: "A", 5: None, 6: "B"}


def test_normalisation_guard(spark):
    rows = [("医療法人社団森クリニック", "森クリニック"), ("厚生連クリニック", "厚生連クリニック"), ("特定医療法人社団 東・病院", "東病院"), ("Ａ病院", "a病院")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert all(r.got == r.want for r in df.select("want", L.normalised(L.nfkc(F.col("name"))).alias("got")).collect())


def test_tiers(spark):
    roster = [(1, "x", "alphaone"), (2, "x", "twins"), (3, "x", "theendname"), (4, "x", "nobody"), (5, "x", "alphaone"), (6, "x", "override")]
    ref = [(10, "x", "alphaone", 1), (11, "x", "twins", 1), (12, "x", "twins", 1), (13, "x", "twins", 2), (14, "x", "endname", 2), (15, "y", "nobody", 1)]
    got = L.tiered_linkage(spark.createDataFrame(roster, "id long, block string, norm string"), spark.createDataFrame(ref, "id long, block string, norm string, source int"), spark.createDataFrame([(6, 15)], "id long, ref_id long"), ()).collect()
    assert {r.id: (r.method, r.ref_id, r.contested) for r in got} == {
        1: ("exact/1", 10, True), 2: ("exact/2", 13, False), 3: ("suffix/2", 14, False), 4: ("no_name_match", None, False), 5: ("exact/1", 10, True), 6: ("override", 15, False)
    }


def test_fuzzy_ratio(spark):
    names = [(1, "b", "northclinic")]
    pool = [(2, "b", "northclinik"), (3, "b", "southclinic"), (4, "b", "zzz"), (5, "c", "northclinic")]
    got = L.fuzzy_proposals(spark.createDataFrame(names, "id long, block string, norm string"), spark.createDataFrame(pool, "id long, block string, norm string")).collect()
    want = sorted(((round(SequenceMatcher(None, "northclinic", n).ratio(), 6), n) for _, b, n in pool if b == "b"), reverse=True)
    assert [(r.ratio, r.candidate) for r in sorted(got, key=lambda r: r.rank)] == [w for w in want if w[0] >= 0.68]


def test_fuzzy_proposals_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
    names = [(1, "x", "abc"), (2, "x", "river"), (3, "x", ""), (4, "x", None)] + [(10 + k, "xyz"[k % 3], word("abcde1\U0001F600")) for k in range(60)]
    pool = [(1, "x", "axbxc"), (2, "x", "rxixvxexr")] + [(10 + k, "xyz"[k % 3], word("abcdef12\U0001F600")) for k in range(90)]
    schema = "id long, block string, norm string"
    want = set()
    for i, block, a in names:
        near = {b: SequenceMatcher(None, a, b).ratio() for _, g, b in pool if a and g == block and a != b}
        best = sorted((-r, b) for b, r in near.items() if r >= 0.68)[:3]
        want |= {(i, k + 1, b, round(-r, 6)) for k, (r, b) in enumerate(best)}
    assert {(1, "axbxc"), (2, "rxixvxexr")} <= {(i, b) for i, _, b, _ in want}
    got = L.fuzzy_proposals(spark.createDataFrame(names, schema), spark.createDataFrame(pool, schema)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_components_and_bridges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (8, 9), (7, 7), (None, 3)], "src long, dst long")
    assert {r.id: r.component for r in connected_components(edges).collect()} == {**{k: 1 for k in range(1, 7)}, 8: 8, 9: 8}
    path = spark.range(0, 300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert {tuple(r) for r in bridges(edges.filter("src is not null and src <> dst")).collect()} == {(3, 4, 3, 3), (8, 9, 1, 1)}


def test_smoothing_refuses_isolates_and_shrinks(spark):
    d = simulator.simulated(spark, 12, 12).filter("r < 5 and c < 5").cache()
    e = S.lattice_edges(d.select("id", "r", "c"))
    with pytest.raises(ValueError):
        M.smoothed_risk(d, e.filter("src <> 1 and dst <> 1"))
    raw = {r.id: r.sir for r in d.collect()}
    spread = lambda v: max(v) - min(v)
    for model in ("leroux", "bym"):
        got = M.smoothed_risk(d.select("id", "observed", "expected"), e, model, probes=2).collect()
        risk = {r.id: r.risk for r in got}
        assert risk.keys() == raw.keys() and spread(list(risk.values())) < spread(list(raw.values()))
        assert all(r.low < r.risk < r.high for r in got)


# Ten areas of the teaching data (population, cases), two rows of five, and published results.
TOY = ((180_000, 180), (25_000, 75), (60_000, 90), (45_000, 45), (90_000, 135), (15_000, 15), (120_000, 120), (35_000, 70), (70_000, 105), (50_000, 50))
TOY_MORAN = (-0.2259508, -0.1111111, 0.0377654, -0.59094, 0.7227)
TOY_LOCAL_P = (0.225, 0.516, 0.084, 1.000, 0.296, 0.225, 0.109, 0.856, 0.730, 1.000)
TOY_QUADRANT = ("Low-High", "High-Low", "High-High", "Low-High", "High-Low", "Low-Low", "Low-High", "High-Low", "High-Low", "Low-High")
TOY_GI = (0.697, 0.702, 1.706, -0.301, -0.912, -1.448, 1.204, 0.201, -0.301, -0.375)


def test_published_results_of_ten_areas(spark):
    rows = [(i + 1, cases / people * 100_000, i // 5, i % 5) for i, (people, cases) in enumerate(TOY)]
    d = spark.createDataFrame(rows, "id long, x double, r long, c long")
    e = S.lattice_edges(d, queen=False)
    w = S.row_weights(e)
    m = S.global_moran(d, w).first()
    assert np.allclose((m.i, m.expected, m.variance), TOY_MORAN[:3], atol=1e-7) and np.allclose((m.zscore, m.p), TOY_MORAN[3:], atol=6e-5)
    local = {r.id: r for r in S.local_moran(d, w).collect()}
    assert [local[k].quadrant for k in range(1, 11)] == list(TOY_QUADRANT)
    assert np.allclose([local[k].p for k in range(1, 11)], TOY_LOCAL_P, atol=1.01e-3)
    gi = {r.id: r.gi for r in S.gi_star(d, e).collect()}
    assert np.allclose([gi[k] for k in range(1, 11)], TOY_GI, atol=6e-4)


def haversine(a, b):
    x, y, u, v = (math.radians(k) for k in (*a, *b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * C.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def test_close_pairs_and_nearest_anywhere_on_the_sphere(spark):
    rng = random.Random(4)
    places = [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(84, 90)) for _ in range(40)]
    places += [(rng.choice([-1, 1]) * rng.uniform(179, 180), rng.uniform(-70, 70) if k % 3 else 10 + k / 50) for k in range(60)]
    places += [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)] + [(0.0, 90.0), (77.0, 90.0), (-180.0, 10.3), (180.0, 10.3)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lon double, lat double").repartition(3).cache()
    km = {(i, j): haversine(p, q) for i, p in enumerate(places) for j, q in enumerate(places) if i != j}
    for most in (30.0, 250.0, 2500.0):
        got = {(r.src, r.dst) for r in G.close_pairs(d, most).collect()}
        sure = {k for k, v in km.items() if 1e-6 < v <= most - 1e-6}
        assert sure <= got and all(km[k] <= most + 1e-6 for k in got)
    got = {(r.src, r["rank"]): r.km for r in pyramid.nearest(d, 5).collect()}
    for i in range(len(places)):
        want = sorted(v for (a, _), v in km.items() if a == i)[:5]
        assert np.allclose([got[i, k] for k in range(1, 6)], want, atol=1e-6)


def test_running_sums_and_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, float(rng.randrange(9)), rng.random()])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: tuple(r)[1:] for r in quantiles(d, "g", "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], [0, 0.25, 0.5, 0.9, 1]))
    assert got["one"] == (4.0,) * 5 and "none" not in got
    n = numbered(d.filter("v is not null").select("v").distinct(), "at", "v").collect()
    assert [r["at"] for r in sorted(n, key=lambda r: r.v)] == list(range(len(n)))
    assert quantiles(d.limit(0), "g", "v", {"a": 0.5}).count() == 0


def test_bridges_equal_brute_force(spark):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(66)} | {(100 + k, 101 + k) for k in range(12)} | {(200, 201), (201, 202), (202, 200)}

    def parts(es):
        up = {x: x for e in edges for x in e}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in es:
            up[find(a)] = find(b)
        return find, up

    want = set()
    for e in edges:
        find, up = parts(edges - {e})
        if find(e[0]) != find(e[1]):
            sides = sorted(sum(find(x) == find(s) for x in up) for s in e)
            want.add((*e, *sides))
    rows = [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(sorted(edges))]
    d = spark.createDataFrame(rows + rows[:5] + [(3, 3)], "src int, dst int").repartition(3)
    assert {tuple(r) for r in bridges(d).collect()} == want
    assert bridges(d.limit(0)).count() == 0


def test_paths_of_links(spark):
    rows = [("/a/b/c", "d", "/a/b/d"), ("/a/b/", "../x?q#t", "/a/x"), ("/a", "../../x", "/x"), ("/", "./y/./z/", "/y/z/"), ("/a/b", "/p/../q", "/q"), ("/a/b", "//h/x", None), ("/a", "mailto:x", None), ("/a", "#t", None), ("/a/b", "e/f/../../g", "/a/g"), ("/a/b/c", ".", "/a/b/")]
    d = spark.createDataFrame(rows, "base string, link string, want string")
    assert [r.want for r in d.collect()] == [r.got for r in d.select(C.resolved_path(F.col("base"), F.col("link")).alias("got")).collect()]


def test_paths_given_or_set(monkeypatch):
    monkeypatch.delenv("AREA_DATA", raising=False)
    with pytest.raises(ValueError, match="--areas or set AREA_DATA"):
        files.input_path(None, "AREA_DATA", "--areas")
    monkeypatch.setenv("AREA_DATA", "/x")
    assert files.input_path(None, "AREA_DATA", "--areas") == "/x" and files.input_path("/y", "AREA_DATA", "--areas") == "/y"



def test_glm_intercept(spark):
    d = spark.createDataFrame([(1, 12, 10.0), (2, 9, 11.0), (3, 30, 20.0)], "id long, observed long, expected double")
    fit = M.intercept_glm(d).first()
    assert fit.intercept == pytest.approx(math.log(51 / 41)) and fit.se == pytest.approx(1 / math.sqrt(51))


def test_file_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "﻿code,name\n01,x\n02,y\n")
    assert sorted(map(tuple, files.zipped_csv(spark, str(tmp_path / "a.zip"), ["code", "name"]).collect())) == [("01", "x"), ("02", "y")]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"07"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}]}')
    row = files.geojson_features(spark, str(tmp_path / "g.json")).first()
    assert row.properties["code"] == "07" and len(row.parts[0][0]) == 4
    (tmp_path / "t.txt").write_bytes(b"a\r\nb\n")
    import hashlib

    assert files.file_hashes(spark, str(tmp_path / "t.txt")).first().sha256 == hashlib.sha256(b"a\nb\n").hexdigest()
    files.write_sorted_csv(spark.createDataFrame([("02",), ("01",)], "code string"), str(tmp_path / "o"), "code")
    assert [r.code for r in files.csv_table(spark, str(tmp_path / "o"), "code string").orderBy("code").collect()] == ["01", "02"]
    with pytest.raises(ValueError):
        files.write_audit(spark.createDataFrame([("x",)], "check string"), str(tmp_path / "audit"))
    assert files.csv_strings(spark, str(tmp_path / "audit")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from arealith.streaming.surveillance import event_stream, windowed_counts

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("seen").agg(F.sum("n")).first()[0]
    assert got == src.count()


def test_feature_stream_and_sheets(spark, tmp_path):
    import json

    feats = [{"type": "Feature", "properties": {"k": f"[{i}], \"features\": é"}, "geometry": None} for i in range(50)]
    (tmp_path / "big.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, ensure_ascii=False), encoding="utf-8")
    got = geojson_features_of(spark, str(tmp_path / "big.json")).collect()
    assert [json.loads(r.feature) for r in got] == feats
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>01</t></is></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    rows = files.sheet_rows(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()
    assert [r.cells for r in rows] == [{"A": "code", "B": "name"}, {"A": "01", "B": "5"}]


def test_nearest_of_fewer_points_than_asked_for(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 179.0, -60.0)], "id long, lon double, lat double")
    got = {(r.src, r["rank"]): r.dst for r in pyramid.nearest(points, 3).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert pyramid.nearest(points.filter("id = 1"), 3).count() == 0


def test_scratch_tables_go_when_their_result_is_written(spark, tmp_path):
    import os

    from arealith.sources.tables import scratch, shared_dir, stored

    with scratch(spark):
        d = stored(spark.range(5), "gone")
        d.write.parquet(str(tmp_path / "out"))
    stays = stored(spark.range(3), "stays")
    names = os.listdir(shared_dir(spark).removeprefix("file:"))
    assert not any(n.startswith("gone-") for n in names) and any(n.startswith("stays-") for n in names)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and stays.count() == 3
