"""Rules of links and of linkage, by expected values taken from the rules and not from code."""

from pyspark.sql import functions as F

from arealith.functions import columns as C
from arealith.operators import linkage as L

NAMES = "id long, block string, norm string"


def test_paths_of_links(spark):
    # The examples of RFC 3986, 5.4, against /b/c/d;p, and dots beyond any depth.
    want = {
        "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "g?y": "/b/c/g", "g#s": "/b/c/g", ";x": "/b/c/;x", "g;x": "/b/c/g;x", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g",
        "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g", "g..": "/b/c/g..", "..g": "/b/c/..g",
        "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/./y": "/b/c/g;x=1/y", "g;x=1/../y": "/b/c/y", "x/..": "/b/c/", "d/" * 16 + "../" * 14 + "z": "/b/c/d/d/z",
        "g:h": None, "//g": None, "#s": None, "?y": None,
    }
    rows = spark.createDataFrame(list(want.items()), "link string, want string").withColumn("base", F.lit("/b/c/d;p"))
    got = {r.link: r.got for r in rows.select("link", C.resolved_path(F.col("base"), F.col("link")).alias("got")).collect()}
    assert got == want
    out = {r.link for r in rows.filter("want is not null").filter(C.leaves_root(F.col("base"), F.col("link"))).collect()}
    assert out == {"../../../g", "../../../../g", "/../g"}


def test_escapes(spark):
    rows = spark.createDataFrame([("/a%20b+c", "/a b+c"), ("/100%", "/100%"), ("/%E3%81%82", "/あ")], "path string, want string")
    assert all(r.got == r.want for r in rows.select("want", C.unescaped(F.col("path")).alias("got")).collect())


def test_marks_of_names(spark):
    rows = [("A&B", "a&b"), ("a b", "ab"), ("x-1 (y)", "x1y"), ("50%+c#", "50%+c#"), ("セ・ンター", "センタ"), ("a/b\\c|d", "abcd"), ("it's", "it's")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert all(r.got == r.want for r in df.select("want", L.bare(F.col("name")).alias("got")).collect())


def test_overrides_are_no_contenders(spark):
    roster = [(1, "x", "alphaone"), (2, "x", "override"), (3, "x", "betatwo"), (4, "x", "betatwo"), (5, "x", "more"), (6, "x", "other")]
    ref = [(10, "x", "alphaone", 1), (11, "x", "betatwo", 1)]
    over = [(2, 10), (5, 11), (6, 10)]
    got = L.tiered_linkage(spark.createDataFrame(roster, NAMES), spark.createDataFrame(ref, NAMES + ", source int"), spark.createDataFrame(over, "id long, ref_id long"), ()).collect()
    assert {r.id: r.contested for r in got} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_prefixes_go_one_way(spark):
    names = spark.createDataFrame([(1, "x", "north"), (2, "x", "northern"), (3, "x", "nor"), (4, "y", "north")], NAMES)
    pool = spark.createDataFrame([(10, "x", "north"), (11, "x", "northernmost"), (12, "x", "northwest"), (13, "x", "northeast1"), (14, "x", "northeast22"), (15, "x", "norma")], NAMES)
    got = {(r.id, r["rank"]): r.candidate for r in L.prefix_proposals(names, pool).collect()}
    assert got == {(1, 1): 12, (1, 2): 13, (1, 3): 14, (2, 1): 11}
