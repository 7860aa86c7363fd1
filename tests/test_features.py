"""Collections in byte ranges against the whole document; archives and workbooks written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from arealith.sources import files
from arealith.sources.features import geojson_features_of


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def feature(k, size=1):
    return {"type": "Feature", "properties": {"k": f'}}{k}] "features": [{{ \\ é', "deep": [{"a": [1, {}]}] * size}, "geometry": None if k % 3 else {"type": "Point", "coordinates": [k, 0.5]}}


def test_ranges_give_all_features(small_ranges, tmp_path):
    feats = [feature(k, 1 if k % 10 else 80) for k in range(70)]  # some are longer than several ranges
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": feats, "bbox": [0, 0, 1, 1]}
    (tmp_path / "a.json").write_text(json.dumps(whole, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(whole, indent=1) + "\n", encoding="utf-8")
    (tmp_path / "empty.json").write_text('{"type": "FeatureCollection", "features": []}', encoding="utf-8")
    got = geojson_features_of(small_ranges, str(tmp_path)).collect()
    for name in "ab":
        own = [json.loads(r.feature) for r in got if r.path.endswith(f"{name}.json")]
        assert sorted(map(json.dumps, own)) == sorted(map(json.dumps, feats))
    assert len(got) == 140


@pytest.mark.parametrize("text", ['{"features": [{"type": "Feature"}, {"type": "Feat', '{"features": [{"type": "Feature"}]', '{"features": [{"type": "Feature"}', '{"features": [{"type": }]}', '{"other": []}'])
def test_broken_collections_are_errors(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text, encoding="utf-8")
    with pytest.raises(Exception):
        geojson_features_of(spark, str(tmp_path / "c.json")).collect()


def test_archives_and_workbooks_keep_marks_and_empty_cells(spark):
    rows = [(2, "01", 'a, "b" <c> & d'), (1, "02", "two\nlines "), (3, None, "ü"), (4, "", None)]
    d = spark.createDataFrame(rows, "n long, code string, name string").withColumn("block", (F.col("n") % 2))
    archives = files.zip_archives(d, "block", ["n", "code", "name"]).cache()
    got = files.zipped_rows(archives, ["name", "n"], rows=1).collect()
    assert sorted((int(r.n), r.name) for r in got) == [(n, name or "") for n, _, name in sorted(rows)]
    books = files.workbooks(d, "block", ["n", "code", "name"])
    got = {int(r.cells["A"]): (r.row, r.cells.get("B"), r.cells.get("C")) for r in files.workbook_rows(books, first_row=2).collect()}
    assert got == {1: (2, "02", "two\nlines "), 2: (2, "01", rows[0][2]), 3: (3, None, "ü"), 4: (3, "", None)}
    assert files.zipped_rows(files.zip_archives(d.limit(0), "block", ["n"]), ["n"]).count() == 0
    with pytest.raises(ValueError, match="26 columns"):
        files.workbooks(d, "block", ["n"] * 27)
