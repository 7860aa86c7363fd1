"""Queries of file sources and sinks: given tables are written to the shared folder and read back in another form.

Files lie under the session's shared folder, in a folder of their own for every run; the caller clears it with that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arealith.operators import geometry as G
from arealith.plans.areas import SUPPLIERS, rounded, supplier_values
from arealith.sources import files
from arealith.sources.features import geojson_features_of
from arealith.sources.tables import shared_dir, stored, table

QUERIES, SQL = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_typed", "SELECT s_suppkey, lpad(s_nationkey::VARCHAR, 4, '0') AS code, s_name, round(s_acctbal, 2) AS balance FROM supplier")
def query_csv_typed(spark, sf):
    """A sorted CSV under an explicit schema: codes keep their leading zeros."""
    path = _folder(spark, "csv")
    s = table(spark, sf, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("code"), "s_name", F.round("s_acctbal", 2).alias("balance"))
    files.write_sorted_csv(s, path, "code", "s_suppkey")
    return files.csv_table(spark, path, "s_suppkey long, code string, s_name string, balance double")


@query("csv_texts", "SELECT s_suppkey::VARCHAR AS s_suppkey, lpad(s_nationkey::VARCHAR, 4, '0') AS code FROM supplier")
def query_csv_texts(spark, sf):
    """The same as texts, two columns of it."""
    path = _folder(spark, "csv")
    s = table(spark, sf, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("code"), F.concat_ws(', "', "s_name", F.lit("x")).alias("name"))
    files.write_sorted_csv(s, path, "code", "s_suppkey")
    return files.csv_strings(spark, path).select("s_suppkey", "code")


_SQUARES = "q AS (SELECT id, 100.0::DOUBLE + c AS x, 1.0::DOUBLE * r AS y FROM v)"


def _squares(spark, sf):
    at = lambda dx, dy: F.struct((100.0 + F.col("c") + dx).alias("x"), (1.0 * F.col("r") + dy).alias("y"))
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))
    return supplier_values(spark, sf).select(F.col("id").cast("string").alias("code"), F.concat(F.lit("area "), "id").alias("name"), F.array(F.array(ring)).alias("parts"))


def _collection(spark, sf):
    """GeoJSON collections of at most 50 features, a document and a file each."""
    path = _folder(spark, "geojson")
    areas = _squares(spark, sf)
    lines = files.geojson_lines(areas, ["code", "name"])
    block = F.expr("cast(get_json_object(value, '$.properties.code') as bigint) div 50").alias("block")
    by = lines.select(block, "value").groupBy("block").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("f"))
    by.select("block", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}"))).write.partitionBy("block").text(path)
    return path


@query("geojson_attributes", "SELECT s_suppkey::VARCHAR AS code, 'area ' || s_suppkey AS name, 'MultiPolygon' AS kind FROM supplier")
def query_geojson_attributes(spark, sf):
    p = files.geojson_features(spark, _collection(spark, sf))
    return p.select(F.col("properties")["code"].alias("code"), F.col("properties")["name"].alias("name"), "kind")


@query("geojson_geometry", f"WITH {SUPPLIERS}, {_SQUARES} SELECT id::VARCHAR AS code, x AS x0, x + 1 AS x1, y AS y0, y + 1 AS y1, x + 0.5 AS mid_x, y + 0.5 AS mid_y FROM q")
def query_geojson_geometry(spark, sf):
    p = files.geojson_features(spark, _collection(spark, sf)).select(F.col("properties")["code"].alias("code"), "parts")
    box = p.select("code", G.bounds(F.col("parts")).alias("b"), G.centroid(F.col("parts")).alias("m"))
    return rounded(box.select("code", "b.*", F.col("m.x").alias("mid_x"), F.col("m.y").alias("mid_y")), "mid_x", "mid_y")


@query("geojson_streamed", "SELECT s_suppkey::VARCHAR AS code, 5::BIGINT AS vertices FROM supplier")
def query_geojson_streamed(spark, sf):
    """Collections read in byte ranges, feature by feature."""
    f = geojson_features_of(spark, _collection(spark, sf))
    at = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<array<array<double>>>>")
    return f.select(F.get_json_object("feature", "$.properties.code").alias("code"), F.size(F.flatten(F.flatten(at))).cast("long").alias("vertices"))


@query("json_manifest", "SELECT doc_id, source, sha256(text) AS digest, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def query_json_manifest(spark, sf):
    """A manifest of documents as lines of JSON, written in the order of ids and read back under its schema."""
    path = _folder(spark, "manifest")
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"))
    files.write_manifest(d, path, "doc_id")
    return spark.read.schema(d.schema).json(path)


@query("markdown_report", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS link FROM pages) WHERE link <> '' AND NOT regexp_matches(link, '[)\\s]') GROUP BY ALL")
def query_markdown_report(spark, sf):
    """Diagnostics as a Markdown list of links, one file line each, and the links read from it."""
    path = _folder(spark, "markdown")
    k = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), 1)).alias("link")).filter("link <> '' and not link rlike '[)\\\\s]'")
    files.write_markdown(k.select("page_id", F.concat(F.lit("page "), "page_id", F.lit(" links to [its target]("), "link", F.lit(")")).alias("line")), path, "line", "page_id", "line")
    lines = spark.read.text(path)
    found = files.markdown_links(lines, "value")
    return found.select(F.regexp_extract("value", "page ([0-9]+)", 1).cast("long").alias("page_id"), "link").groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("audit_written", "SELECT 'balance' AS \"check\", o_custkey::VARCHAR AS code FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000 * 1.0")
def query_audit_written(spark, sf):
    """An audit's rows are on file also where it ends in an error."""
    path = _folder(spark, "audit")
    big = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).filter("t > 500000").select(F.lit("balance").alias("check"), F.col("o_custkey").cast("string").alias("code"))
    try:
        files.write_audit(big, path)
    except ValueError:
        pass  # failed checks are an error of the sink; the rows are what is asked for here
    return files.csv_table(spark, path, "check string, code string")


_NAMED = """s AS (SELECT s_suppkey, lpad(s_nationkey::VARCHAR, 4, '0') AS code, s_name || ', "<' || s_nationkey || '>"' AS name FROM supplier)"""


def _named(spark, sf):
    """Suppliers with codes that start with zeros and names full of marks, in blocks of 500."""
    s = table(spark, sf, "supplier")
    name = F.concat("s_name", F.lit(', "<'), "s_nationkey", F.lit('>"'))
    return s.select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("code"), name.alias("name"), F.expr("s_suppkey div 500").alias("block"))


@query("csv_zipped", f"WITH {_NAMED} SELECT s_suppkey::VARCHAR AS s_suppkey, name FROM s")
def query_csv_zipped(spark, sf):
    """Zip archives of one CSV file each, stored as bytes, and two of their columns."""
    archives = stored(files.zip_archives(_named(spark, sf), "block", ["s_suppkey", "code", "name"]), "archives")
    return files.zipped_rows(archives, ["s_suppkey", "name"])


@query("sheet_cells", f"WITH {_NAMED} SELECT (s_suppkey // 500)::VARCHAR AS path, s_suppkey, code, name FROM s")
def query_sheet_cells(spark, sf):
    """Workbooks stored as bytes, their sheets read below the row of names."""
    books = stored(files.workbooks(_named(spark, sf), "block", ["s_suppkey", "code", "name"]), "workbooks")
    at = F.col("cells")
    return files.workbook_rows(books, first_row=2).select("path", at["A"].cast("long").alias("s_suppkey"), at["B"].alias("code"), at["C"].alias("name"))


@query("json_whole", """SELECT s_nationkey AS nation, s_suppkey // 500 AS block, CASE WHEN s_nationkey % 10 <> 9 THEN count(*) END AS suppliers, CASE WHEN s_nationkey % 10 <> 9 THEN round(sum(s_acctbal), 4) END AS balance, s_nationkey % 10 = 9 AS unreadable
FROM supplier
GROUP BY s_nationkey, s_suppkey // 500""")
def query_json_whole(spark, sf):
    """Documents of JSON over many lines, a file each; those of some nations lack their end and are kept as text."""
    path = _folder(spark, "documents")
    one = F.to_json(F.struct(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("balance")))
    lists = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation"), F.expr("s_suppkey div 500").alias("block")).agg(F.array_join(F.collect_list(one), ",\n").alias("list"))
    text = F.concat(F.lit('{"nation": '), "nation", F.lit(',\n"block": '), "block", F.lit(',\n"suppliers": ['), "list", F.when(F.col("nation") % 10 == 9, F.lit("")).otherwise(F.lit("]}")))
    lists.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    d = files.json_documents(spark, path, "nation int, block long, suppliers array<struct<code: long, balance: double>>")
    broken = F.col("_corrupt_record").isNotNull()
    kept = lambda name: F.regexp_extract("_corrupt_record", f'"{name}": ([0-9]+)', 1)
    nation, block = F.when(broken, kept("nation").cast("int")).otherwise(F.col("nation")), F.when(broken, kept("block").cast("long")).otherwise(F.col("block"))
    balance = F.aggregate("suppliers", F.lit(0.0), lambda s, x: s + x["balance"])
    return d.select(nation.alias("nation"), block.alias("block"), F.when(~broken, F.size("suppliers").cast("long")).alias("suppliers"), F.when(~broken, F.round(balance, 4)).alias("balance"), broken.alias("unreadable"))
