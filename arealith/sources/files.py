"""File sources and sinks: CSV, zipped CSV, GeoJSON, JSON documents, hashed files, sheets; ordered CSV and audits."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealith.sources.tables import cut

GEOJSON = "type string, features array<struct<type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def csv_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header under an explicit schema: codes stay strings, nothing is inferred."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.option("header", True).csv(path)


def zipped_csv(spark: SparkSession, path: str, columns: list[str], rows: int = 20_000) -> DataFrame:
    """CSV files, each the one member of a zip archive, any byte-order mark dropped; rows come in bounded batches."""
    return zipped_rows(spark.read.format("binaryFile").load(path), columns, rows)


def zipped_rows(archives: DataFrame, columns: list[str], rows: int = 20_000) -> DataFrame:
    """Rows of archives given as rows with their bytes in ``content``; more or less than one member is an error.

    An archive is read by one task, whose memory holds its (packed) bytes, 2 GB at most; rows are never held together.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    if len(names) != 1:
                        raise ValueError(f"one member expected, {len(names)} found")
                    with z.open(names[0]) as f:
                        yield from pd.read_csv(io.TextIOWrapper(f, "utf-8-sig"), dtype=str, keep_default_na=False, usecols=columns, chunksize=rows)

    return archives.select("content").mapInPandas(lambda it: (p[columns] for p in read(it)), ", ".join(f"`{c}` string" for c in columns))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """``(properties, kind, parts)`` of a GeoJSON collection; a Polygon is a MultiPolygon of one part."""
    f = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    many = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<array<array<array<double>>>>")
    parts = F.transform(many, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return f.select(F.col("f.properties").alias("properties"), kind.alias("kind"), parts.alias("parts"))


def geojson_lines(df: DataFrame, properties: list[str], parts: str = "parts") -> DataFrame:
    """A feature for each row as a line of JSON."""
    coordinates = F.transform(F.col(parts), lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; unreadable ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def file_hashes(spark: SparkSession, path: str, text: bool = True) -> DataFrame:
    """``(path, sha256)`` of files; of texts with line ends as LF."""
    content = F.col("content")
    if text:
        content = F.replace(F.replace(F.decode(F.col("content"), "UTF-8"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(content.cast("binary"), 256).alias("sha256"))


def markdown_links(df: DataFrame, text: str) -> DataFrame:
    """Targets of Markdown links, without those of images' titles."""
    return df.withColumn("link", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\]\(([^)\s]+)"), 1)))


def write_sorted_csv(df: DataFrame, path: str, *keys: str) -> None:
    """Rows in a total order, so that reruns write the same bytes; range partitions keep the order over files."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("header", True).option("lineSep", "\n").csv(path)


def write_manifest(df: DataFrame, path: str, *keys: str) -> None:
    """Rows as lines of JSON in a total order."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.json(path)


def write_markdown(df: DataFrame, path: str, line: str, *keys: str) -> None:
    """A Markdown list, an item for each row, in a total order."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.concat(F.lit("- "), F.col(line))).write.text(path)


def input_path(given: str | None, variable: str, option: str) -> str:
    """The path given, else that of the environment variable; neither is an error that names both."""
    import os

    found = given or os.environ.get(variable)
    if not found:
        raise ValueError(f"give {option} or set {variable}")
    return found


def write_audit(audit: DataFrame, path: str, fail: bool = True) -> None:
    """Audit rows are always written, header and all; then a failed check is an error."""
    audit = cut(audit)  # computed once
    audit.write.option("header", True).csv(path)
    if fail and not audit.isEmpty():
        raise ValueError(f"checks failed, see {path}")


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(spark: SparkSession, path: str, sheet: int = 1, first_row: int = 1) -> DataFrame:
    """``(path, row, cells)`` of a workbook's sheet from a row on; cells map column letters to texts."""
    return workbook_rows(spark.read.format("binaryFile").load(path), sheet, first_row)


def workbook_rows(workbooks: DataFrame, sheet: int = 1, first_row: int = 1) -> DataFrame:
    """The same of workbooks given as rows with their bytes in ``content``.

    A workbook is read by one task, whose memory holds its packed bytes and its shared texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree.ElementTree import iterparse

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        for _, e in iterparse(z.open("xl/sharedStrings.xml")):
                            if e.tag == f"{_CELL}si":
                                shared.append("".join(t.text or "" for t in e.iter(f"{_CELL}t")))
                    rows: list[tuple] = []
                    for _, e in iterparse(z.open(f"xl/worksheets/sheet{sheet}.xml")):
                        if e.tag != f"{_CELL}row":
                            continue
                        if int(e.get("r")) >= first_row:
                            cells = {}
                            for c in e.iter(f"{_CELL}c"):
                                v = c.find(f"{_CELL}v")
                                text = "".join(t.text or "" for t in c.iter(f"{_CELL}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                                if text is not None:
                                    cells["".join(x for x in c.get("r") if x.isalpha())] = shared[int(text)] if c.get("t") == "s" else text
                            rows.append((name, int(e.get("r")), cells))
                        e.clear()
                    yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return workbooks.select("path", "content").mapInPandas(run, "path string, row int, cells map<string,string>")


def _packed(df: DataFrame, block: str, columns: list[str], fill: Callable[[zipfile.ZipFile, pd.DataFrame], None]) -> DataFrame:
    """``(path, content)``: an archive for each block, whose rows (as texts, in the order of the first column) one task holds."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            fill(z, pdf[columns].sort_values(columns, kind="stable"))
        return pd.DataFrame({"path": [str(key[0])], "content": [out.getvalue()]})

    texts = df.select(F.col(block).alias("_block"), *(F.col(c).cast("string").alias(c) for c in columns))
    return texts.groupBy("_block").applyInPandas(pack, "path string, content binary")


def zip_archives(df: DataFrame, block: str, columns: list[str]) -> DataFrame:
    """The rows of each block as a CSV file with a byte-order mark, the one member of an archive; nulls become empty texts."""
    return _packed(df, block, columns, lambda z, pdf: z.writestr("rows.csv", pdf.to_csv(index=False).encode("utf-8-sig")))


def workbooks(df: DataFrame, block: str, columns: list[str]) -> DataFrame:
    """The rows of each block as the first sheet of a workbook, under a row of names; columns are lettered, 26 at most, nulls have no cell."""
    from string import ascii_uppercase
    from xml.sax.saxutils import escape

    if len(columns) > len(ascii_uppercase):
        raise ValueError("a workbook takes 26 columns at most")

    def fill(z: zipfile.ZipFile, pdf: pd.DataFrame) -> None:
        cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_CELL[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate([columns, *pdf.itertuples(index=False)], 1):
                cells = "".join(cell(f"{a}{n}", v) for a, v in zip(ascii_uppercase, row, strict=False) if isinstance(v, str))
                f.write(f'<row r="{n}">{cells}</row>'.encode())
            f.write(b"</sheetData></worksheet>")

    return _packed(df, block, columns, fill)
