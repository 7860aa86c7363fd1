"""GeoJSON collections of any size, read in byte ranges.

A file is read as pieces that end with a closing brace, so Spark deals it out by ranges of bytes. Where a range
begins, inside a text or not and how deep, depends on all before it; but what a range does to that state is known for both
cases, so a first pass leaves one small row a range, prefix sums over these give every range its beginning, and a second pass
cuts the features. Features that lie across ranges are put together from their parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealith.sources.tables import cut

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "path"), ("file_block_start", "start"), ("file_size", "size"))]
    return spark.read.option("lineSep", "}").text(path).select(*meta, "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
    """Consecutive pieces of a range as one text, braces put back."""
    keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("size").to_pylist(), strict=True))
    values = batch.column("value").to_pylist()
    lo = 0
    for hi in range(1, len(keys) + 1):
        if hi == len(keys) or keys[hi] != keys[lo]:
            yield *keys[lo], "".join(v + "}" for v in values[lo:hi]).encode()
            lo = hi


def _inside(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without escapes, and how many quotes stand before each byte, modulo 2."""
    plain = np.frombuffer(_ESCAPED.sub(b"  ", data), np.uint8)
    quotes = plain == 0x22
    return plain, (np.cumsum(quotes) - quotes) % 2


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of pieces: quotes, change of depth by where it begins, bytes, and whether the key of the features is in it."""
    for batch in batches:
        rows = []
        for path, start, size, data in _runs(batch):
            plain, odd = _inside(data)
            step = _STEP[plain]
            rows.append((path, start, size, int((plain == 0x22).sum() % 2), int(step[odd == 0].sum()), int(step[odd == 1].sum()), len(data), b'"features"' in data))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "size", "quotes", "out", "inn", "bytes", "named"), r, strict=True)) for r in rows], schema=_EFFECT)


_EFFECT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("quotes", pa.int32()), ("out", pa.int64()), ("inn", pa.int64()), ("bytes", pa.int64()), ("named", pa.bool_())])


def _cut_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole features (``part`` 0) and the ends (1) and beginnings (2) of those that go on in another range."""
    here, depth, inside, held, begun, began_inside = None, 0, False, b"", False, False
    rows: list[tuple[str, int, int, bytes]] = []

    def left() -> None:
        if here and held:  # the range ended within a feature
            rows.append((here[0], here[1], 1 if began_inside else 2, held))

    for batch in batches:
        begins = {(p, s): (d, i) for p, s, d, i in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "depth", "inside")), strict=True)}
        for path, start, _, data in _runs(batch):
            if here != (path, start):
                left()
                here, (depth, inside) = (path, start), begins[path, start]
                begun = began_inside = depth >= 3
                held = b""
            plain, odd = _inside(data)
            step = np.where(odd == int(inside), _STEP[plain], 0)
            after = depth + np.cumsum(step)
            opens, closes = np.flatnonzero((step == 1) & (after == 3) & (plain == 0x7B)), np.flatnonzero((step == -1) & (after == 2) & (plain == 0x7D))
            lo = 0
            for end in closes:
                if begun:
                    rows.append((path, start, 1 if began_inside else 0, held + data[lo : end + 1]))
                else:
                    lo = int(opens[np.searchsorted(opens, lo)])
                    rows.append((path, start, 0, data[lo : end + 1]))
                held, begun, began_inside, lo = b"", False, False, int(end) + 1
            if begun:
                held += data[lo:]
            elif (k := int(np.searchsorted(opens, lo))) < len(opens):
                held, begun = data[opens[k] :], True
            depth, inside = int(after[-1]), bool(inside) ^ bool((plain == 0x22).sum() % 2)
        if rows:
            yield _parts(rows)
            rows = []
    left()
    if rows:
        yield _parts(rows)


def _parts(rows: list) -> pa.RecordBatch:
    path, start, part, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(start, pa.int64()), pa.array(part, pa.int32()), pa.array([t.decode() for t in text], pa.string())], names=["path", "start", "part", "feature"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a collection; what is no JSON is an error."""
    for batch in batches:
        kind = [json.loads(f).get("type") for f in batch.column("feature").to_pylist()]
        yield batch.filter(pa.array([k == "Feature" for k in kind], pa.bool_()))


def geojson_features_of(spark: SparkSession, path: str) -> DataFrame:
    """``(path, feature)``: features of large collections as JSON texts, a task for each range of bytes.

    A task holds a batch of pieces and the feature at hand. A file without a list of features, with an end missing or with a
    feature that cannot be read is an error; an empty list gives no rows. The rows of a range are in the order of the file.
    """
    pieces = _pieces(spark, path)
    effects = pieces.mapInArrow(_effects, "path string, start long, size long, quotes int, out long, inn long, bytes long, named boolean")
    # What a run of pieces does is added up over its range only where all before it is known: so runs are kept, in their order.
    runs = cut(effects.withColumn("run", F.monotonically_increasing_id()))
    before = Window.partitionBy("path").orderBy("start", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    runs = runs.withColumn("change", F.when(F.col("inside"), F.col("inn")).otherwise(F.col("out"))).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    runs = cut(runs)
    files = runs.groupBy("path").agg(F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.sum("change").alias("depth"), (F.sum("quotes") % 2).alias("open"), F.max("named").alias("named"))
    # A last piece without a brace counts one byte and one level too many.
    ended = ((F.col("bytes") == F.col("size")) & (F.col("depth") == 0)) | ((F.col("bytes") == F.col("size") + 1) & (F.col("depth") == -1))
    bad = files.filter(~ended | (F.col("open") != 0) | ~F.col("named")).select("path").limit(5).collect()
    if bad:
        raise ValueError(f"no whole collection of features: {', '.join(r.path for r in bad)}")
    states = runs.groupBy("path", "start").agg(F.min_by(F.struct("depth", "inside"), "run").alias("s")).select("path", "start", "s.*")
    found = cut(pieces.join(F.broadcast(states), ["path", "start"]).select("path", "start", "size", "value", "depth", "inside").mapInArrow(_cut_features, "path string, start long, part int, feature string"))
    whole = found.filter("part = 0").select("path", "feature")
    ends = found.filter("part > 0")
    number = F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("start", "part"))
    joined = ends.withColumn("n", number).groupBy("path", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part", "feature"))), lambda x: x["feature"]), "").alias("feature"))
    return whole.union(joined.select("path", "feature")).mapInArrow(_checked, "path string, feature string")
