"""Media columns: payloads stored as progressive JPEG images, and images decoded to RGB tensors and features.

Defined results: null is an empty payload (576 bytes 255); equal payloads (ties, repeated rows) give equal images,
tensors and features; a null id is kept as null; empty tables give no rows; a very long text is an image of its own
slice; further columns are kept where they are named, a new column of such a name gets an underscore.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealith.llm import jpeg
from arealith.llm.arrowtools import bounded, slices, spare


def stored_images(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``media``, the UTF-8 bytes of a text as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_data", 1_500_000):
                data = [d or b"" for d in batch.column("_data").to_pylist()]
                media = jpeg.encode([jpeg.pad(d) for d in data], [len(d) for d in data])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(media, pa.binary())], names=[*kept, "media"])

    cols = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(text).cast("binary").alias("_data"))
    kept = cols.columns[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema[:-1])
    return bounded(cols).mapInArrow(run, schema + "media binary").toDF(*keep, spare("media", keep))


def features_of(tensor: np.ndarray) -> str:
    """Size, channel means in thousandths and a checksum of a tensor."""
    h, w, _ = tensor.shape
    mean = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h};{mean[0]},{mean[1]},{mean[2]};{zlib.crc32(tensor.tobytes()):08x}"


def decoded_images(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), tensors: bool = True, media: str = "media") -> DataFrame:
    """``keep`` columns, width, height, ``rgb`` (row by row; null if not wanted), feature, and the payload's facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 2_000_000):
                files = batch.column("media").to_pylist()
                out = []
                images, coefs = jpeg.decode(files)
                for f, im, coef, blocks in zip(files, images, coefs, jpeg.samples(images, coefs), strict=True):
                    tensor = jpeg.rgb(im, blocks)
                    data, n = jpeg.payload(im, coef)
                    out.append((im.width, im.height, tensor.tobytes() if tensors else None, features_of(tensor), n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(f), hashlib.sha256(f).hexdigest()))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*kept, *names])

    names = ["width", "height", "rgb", "feature", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    cols = rows.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(media).alias("media"))
    kept = cols.columns[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema[:-1])
    return bounded(cols).mapInArrow(run, f"{schema}width int, height int, rgb binary, feature string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string").toDF(*keep, *(spare(n, keep) for n in names))
