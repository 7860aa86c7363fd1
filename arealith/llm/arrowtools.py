"""Small Arrow helpers for functions given to ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of rows that one Arrow batch holds at most (a longer row is a batch of its own).
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(rows: DataFrame) -> DataFrame:
    """The rows; their session's Arrow batches are bounded by bytes, unless the session sets its own bound.

    Spark's own bound is 64 MB or 10,000 rows, whole texts of any length.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        conf.set(_BATCH, BATCH_BYTES)
    return rows


def spare(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores behind it as keep it apart from those taken (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name



def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch whose text adds up to about ``most`` bytes (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    part = (np.cumsum(size) - size) // most
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for lo, hi in zip(cut, np.r_[cut[1:], len(size)], strict=True):
        yield batch.slice(int(lo), int(hi - lo))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets (null: empty)."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def utf8_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary column without nulls."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary column over ``data`` cut at ``offsets``."""
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the rows' lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
