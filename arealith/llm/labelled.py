"""What the classifiers share: folds, the bounded sample of labelled rows, and scoring over whole texts.

A null id has fold 0, which op4 and op10 count to training and op5 holds out; rows without an id are never
learned from, whatever their fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded, slices, spare


def fold(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % parts


def sample_of(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The ``most`` rows with the smallest hashed ids: a fixed, bounded sample."""
    return rows.orderBy(F.xxhash64(key, F.lit(17)), *rows.columns).limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """``(doc_id, label, _text)`` of at most ``most`` labelled rows for which ``keep`` holds.

    The sample is drawn from the label table alone, so it has a proven size when it is broadcast.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & keep)
    return docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(sample_of(ids, most)), "doc_id")


def gathered(texts: DataFrame, vectors: Callable[[pa.Array], list[bytes]], batch_bytes: int = 1_000_000) -> list:
    """(label, vector bytes) of the sample, computed in tasks; the driver gets vectors, never texts.

    Sorted, so that training sees the same order in every run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", batch_bytes):
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(vectors(batch.column("_text")), pa.binary())], names=["label", "vector"])

    kind = texts.schema["label"].dataType.simpleString()
    rows = bounded(texts).select("label", "_text").mapInArrow(run, f"label {kind}, vector binary").toArrow()
    return sorted(zip(rows["label"].to_pylist(), rows["vector"].to_pylist(), strict=True), key=lambda r: (r[1], str(r[0])))


def scored(docs: DataFrame, score: Callable[[pa.Array], dict[str, pa.Array | np.ndarray]], columns: str, keep: list[str], batch_bytes: int = 1_000_000) -> DataFrame:
    """``keep`` columns and those that ``score`` makes of the texts of a batch.

    A new column whose name ``keep`` has already gets an underscore behind it.
    """
    rows = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col("text").alias("text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                made = score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(v) for v in made.values())], names=[*kept, *made])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    names = [*keep, *(spare(c.split()[0], keep) for c in columns.split(", "))]
    return bounded(rows).mapInArrow(run, schema + columns).toDF(*names)
