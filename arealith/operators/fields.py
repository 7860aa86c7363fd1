"""Values of a field looked up by random ranks: the field goes past units of work in blocks, and no task holds all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks in a block of a field (2 MB), edges in a chunk, and numbers that a unit looks up at a time (16 bytes each).
BLOCK_BITS, CHUNK, LOOKED_UP = 18, 1 << 17, 1 << 22


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(rows: DataFrame) -> DataFrame:
    """The rows; their session's Arrow batches are bounded by 4 MB, unless the session sets its own bound."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        conf.set(_BATCH, "4m")
    return rows


def past_units(rows: DataFrame, known: DataFrame, units: int, bits: int) -> DataFrame:
    """``rows`` with a column ``unit`` (0 to units - 1), and the field ``known (k, z)`` in blocks ``(h, zs)`` of 2^bits for every unit.

    A unit's rows lie together, ordered: first those given (h is -1), then the blocks by number. ``k`` counts from 0 without gaps.
    """
    blocks = known.groupBy(F.expr(f"k div {1 << bits}").alias("h")).agg(F.sort_array(F.collect_list(F.struct("k", F.col("z").cast("double").alias("z")))).alias("b")).select("h", F.col("b.z").alias("zs"))
    blocks = blocks.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)).cast("array<long>")))
    both = rows.withColumns({"unit": F.col("unit").cast("long"), "h": F.lit(-1).cast("long")}).unionByName(blocks, allowMissingColumns=True)
    return both.repartition(min(units, 2000), "unit").sortWithinPartitions("unit", "h")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """``(unit, h, rows)``: stretches of a unit's rows, and its blocks one by one."""
    for batch in batches:
        unit, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "h"))
        at = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (h[1:] != h[:-1])]) if len(unit) else []
        for lo, hi in zip(at, np.r_[at[1:], len(unit)] if len(unit) else [], strict=True):
            yield int(unit[lo]), int(h[lo]), batch.slice(int(lo), int(hi - lo))


def flat(array: pa.Array, kind: pa.DataType) -> np.ndarray:
    """The numbers of a list column; a null is 0."""
    return pc.fill_null(array.flatten().cast(kind), 0).to_numpy(zero_copy_only=False)


def fill(found: np.ndarray, ranks: np.ndarray, h: int, values: np.ndarray, bits: int) -> None:
    """Puts a block's values where the ranks ask for them."""
    here = ranks >> bits == h
    found[here] = values[ranks[here] & ((1 << bits) - 1)]


def rank_bits(n: int) -> tuple[int, int]:
    """Bits of a rank below n, and of its lower half (as in ``dealt_rank``)."""
    bits = max((n - 1).bit_length(), 1)
    return bits, (bits + 1) // 2


def round_tables(low: int, rounds: int, *keys: Column) -> Column:
    """All that a Feistel round adds: the hashed half for each round and each value of the other half, some 6 sqrt(2 n) numbers a key."""
    text = lambda i: F.concat_ws("|", *(k.cast("string") for k in keys), F.shiftright(i, low).cast("string"), i.bitwiseAND(F.lit((1 << low) - 1)).cast("string"))
    half = lambda i: F.conv(F.substring(F.md5(text(i)), 1, 8), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(rounds * (1 << low) - 1)), lambda i: half(i).bitwiseAND(F.lit((1 << low) - 1)).cast("int"))


def dealt(ranks: np.ndarray, n: int, table: np.ndarray, walks: int = 60) -> np.ndarray:
    """Where a draw puts ranks: ``dealt_rank`` by its tables."""
    bits, low = rank_bits(n)
    tables, x, out = table.astype(np.int64).reshape(-1, 1 << low), ranks.copy(), np.arange(len(ranks))
    for _ in range(walks):
        y = x[out]
        for r, t in enumerate(tables):
            y ^= t[y >> low] if r % 2 else (t[y & ((1 << low) - 1)] & ((1 << (bits - low)) - 1)) << low
        x[out] = y
        out = out[y >= n]
        if not len(out):
            break
    return x
