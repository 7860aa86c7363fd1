"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length with cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a distance
epsilon. A projection onto principal axes never lengthens a distance. Distinct vectors are sorted by
the cells of an epsilon grid on leading axes, and the sequence is cut into blocks that keep the bounds
of their projections. Intervals of the sequence are joined recursively: two intervals whose bounds are
farther apart than epsilon are skipped with all they hold, others are split into smaller intervals.
Spark joins intervals down to tiles of some 32 blocks. Two tiles that lie in one ball so small that all links hold
are settled by their weights and smallest nodes, so a dense group's vectors are not sent from tile to tile; of other pairs,
blocks are sent once for each pair of tiles that they are near to, and a task goes on from there: pairs of blocks that are too far apart by their bounds are skipped, pairs
that lie in one ball so small that all links hold are counted at once, others are compared by one matrix
product in double precision. What a task holds is two tiles, a fixed number of vectors.

A pair of tiles yields for each of its vectors the number of links, and the merges of smallest known vectors,
never the links themselves, so a dense group costs memory in proportion to its rows. Copies of a vector are
one vector with a weight. The axes come from a bounded sample; they decide only how much is skipped, not
what is found.

Defined results: vectors are compared only under the same non-null label (of any type) and with the same number
of components; a vector that is null, empty, zero or has a null or non-finite component links with
nothing; rows that repeat a vec_id count as vectors of their own under one id, of the same or different
components; a null vec_id stays alone; empty tables give no rows; ties at the threshold link. A vector is held whole:
tiles hold fewer of very long ones. Columns besides vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded
from arealith.operators.components import connected_components
from arealith.sources.tables import cut, stored

#: Bound of the sample that the axes are fitted on.
MOST_SAMPLED = 4_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes_of(good: DataFrame, dims: int, most: int = MOST_SAMPLED) -> dict[int, np.ndarray]:
    """Leading principal axes of a bounded sample of unit vectors, for each number of components in it."""
    rows = good.select("v").orderBy(F.xxhash64("v")).limit(most).toArrow()["v"].to_pylist()
    out: dict[int, np.ndarray] = {}
    for n in sorted({len(r) for r in rows}):
        x = unit(np.array([r for r in rows if len(r) == n]))
        out[n] = np.linalg.eigh(np.cov(x.T, bias=True).reshape(n, n))[1][:, ::-1][:, :dims].T
    return out


def connected(linked: np.ndarray, low_x: np.ndarray, low_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of the given marks that each row and column is connected to by the links of a block pair."""
    big = np.iinfo(np.int64).max
    while True:
        new_x = np.minimum(low_x, np.where(linked, low_y[None], big).min(1, initial=big))
        new_y = np.minimum(low_y, np.where(linked, new_x[:, None], big).min(0, initial=big))
        if (new_x == low_x).all() and (new_y == low_y).all():
            return new_x, new_y
        low_x, low_y = new_x, new_y


COLUMNS = ["label", "n", "cell", "first", "lo", "hi", "ids", "weights", "vectors", "centre", "radius", "weight", "least"]


def grid_blocks(distinct: DataFrame, axes: dict[int, np.ndarray], epsilon: float, dims: int, block: int) -> DataFrame:
    """Blocks of the sequence in grid order: ``(block, set, lo, hi, ids, weights, vectors)``."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            place = [np.zeros(dims)] * len(pdf)
            for n, rows in pdf.groupby(pdf["v"].map(len)).indices.items():
                p = unit(np.array(pdf["v"].iloc[rows].tolist()).reshape(len(rows), n)) @ axes[n].T if n in axes else np.zeros((len(rows), dims))
                p = np.pad(p, ((0, 0), (0, dims - p.shape[1])))
                for r, q in zip(rows, p, strict=True):
                    place[r] = q
            pdf["p"] = place
            yield pdf[["node", "label", "weight", "v", "p"]]

    kind = distinct.schema["label"].dataType.simpleString()
    placed = bounded(distinct).select("node", "label", "weight", "v").mapInPandas(cells, f"node long, label {kind}, weight long, v array<double>, p array<double>")
    ordered = placed.withColumn("set", F.struct("label", F.size("v").alias("n"))).withColumn("cell", F.transform(F.slice("p", 1, 4), lambda x: F.floor(x / epsilon)))
    ordered = ordered.repartitionByRange("set", "cell", "node").sortWithinPartitions("set", "cell", "node").select("node", "label", "weight", "v", "p", "cell")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def made() -> pd.DataFrame:
            v, p = np.array([r[2] for r in held]), np.array([r[3] for r in held])
            x = unit(v)
            centre = x.mean(0)
            ball = {"centre": centre.tolist(), "radius": float(np.sqrt(((x - centre) ** 2).sum(1).max())), "weight": sum(r[1] for r in held), "least": min(r[0] for r in held)}
            row = ball | {"label": held[0][4], "n": v.shape[1], "cell": [int(c) for c in held[0][5]], "first": held[0][0], "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "ids": np.array([r[0] for r in held], np.int64).tobytes(), "weights": np.array([r[1] for r in held], np.int64).tobytes(), "vectors": v.tobytes()}
            held.clear()
            return pd.DataFrame([row])[COLUMNS]

        for pdf in batches:
            for r in zip(pdf["node"], pdf["weight"], pdf["v"], pdf["p"], pdf["label"], pdf["cell"], strict=True):
                if held and (len(held) >= block or held[0][4] != r[4] or len(held[0][2]) != len(r[2])):
                    yield made()
                held.append(r)
        if held:
            yield made()

    packed = ordered.mapInPandas(pack, f"label {kind}, n int, cell array<long>, first long, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary, centre array<double>, radius double, weight long, least long")
    return packed


class Block:
    """A block of vectors in a task: unit vectors, their ball, links counted so far and the smallest node known to be connected."""

    def __init__(self, row: dict):
        self.ids, self.weights = (np.frombuffer(row[k], np.int64) for k in ("ids", "weights"))
        self.x = unit(np.frombuffer(row["vectors"]).reshape(len(self.ids), -1))
        self.lo, self.hi = np.array(row["lo"]), np.array(row["hi"])
        self.centre = self.x.mean(0)
        self.radius = np.sqrt(((self.x - self.centre) ** 2).sum(1).max())
        self.links, self.low = np.zeros(len(self.ids), np.int64), self.ids.copy()


def tile_links(left: list[Block], right: list[Block], own: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, links, low)``: a row of links for each vector with one, and a row without links for each merge of two marks."""
    epsilon, merges = (2 - 2 * cosine) ** 0.5, []

    def marked(block: Block, low: np.ndarray) -> None:
        changed = low != block.low
        if changed.any():
            merges.append(np.unique(np.stack([block.low[changed], low[changed]]), axis=1))
            block.low = low

    for i, a in enumerate(left):
        for b in left[i:] if own else right:
            gap = np.maximum(np.maximum(a.lo - b.hi, b.lo - a.hi), 0)
            if gap @ gap > epsilon**2 * (1 + 1e-9):
                continue
            if np.sqrt(((a.centre - b.centre) ** 2).sum()) + a.radius + b.radius <= epsilon * (1 - 1e-6):  # all are linked
                a.links += b.weights.sum() - (a.weights if a is b else 0)
                if a is not b:
                    b.links += a.weights.sum()
                if a is not b or len(a.ids) > 1:
                    least = min(a.low.min(), b.low.min())
                    marked(a, np.full(len(a.ids), least))
                    marked(b, np.full(len(b.ids), least))
                continue
            linked = a.x @ b.x.T >= cosine
            if a is b:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            a.links += linked @ b.weights
            if a is not b:
                b.links += a.weights @ linked
            low_a, low_b = connected(linked, a.low, b.low)
            marked(a, np.minimum(low_a, low_b) if a is b else low_a)
            marked(b, b.low if a is b else low_b)
    found = [(k.ids[k.links > 0], k.links[k.links > 0]) for k in [*left, *(() if own else right)]]
    ids, links = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    old, new = np.concatenate([*merges, np.zeros((2, 0), np.int64)], axis=1)
    return np.r_[ids, old], np.r_[links, np.zeros(len(old), np.int64)], np.r_[ids, new]


def tile_counts(sent: DataFrame, cosine: float) -> DataFrame:
    """Each pair of tiles: ``(node, links, low)``; ``sent`` holds a row for each block and pair of tiles (set, a, b) that it goes to."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, a, b = (k.as_py() for k in key)
        sides = table.column("t").to_numpy()
        order = np.argsort(table.column("seq").to_numpy(), kind="stable")
        columns = ("lo", "hi", "ids", "weights", "vectors")
        blocks = [(sides[k], Block({c: table.column(c)[int(k)].as_py() for c in columns})) for k in order]
        out = tile_links([x for t, x in blocks if t == a], [x for t, x in blocks if t == b], a == b, cosine)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "low"])

    return sent.groupBy("set", "a", "b").applyInArrow(run, "node long, links long, low long")


def gap_of(a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> Column:
    """Squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(a_lo, b_hi, lambda x, y: x - y), F.zip_with(b_lo, a_hi, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, g: s + g * g)


def tile_pairs(blocks: DataFrame, epsilon: float, dims: int, tile: int, fan: int = 8) -> DataFrame:
    """Pairs (a <= b) of tiles within epsilon of each other, with their bounds, by joining ever smaller intervals of each set's sequence.

    Level 0 is the tiles, ``tile`` blocks each, numbered along each set's sequence; an interval of level k holds ``fan``
    intervals of level k - 1. Only bounds are joined here, not vectors.
    """
    lowest, highest = (F.array(*(f(F.col(c)[d]) for d in range(dims))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi")))
    level = cut(blocks.groupBy("set", F.floor(F.col("seq") / tile).alias("at")).agg(lowest, highest))
    levels = [level]
    most = level.agg(F.max("at")).first()[0]
    while most is not None and most > 0:
        most //= fan
        level = cut(level.groupBy("set", F.floor(F.col("at") / fan).alias("at")).agg(lowest, highest))
        levels.append(level)
    bounds = ("a_lo", "a_hi", "b_lo", "b_hi")
    top = levels[-1].select("set", F.col("at").alias("a"), F.col("at").alias("b"), *(F.col(c[2:]).alias(c) for c in bounds))
    for below in reversed(levels[:-1]):
        side = [below.select("set", F.floor(F.col("at") / fan).alias(s), F.col("at").alias(f"{s}_at"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")) for s in "ab"]
        near = top.select("set", "a", "b").join(side[0], ["set", "a"]).join(side[1], ["set", "b"]).filter((F.col("a_at") <= F.col("b_at")) & (gap_of(*bounds) <= epsilon**2 * (1 + 1e-9)))
        top = cut(near.select("set", F.col("a_at").alias("a"), F.col("b_at").alias("b"), *bounds))
    return top


def tile_balls(held: DataFrame) -> DataFrame:
    """``(set, t, centre, radius, weight, least)`` of every tile: a ball around its blocks' balls, its vectors' weight and smallest node."""
    added = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    balls = held.groupBy("set", "t").agg(F.collect_list(F.struct("centre", "radius")).alias("balls"), F.sum("weight").alias("weight"), F.min("least").alias("least"))  # at most a tile's blocks
    total = F.aggregate("balls", F.transform(F.get("balls", F.lit(0))["centre"], lambda _: F.lit(0.0)), lambda s, b: added(s, b["centre"]))
    balls = balls.withColumn("centre", F.transform(total, lambda c: c / F.size("balls")))
    radius = F.array_max(F.transform("balls", lambda b: F.sqrt(distance(b["centre"], F.col("centre"))) + b["radius"]))
    return balls.select("set", "t", "centre", radius.alias("radius"), "weight", "least")


def distance(x: Column, y: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def settled(pairs: DataFrame, balls: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of tiles that are not all linked, and ``(set, t, more, low)``: links that a tile's vectors have by pairs that are.

    All vectors of two tiles in one ball of epsilon's diameter are linked: their weights are added up and their marks merged by the
    tiles' smallest nodes, without sending vectors.
    """
    side = lambda s: balls.select("set", *(F.col(c).alias(s if c == "t" else f"{s}_{c}") for c in ("t", "centre", "radius", "weight", "least")))
    both = pairs.join(side("a"), ["set", "a"]).join(side("b"), ["set", "b"])
    far = F.when(F.col("a") == F.col("b"), 2 * F.col("a_radius")).otherwise(F.sqrt(distance(F.col("a_centre"), F.col("b_centre"))) + F.col("a_radius") + F.col("b_radius"))
    both = cut(both.select(*pairs.columns, (far <= epsilon * (1 - 1e-6)).alias("one"), "a_weight", "b_weight", "a_least", "b_least"))
    whole = both.filter("one")
    rows = whole.select("set", F.col("a").alias("t"), F.col("b_weight").alias("more"), F.col("b_least").alias("low"), (F.col("a") == F.col("b")).alias("own"))
    rows = rows.union(whole.filter("a <> b").select("set", "b", "a_weight", "a_least", F.lit(False)))
    return both.filter("not one").select(*pairs.columns), rows.groupBy("set", "t").agg(F.sum("more").alias("more"), F.min("low").alias("low"), F.max("own").alias("own"))


def settled_links(held: DataFrame, whole: DataFrame) -> DataFrame:
    """``(node, links, low)`` of the vectors of tiles with settled pairs; a vector is no link of itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, weights, more, low, own in zip(*(batch.column(c).to_pylist() for c in ("ids", "weights", "more", "low", "own")), strict=True):
                node, weight = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(more - weight * own), pa.array(np.minimum(low, node))], names=["node", "links", "low"])

    rows = held.select("set", "t", "ids", "weights").join(whole, ["set", "t"])
    return bounded(rows).select("ids", "weights", "more", "low", "own").mapInArrow(run, "node long, links long, low long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, dims: int = 8, block: int = 128, tile: int = 32, tile_bytes: int = 16_000_000) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    epsilon = (2 - 2 * cosine) ** 0.5
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    good = rows.filter(may_link())
    # 0.0 and -0.0 are one key to grouping. Numbers of the stored rows tell vectors apart, whatever their ids.
    distinct = good.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = axes_of(distinct, dims)
    tile = max(1, min(tile, tile_bytes // (8 * block * max(axes, default=1))))
    packed = stored(grid_blocks(distinct, axes, epsilon, dims, block), "blocks")
    numbered = sequence_numbers(packed)
    pairs = tile_pairs(numbered, epsilon, dims, tile)
    of_tile = numbered.select(F.col("set.label").alias("label"), F.col("set.n").alias("n"), "first", "set", "seq", F.floor(F.col("seq") / tile).alias("t"))
    placed = packed.join(of_tile, ["label", "n", "first"])
    pairs, together = settled(pairs, tile_balls(placed.select("set", "t", "centre", "radius", "weight", "least")), epsilon)
    together = cut(together)
    held = placed.select("set", "t", "seq", "lo", "hi", "ids", "weights", "vectors")
    whole = pairs.filter("a <> b").select("set", "a", "b", F.explode(F.array(*(F.struct(F.col(s).alias("t"), F.col(f"{o}_lo").alias("o_lo"), F.col(f"{o}_hi").alias("o_hi")) for s, o in ("ab", "ba")))).alias("s")).select("set", "a", "b", "s.*")
    whole = whole.union(pairs.filter("a = b").select("set", "a", "b", "a", "a_lo", "a_hi"))
    sent = whole.join(held, ["set", "t"]).filter(gap_of("lo", "hi", "o_lo", "o_hi") <= epsilon**2 * (1 + 1e-9)).drop("o_lo", "o_hi")
    found = stored(tile_counts(sent, cosine).union(settled_links(placed, together)), "tile-links")
    counts = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("node <> low").select("node", "low"), "node", "low")

    known = distinct.select("node", "first", "weight").join(counts, "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "node")), "vector-links")
    least = cut(known.groupBy("component").agg(F.min("first").alias("component_id")))
    named = known.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    of_vector = distinct.select("label", "v", "node").join(named, "node").drop("node")
    return with_results(rows, good, cut(of_vector))  # a stored side lets Spark split the rows of a frequent vector


def sequence_numbers(packed: DataFrame) -> DataFrame:
    """Blocks numbered along each set's sequence: ``(set, block, first, seq, lo, hi)``, bounds without vectors.

    Counts by (set, first cell) and a prefix over these give each cell's base, so no window holds a whole set.
    """
    from pyspark.sql import Window

    bounds = cut(packed.select(F.struct("label", "n").alias("set"), "cell", "first", "lo", "hi"))
    cells = bounds.groupBy("set", "cell").agg(F.count("*").alias("c"))
    base = cells.select("set", "cell", F.coalesce(F.sum("c").over(Window.partitionBy("set").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("set", "cell").orderBy("first"))
    out = bounds.withColumn("at", at).join(base, ["set", "cell"])
    return cut(out.select("set", "first", F.col("first").alias("block"), (F.col("base") + F.col("at") - 1).alias("seq"), "lo", "hi"))


def may_link() -> Column:
    """Whether a row's vector may have links at all."""
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    plain = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & plain & (size > 0) & (size < float("inf"))
    return F.coalesce(ok, F.lit(False))


def with_results(rows: DataFrame, good: DataFrame, of_vector: DataFrame) -> DataFrame:
    """Each row's result: through its vector where it may link, else alone."""
    linked = good.join(of_vector, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~may_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
