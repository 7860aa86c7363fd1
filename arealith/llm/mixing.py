"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is one long stream of words (its documents in a hashed order), cut into blocks of equal
size. A source's target gives an exact quota of block draws: whole passes over its blocks, then a
keyed pseudo-random subset for the rest. The draws of a source are permuted, and a binary tree over
the output shards splits the quotas of all sources by multivariate-hypergeometric draws: the shard whose
quotas hold a draw's place takes it, and what no shard takes is not in the mix. Draws are exact at any size
(`hypergeometric`). A tree node's draw depends on the seed and the node alone, so no table of quotas by
shard exists anywhere: the tasks that draw blocks walk the tree's top, the draws are shuffled to its
subtrees, and only there are the levels below drawn, each node in one place. Within a shard, rows are
ordered by a keyed hash. The mix as documents gives each document and pass over it to the shard and place of
its first drawn piece.

Only one row for each *source* reaches the driver, and tasks hold an entry for each source. Word offsets
within a source are prefix sums in two steps (hash buckets of a source, then rows within a bucket), so a
source that holds a third of all rows is spread over as many tasks as it has buckets; rows of one doc_id or
of none are spread by their texts.

Defined results: null text has no words; the null source is a source of its own, last in order;
empty tables give no rows; repeated rows are separate documents; ties in the hashed order fall to
doc_id, size, then hashes of the text and of the other columns kept. A very long text is one row: cutting it
holds the positions of its words. Further columns may have any name; the report does not read them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from arealith.llm.arrowtools import bounded
from arealith.sources.tables import cut

WORD = "[^\\x20\\x09-\\x0D]+"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], repeats: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; a target stops at ``repeats`` times its size, the excess is reshared."""
    cap = [repeats * s for s in sizes]
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = cap[i]
        left -= sum(cap[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return target


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1, row by row: a Feistel network on the next even power of two, cycle-walked."""
    n64 = np.maximum(n.astype(np.uint64), np.uint64(1))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2 + 1e-12).astype(np.uint64)
    bits += ((np.uint64(1) << (bits + bits)) < n64).astype(np.uint64)
    out, todo = x.astype(np.uint64).copy(), np.arange(len(x))
    while len(todo):
        b, k = bits[todo], key[todo].astype(np.uint64)
        mask = (np.uint64(1) << b) - np.uint64(1)
        left, right = out[todo] >> b, out[todo] & mask
        for r in range(4):
            f = mix64(right + k + np.uint64((int(_GOLD) * (r + 1)) & (2**64 - 1))) & mask
            left, right = right, left ^ f
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n64[todo]]
    return out.astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = 1_000_000_000) -> int:
    """How many of ``n`` items drawn without replacement are good; exact for any number of items.

    numpy draws it below ``most`` items. Above, give every item a uniform key: the items with keys below n / (good + bad)
    are a binomial number of good and of bad ones, drawn in parts below ``most``. Those that miss the n are then
    drawn from the rest, or those too many taken back, again without replacement: about sqrt(n) items, so a few
    rounds end at numbers that are drawn one by one.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    if good + bad < most:
        return int(rng.hypergeometric(good, bad, n))
    if n <= 64:
        taken = 0
        for k in range(n):
            taken += int(rng.integers(good + bad - k)) < good - taken
        return taken
    if n > (good + bad) // 2:  # the items left over are drawn in their place
        return good - hypergeometric(rng, good, bad, good + bad - n, most)
    p = n / (good + bad)
    g, b = (sum(int(rng.binomial(min(most, k - at), p)) for at in range(0, k, most)) for k in (good, bad))
    if g + b <= n:
        return g + hypergeometric(rng, good - g, bad - b, n - g - b, most)
    return g - hypergeometric(rng, g, b, g + b - n, most)


def split_quota(quota: Sequence[int], n: int, key: Sequence[int]) -> np.ndarray:
    """How many of ``n`` items drawn without replacement fall to each source (a tree node's draw)."""
    rng, left = np.random.default_rng(key), int(sum(quota))
    if left < 1_000_000_000:
        return rng.multivariate_hypergeometric(quota, n, method="marginals").astype(np.int64)
    out = []
    for q in map(int, quota):
        out.append(hypergeometric(rng, q, left - q, n))
        left, n = left - q, n - out[-1]
    return np.array(out, np.int64)


@dataclass(frozen=True)
class MixPlan:
    """What the driver holds: one entry for each source."""

    sources: list
    size: list[int]
    target: list[float]
    block: list[int]
    blocks: list[int]
    quota: list[int]
    shards: int
    seed: int

    @property
    def depth(self) -> int:
        """Levels of the tree that all drawing tasks walk: 8,192 subtrees at most, and 2^20 quotas in all."""
        return int(np.log2(min(8192, max(1, 2**20 // max(1, len(self.quota))))))

    def shard_of(self, source: np.ndarray, place: np.ndarray, depth: int = 64, nodes: dict | None = None) -> np.ndarray:
        """Walk the splitting tree: the output shard of a source's draw number ``place``, -1 beyond its quota.

        With a ``depth``, the first shard of the subtree at that level. ``nodes`` keeps nodes' draws for a task.
        """
        nodes = {} if nodes is None else nodes
        if len(nodes) * len(self.quota) > 2**21:
            nodes.clear()
        shard, place = np.full(len(source), -1, np.int64), place.astype(np.int64)
        quota = np.array(self.quota, np.int64)
        total = int(quota.sum())
        stack = [(0, self.shards, quota, np.flatnonzero(place < quota[source]), 0)]
        while stack:
            lo, hi, quota, rows, level = stack.pop()
            if not len(rows):
                continue
            if hi - lo == 1 or level == depth:
                shard[rows] = lo
                continue
            mid = (lo + hi) // 2
            if (lo, hi) not in nodes:
                nodes[lo, hi] = split_quota(quota, total * mid // self.shards - total * lo // self.shards, (self.seed, lo, hi))
            left = nodes[lo, hi]
            goes = place[rows] < left[source[rows]]
            go = rows[~goes]
            place[go] -= left[source[go]]
            stack.append((lo, mid, left, rows[goes], level + 1))
            stack.append((mid, hi, quota - left, go, level + 1))
        return shard


def plan_mix(sizes: dict, weights: Sequence[float] = (5, 2, 1), repeats: int = 3, block_words: int = 256, shard_blocks: int = 1024, seed: int = 20) -> MixPlan:
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    size = [int(sizes[s] or 0) for s in sources]
    target = water_fill(size, [weights[i % len(weights)] for i in range(len(sources))], repeats)
    block = [max(1, min(block_words, s // 256)) for s in size]
    blocks = [-(-s // b) for s, b in zip(size, block, strict=True)]
    quota = []
    for s, t, b, n in zip(size, target, block, blocks, strict=True):
        whole = min(repeats, int(t // s)) if s else 0
        quota.append(min(repeats * n, whole * n + (round((t - whole * s) / b) if s else 0)))
    return MixPlan(sources, size, target, block, blocks, quota, max(1, -(-sum(quota) // shard_blocks)), seed)


def index_documents(docs: DataFrame, keep: Sequence[str] = (), **options) -> tuple[DataFrame, MixPlan]:
    """Documents with ``_size``, ``_source`` (number) and ``_start`` (first word in the source's stream), and the plan.

    ``keep`` names further columns, none of which may begin with an underscore. About 20,000 rows of a source share a
    bucket, 1,024 buckets at least.
    """
    buckets = max(1024, docs.count() // 20_000)
    cols = ["doc_id", "source", *keep]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key")
    tie = F.xxhash64("text", *(c for c in keep if c != "text")).alias("_tie")
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("_bucket")
    sized = docs.select(*cols, word_count().alias("_size"), key, bucket, tie)
    if not keep:  # small rows: texts are then read once
        sized = cut(sized)
    totals = sized.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_words"))
    by_source = totals.groupBy("_key").agg(F.sum("_words").alias("words")).collect()  # a row for each source
    plan = plan_mix({None if r._key == "n" else r._key[1:]: r.words for r in by_source}, **options)
    number = docs.sparkSession.createDataFrame([("n" if s is None else f"s{s}", i) for i, s in enumerate(plan.sources)] or [("n", 0)], "_key string, _source int")
    before = F.sum("_words").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("_key", "_bucket", F.coalesce(before, F.lit(0)).alias("_base")).join(number, "_key")
    within = F.sum("_size").over(Window.partitionBy("_key", "_bucket").orderBy("doc_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("_within", F.coalesce(within, F.lit(0))).join(base, ["_key", "_bucket"])
    return placed.select(*cols, "_size", "_source", (F.col("_base") + F.col("_within")).alias("_start")), plan


def drawn(plan: MixPlan, source: np.ndarray, start: np.ndarray, size: np.ndarray, nodes: dict | None = None) -> pd.DataFrame:
    """All draws that touch the given spans of the source streams: row (position), subtree, place, key, epoch, first word, words."""
    block, blocks, quota = (np.array(x, np.int64) for x in (plan.block, plan.blocks, plan.quota))
    w = block[source]
    first = start // w
    count = np.where(size > 0, (start + np.maximum(size, 1) - 1) // w - first + 1, 0)
    row = np.repeat(np.arange(len(source)), count)
    b = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    s, found = source[row], []
    for epoch in range(int((quota // np.maximum(blocks, 1)).max(initial=0)) + 1):
        seed = mix64(np.uint64(plan.seed * 64 + epoch) + _GOLD * (s.astype(np.uint64) + np.uint64(1)))
        place = epoch * blocks[s] + permute(b, blocks[s], seed)
        inner = np.flatnonzero(place < quota[s])  # passes are shuffled together within the quota
        place[inner] = permute(place[inner], quota[s[inner]], mix64(np.uint64(plan.seed * 64 + 63) + _GOLD * (s[inner].astype(np.uint64) + np.uint64(1))))
        subtree = plan.shard_of(s, place, plan.depth, nodes)
        take = np.flatnonzero(subtree >= 0)
        r, at, place = row[take], s[take], place[take]
        lo = np.maximum(b[take] * w[r], start[r])
        hi = np.minimum((b[take] + 1) * w[r], start[r] + size[r])
        key = mix64(place.astype(np.uint64) + _GOLD * (at.astype(np.uint64) + np.uint64(7))).view(np.int64)
        found.append(pd.DataFrame({"row": r, "subtree": subtree[take], "place": place, "key": key, "epoch": epoch, "first_word": lo - start[r], "words": hi - lo}))
    return pd.concat(found, ignore_index=True)


def with_shards(draws: DataFrame, plan: MixPlan, source: str = "_source", subtree: str = "subtree", place: str = "place") -> DataFrame:
    """Adds ``shard``: draws meet at their subtree, whose levels are drawn there and nowhere else."""

    @F.pandas_udf("long")
    def shard_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        nodes: dict = {}
        for s, at in parts:
            yield pd.Series(plan.shard_of(s.to_numpy(np.int64), at.to_numpy(np.int64), nodes=nodes))

    return draws.repartition(F.col(subtree)).withColumn("shard", shard_of(F.col(source).cast("long"), F.col(place)))


def draw_blocks(indexed: DataFrame, plan: MixPlan, batch_words: int = 8_000_000) -> DataFrame:
    """The mix itself: a row for each drawn piece of a document, with its shard and its place in it.

    ``(doc_id, _source, _start, _size, slot_key, epoch, first_word, words, shard)``; a shard's order is
    that of ``slot_key``. Batches are cut so that no more than ``batch_words`` words are drawn from at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes: dict = {}
        for whole in batches:
            part = (whole["_size"].cumsum() // batch_words).to_numpy()
            for _, pdf in whole.groupby(part):
                d = drawn(plan, pdf["_source"].to_numpy(np.int64), pdf["_start"].to_numpy(np.int64), pdf["_size"].to_numpy(np.int64), nodes)
                out = pdf[["doc_id", "_source", "_start", "_size"]].iloc[d["row"].to_numpy()].reset_index(drop=True)
                yield pd.concat([out, d.drop(columns="row").rename(columns={"key": "slot_key"})], axis=1)

    cols = indexed.select("doc_id", "_source", "_start", "_size").filter("_size > 0")
    found = cols.mapInPandas(run, "doc_id long, _source int, _start long, _size long, subtree long, place long, slot_key long, epoch int, first_word long, words long")
    return with_shards(found, plan).drop("subtree", "place")


def mix_shards(draws: DataFrame, shard: str = "shard", order: Sequence[str] = ("slot_key", "first_word")) -> DataFrame:
    """Local shuffle: every shard's draws in one partition, in the order of their keyed hash."""
    return draws.repartition(F.col(shard)).sortWithinPartitions(shard, *order)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """For each document the words that the shards take of it, with its source's size and target.

    ``shard`` is that of the first piece of its first pass, null for a document of which nothing is drawn.
    """
    indexed, plan = index_documents(docs.select("doc_id", "source", "text"), **options)
    spark = docs.sparkSession
    facts = spark.createDataFrame([(i, s, float(t)) for i, (s, t) in enumerate(zip(plan.size, plan.target, strict=True))] or [(0, 0, 0.0)], "_source int, source_size long, target double")
    cols = ["doc_id", "_source", "_start", "_size"]
    none = indexed.filter("_size = 0").select("doc_id", "_source", "_size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("shard"))
    undrawn = [F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("shard"), F.lit(None).cast("long").alias("place")]
    place = F.shiftleft(F.col("epoch").cast("long"), 56) + F.col("first_word")
    rows = indexed.filter("_size > 0").select(*cols, *undrawn).union(draw_blocks(indexed, plan).select(*cols, "words", "shard", place))
    taken = rows.groupBy(*cols).agg(F.sum("words").alias("taken"), F.min_by("shard", "place").alias("shard")).select("doc_id", "_source", "_size", "taken", "shard")
    return taken.union(none).join(F.broadcast(facts), "_source").select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "shard")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each document and pass over it, its text cut to the words drawn in that pass.

    Returns the columns of ``docs`` (text and n_chars changed); a document of which nothing is drawn has no row.
    A text drawn whole keeps every character; otherwise drawn runs of words keep their own white space
    and are joined by a line break. Each is dealt to the shard of its first drawn piece: a shard's rows are
    in one partition, in the order of that piece's keyed hash (within a block, of the source's stream).
    """
    import re

    names, fields = docs.columns, {f.name: f for f in docs.schema}
    own = {c: c if c in ("doc_id", "source", "text", "n_chars") else f"k{i}" for i, c in enumerate(names)}
    safe = docs.select(*(F.col(c).alias(own[c]) for c in names))
    rest = [own[c] for c in names if c not in ("doc_id", "source")]
    indexed, plan = index_documents(safe, keep=rest, **options)
    word = re.compile("[^ \t-\r]+")
    marks = ["_subtree", "_place", "_slot", "_source", "_start"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes: dict = {}
        for whole in batches:
            for _, pdf in whole.groupby((whole["_size"].cumsum() // 2_000_000).to_numpy()):
                d = drawn(plan, pdf["_source"].to_numpy(np.int64), pdf["_start"].to_numpy(np.int64), pdf["_size"].to_numpy(np.int64), nodes)
                texts, sizes, rows, cut, dealt = pdf["text"].to_numpy(), pdf["_size"].to_numpy(), [], [], []
                for (row, _), g in d.sort_values(["row", "epoch", "first_word"]).groupby(["row", "epoch"], sort=False):
                    text = texts[row]
                    first, count = g["first_word"].to_numpy(), g["words"].to_numpy()
                    if count.sum() < sizes[row]:
                        at = np.array([m.span() for m in word.finditer(text)])
                        new = np.flatnonzero(np.r_[True, first[1:] != (first + count)[:-1]])
                        last = np.r_[new[1:] - 1, len(first) - 1]
                        text = "\n".join(text[at[a, 0] : at[b - 1, 1]] for a, b in zip(first[new], (first + count)[last], strict=True))
                    rows.append(row)
                    cut.append(text)
                    dealt.append((g["subtree"].iat[0], g["place"].iat[0], g["key"].iat[0]))
                out = pdf.iloc[rows].reset_index(drop=True)
                out["text"] = pd.Series(cut, dtype=object)
                if "n_chars" in names:
                    out["n_chars"] = pd.Series([len(t) for t in cut], dtype="int64")
                out["_subtree"], out["_place"], out["_slot"] = np.array(dealt, np.int64).reshape(-1, 3).T
                yield out[[*own.values(), *marks]]

    schema = StructType([*(StructField(own[c], fields[c].dataType) for c in names), *(StructField(c, LongType()) for c in marks)])
    found = bounded(indexed).filter("_size > 0").mapInPandas(run, schema)
    dealt = with_shards(found, plan, subtree="_subtree", place="_place")  # a shard lies in one partition, as its subtree does
    return dealt.sortWithinPartitions("shard", *marks[2:]).select(*own.values()).toDF(*names)
