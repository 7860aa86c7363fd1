"""Ranked lexical search of a query set against all documents, by two trees.

*Vectors.* A pass over the texts leaves of each document its number of terms and how often it holds the
terms of the items; document frequencies are added up from counts of each task. An item is a vector of
weights, a document one of impacts, a score their product in whole numbers.

*Trees.* Items are put in the order of their leading principal coordinate and grouped by 8 and by 64; the documents
of a slice are put in the order of their rarest term and their length and grouped by 16 and by 256. A node
holds the largest value of every coordinate below it, so the product of two nodes is no less than any score between
them. A pair of nodes is opened only where this bound reaches the weakest k-th score among the node's items; the pairs
that are left at the bottom are scored exactly. Nothing is lost by it: equal scores are never pruned.

*Thresholds.* The k-th scores start from those of some ``SAMPLE`` documents (any k documents give a lower bound), and rise
in every task with its own best. A task emits at most k documents an item; the last ranking is over these.

Items are taken in blocks of at most 512 (fewer where they are long), each with a pass over the documents, so what a task
holds of them is bounded by the block and the longest item. Scores are products of doubles where all sums
stay below 2^53, and of 64-bit integers where they do not.

Defined results: null and empty texts have no term, are not counted and never found, as items they find nothing; ties are
broken by ascending doc_id (null last), repeated rows are documents (or items) of their own; empty tables give no rows.
A very long text is a slice of its own. Columns besides doc_id and text, item_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded, lists, slices, utf8
from arealith.llm.textarrays import mix64, rows_of, span_hash, words
from arealith.operators.ranks import running
from arealith.sources.tables import stored

#: Bytes of terms: ASCII letters and digits, and all of other scripts' characters.
TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Half the bytes of the items of a block (64 an item at least); documents that give the first thresholds.
BLOCK, SAMPLE = 32_768, 20_000
#: Items of a node, nodes of the next one; the same of documents.
ITEMS, DOCS = 8, 16
#: Doubles hold all whole numbers below this; impacts are below a million.
EXACT = 2**53
LAST = np.iinfo(np.int64).max


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and each text's first one."""
    data, offsets = utf8(texts)
    start, end, first = words(LOWER[data], offsets, TERM)
    return mix64(span_hash(LOWER[data], start, end)[0] + (end - start).astype(np.uint64)), first


class Vocabulary:
    """Numbers of the terms of a block of items."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.near = np.zeros(1 << 16, bool)
        self.near[self.hashes & np.uint64(0xFFFF)] = True

    def counts(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and occurrences of every term that a row holds, in the order of rows."""
        at = np.flatnonzero(self.near[h & np.uint64(0xFFFF)])
        number = np.searchsorted(self.hashes, h[at])
        same = self.hashes[np.minimum(number, len(self.hashes) - 1)] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        key, many = np.unique(rows_of(first)[at[same]] * max(len(self.hashes), 1) + number[same], return_counts=True)
        return key // max(len(self.hashes), 1), key % max(len(self.hashes), 1), many


def vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with a term; terms are numbers of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in slices(whole, "_text", 1_000_000):
                    h, first = term_hashes(batch.column("_text"))
                    row, number, many = vocabulary.counts(h, first)
                    each = np.bincount(row, minlength=batch.num_rows)
                    out = [batch.column("doc_id"), pa.array(np.diff(first)), lists(number, each, pa.int32()), lists(many, each, pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(np.diff(first) > 0))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return bounded(texts).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def frequencies(found: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term: a task counts its own, sums are one row a term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], names=["term", "df"])

    return dict(found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect())


class ItemTree:
    """Items' weights in an order that puts like ones together, and the maxima of their groups, level by level."""

    def __init__(self, weights: np.ndarray):
        self.order = _principal_order(weights)
        leaf = weights[self.order]
        self.levels = [leaf]
        for _ in range(2):
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), ITEMS)) if len(below) else below)
        top = self.levels[-1].max(0).sum() if len(leaf) else 0
        if top * 1_000_000 < EXACT:
            self.levels = [x.astype(np.float64) for x in self.levels]
        self.empty = ~leaf.any(1)

    def weakest(self, least: np.ndarray) -> list[np.ndarray]:
        """The smallest threshold of every node's items."""
        out = [least]
        for _ in range(2):
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), ITEMS)) if len(least) else least)
        return out


def _principal_order(weights: np.ndarray, rounds: int = 20) -> np.ndarray:
    x = weights / np.maximum(np.sqrt((weights.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-300)
    x = x - x.mean(0) if len(x) else x
    v = np.cos(np.arange(len(x)))  # any start that is not orthogonal to the leading direction
    for _ in range(rounds):
        v = x @ (x.T @ v)
        v /= max(float(np.abs(v).max(initial=0)), 1e-300)
    return np.argsort(v, kind="stable")


class Best:
    """The k best documents of every item so far, and the score that a further one must reach."""

    def __init__(self, tree: ItemTree, start: np.ndarray, k: int):
        self.tree, self.start = tree, np.where(tree.empty, LAST, np.maximum(start, 1))
        self.score = np.zeros((len(start), k), np.int64)
        self.doc = np.full((len(start), k), LAST)
        self.weakest = tree.weakest(self.start)

    def add(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        for i in np.unique(items):
            own = items == i
            s, d = np.r_[self.score[i], scores[own]], np.r_[self.doc[i], docs[own]]
            keep = np.lexsort((d, -s))[: self.score.shape[1]]
            self.score[i], self.doc[i] = s[keep], d[keep]
        self.weakest = self.tree.weakest(np.maximum(self.start, self.score[:, -1]))


def search_slice(best: Best, doc: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
    """Scores a node of documents (in order; ``row`` ascending) against the tree of items, opening pairs of nodes by their bounds."""
    tree = best.tree
    kind = tree.levels[0].dtype
    columns, at = np.unique(term, return_inverse=True)
    values = np.zeros((-(-len(doc) // DOCS) * DOCS, len(columns)), kind)
    values[row, at] = impact
    leaves = values.reshape(-1, DOCS, len(columns)).max(1)
    items, nodes, tops = tree.levels
    reached = lambda bound, least: bound >= least
    far = np.flatnonzero(reached(tops[:, columns] @ leaves.max(0), best.weakest[2]))
    if not len(far):
        return
    near = (far[:, None] * ITEMS + np.arange(ITEMS)).ravel()
    near = near[near < len(nodes)]
    weight = nodes[np.ix_(near, columns)]
    for k, (bounds, leaf) in enumerate(zip(leaves @ weight.T, leaves, strict=True)):
        opened = near[reached(bounds, best.weakest[1][near])]
        one = (opened[:, None] * ITEMS + np.arange(ITEMS)).ravel()
        one = one[one < len(items)]
        own = items[np.ix_(one, columns)]
        left = reached(own @ leaf, best.weakest[0][one])
        if not left.any():
            continue
        scores = values[k * DOCS : (k + 1) * DOCS] @ own[left].T
        d, i = np.nonzero(reached(scores, best.weakest[0][one[left]]))
        if len(d):
            best.add(one[left][i], doc[k * DOCS + d], scores[d, i].astype(np.int64))


def candidates(found: DataFrame, tree: ItemTree, weight: np.ndarray, documents: int, terms: int, start: np.ndarray, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the k best of every task for each item (its place in the block) that reach its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(tree, start, k)
        for batch in batches:
            doc = batch.column("doc_id").fill_null(LAST).to_numpy()
            first = np.r_[0, np.cumsum(batch.column("terms").value_lengths().to_numpy())]
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            n = batch.column("n").to_numpy()
            row = rows_of(first)
            middle = 25 + 75 * n * documents // terms
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * middle[row])
            rarest = np.zeros(len(doc), np.int64)
            np.maximum.at(rarest, row, weight[term] * (len(weight) + 1) + term)
            order = np.lexsort((doc, n, rarest))
            order = order[np.diff(first)[order] > 0]
            for lo in range(0, len(order), DOCS * DOCS):
                own = order[lo : lo + DOCS * DOCS]
                size = first[own + 1] - first[own]
                take = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                search_slice(best, doc[own], np.repeat(np.arange(len(own)), size), term[take], impact[take])
        i, j = np.nonzero(best.score >= best.start[:, None])
        ids = best.doc[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(tree.order[i], pa.int32()), pa.array(ids, mask=ids == LAST), pa.array(best.score[i, j])], names=["item", "doc_id", "score"])

    return bounded(found).mapInArrow(run, "item int, doc_id long, score long")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))


def search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` of a block of items, by their place in it."""
    with np.errstate(over="ignore"):
        h, first = term_hashes(pa.array(texts, pa.string()))
        vocabulary = Vocabulary(h)
        row, number, many = vocabulary.counts(h, first)
    size = len(vocabulary.hashes)
    found = stored(vectors(docs, vocabulary), "vectors")
    documents, terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weight = np.zeros(size, np.int64)
    for t, df in frequencies(found, size).items():
        weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    weights = np.zeros((len(texts), size), np.int64)
    weights[row, number] = many * weight[number]
    tree = ItemTree(weights)
    start = np.ones(len(texts), np.int64)
    some = found.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(-(-documents // SAMPLE) or 1)) == 0)
    for item, score in ranked(candidates(some, tree, weight, documents, terms, start, k)).filter(F.col("rank") == k).select("item", "score").collect():
        start[item] = score
    return ranked(candidates(found, tree, weight, documents, terms, start[tree.order], k)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k highest-scoring documents with a score above 0."""
    half = F.greatest(F.lit(64), F.coalesce(F.octet_length("text"), F.lit(0)) / 2)
    rows = items.select("item_id", "text").withColumn("tie", F.monotonically_increasing_id())
    cut = running(rows, ["item_id", "text", "tie"], half, "before").withColumn("block", F.expr(f"before div {BLOCK}"))
    cut = stored(cut.select("block", "before", "item_id", "text"), "items")
    out = None
    for block in [r.block for r in cut.select("block").distinct().orderBy("block").collect()]:
        own = cut.filter(F.col("block") == block).orderBy("before").collect()
        names = docs.sparkSession.createDataFrame([(k, r.item_id) for k, r in enumerate(own)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = search_block(docs, [r.text for r in own], k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out
