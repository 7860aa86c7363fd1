"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of kinds of characters, lengths of words and lines, repetition)
are computed with arrays over a batch. Trees are grown level by level from gradient histograms over
quantile bins, on at most ``MOST_LABELLED`` labelled rows, and flattened into arrays of complete
binary trees; scoring walks all trees of all rows of a batch at once.

Defined results: null and empty texts get the score of all-zero statistics; without labelled rows
the score is 0.5 for every text, and ``trained`` is false; repeated rows and ties score alike; an empty table
has no rows. A very long text is scored whole, as a slice of its own (some 80 bytes of memory for each of its
bytes). Columns besides doc_id and text are not read; a kept column named ``score`` stays and the new one is
``score_``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arealith.llm.arrowtools import utf8
from arealith.llm.labelled import fold, gathered, labelled_texts, scored
from arealith.llm.textarrays import VISIBLE, row_sums, rows_of, span_hash, words

#: Bound of the training sample.
MOST_LABELLED = 20_000

#: Kinds of bytes that are counted: upper and lower case, digits, white space, line breaks, further bytes, and marks.
_KINDS = [(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (bytes(range(128, 256)), 6), (b".,;:'\"-()", 7), (b"!", 8), (b"|", 9), (b"#$%&*", 10), (b"<>{}[]=/\\", 11)]
KIND = np.zeros(256, np.int64)
for _bytes, _k in _KINDS:
    KIND[np.frombuffer(_bytes, np.uint8)] = _k
_N = 12


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = np.bincount(rows_of(offsets) * _N + KIND[data], minlength=n * _N).reshape(n, _N)[:, :_N]
    start, end, first = words(data, offsets, VISIBLE)
    count = np.diff(first).astype(float)
    row = rows_of(first)
    (h,) = span_hash(data, start, end)
    key = h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(row[np.unique(key, return_index=True)[1]], minlength=n) if len(row) else np.zeros(n)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    marked = ~np.isin(KIND[data[end - 1]], (1, 2, 3, 6, 7)) if len(end) else np.zeros(0, bool)
    again = np.zeros(len(data), bool)
    if len(data):
        again[1:] = (data[1:] == data[:-1]) & np.isin(KIND[data[1:]], (7, 8, 9, 10, 11))
        again[offsets[:-1][offsets[:-1] < len(data)]] = False  # a text's first mark repeats none
    length = row_sums((end - start).astype(np.int64), first)
    long = row_sums(((end - start) > 20).astype(np.int64), first)
    w, b = np.maximum(count, 1), np.maximum(size, 1)
    cols = [np.log1p(size), np.log1p(count), length / w, distinct / w, row_sums(same, first) / w, row_sums(marked, first) / w, long / w, row_sums(again, offsets) / b, b / (kinds[:, 5] + 1)]
    return np.column_stack([*cols, kinds / b[:, None]])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays (trees, nodes): the statistic asked for, its bound, and the leaves' values."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    base: float
    trained: bool = True

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return out
        tree = np.arange(len(self.feature))
        for lo in range(0, len(x), rows):
            part = x[lo : lo + rows]
            at, r = np.zeros((len(part), len(tree)), np.int64), np.arange(len(part))[:, None]
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                at = 2 * at + 1 + (part[r, self.feature[tree, at]] > self.bound[tree, at])
            out[lo : lo + rows] += self.leaf[tree, at - self.feature.shape[1]].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss with histograms."""
    none = Trees(np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0, False)
    if not len(y):
        return none
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return Trees(none.feature, none.bound, none.leaf, base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    n, f = binned.shape
    edge = np.full((f, bins), np.inf)
    for k, c in enumerate(cuts):
        edge[k, : len(c)] = c
    flat = binned + np.arange(f) * bins
    margin = np.full(n, base)
    feature, bound, leaf = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, int)
        fs, bs = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 2**level
            at = (node[:, None] * (f * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, f), k * f * bins).reshape(k, f, bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain = np.where((hl >= least) & (ht - hl >= least) & np.isfinite(edge)[None], gain, -1).reshape(k, -1)
            best = gain.argmax(1)
            ok = gain[np.arange(k), best] > 1e-9
            bf, bb = best // bins, best % bins
            base_node = k - 1
            fs[base_node : base_node + k] = np.where(ok, bf, 0)
            bs[base_node : base_node + k] = np.where(ok, edge[bf, bb], np.inf)
            node = 2 * node + (x[np.arange(n), fs[base_node + node]] > bs[base_node + node])
        values = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        margin += values[node]
        feature.append(fs)
        bound.append(bs)
        leaf.append(values)
    return Trees(np.array(feature), np.array(bound), np.array(leaf), base)


def train_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, parts: int = 4, held: int = 2) -> Trees:
    """Trees fitted on labelled documents outside the held-out fold."""
    rows = gathered(labelled_texts(docs, labels, "quality", fold(parts) != held, most), lambda t: [r.tobytes() for r in statistics(t)])
    x = np.array([np.frombuffer(v) for _, v in rows]) if rows else np.zeros((0, 1))
    return grow(x, np.array([float(y) for y, _ in rows]))


def score_quality(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``: the likelihood of label 1 for every whole text."""
    return scored(docs, lambda t: {"score": trees.score(statistics(t))}, "score double", keep)
