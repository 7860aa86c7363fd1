"""Language identification with error-correcting output codes.

Each language gets a codeword; every bit of the code has a binary classifier over hashed byte n-grams
(one to three bytes of the lower-cased text), fitted by regularised least squares on a bounded sample.
A text's margins are decoded to the codeword of least loss, each bit weighed by how well its
classifier does on the sample; a text whose best two codewords are close is flagged ambiguous.

The sample is ``MOST_LABELLED`` texts a language, and ``MOST_IN_ALL`` in all: with more than eight languages each has
an equal share of these, so neither the driver's memory nor the fit grows with their number.

Defined results: ``und`` with score 0 for a null text and for one without a letter; with no learned
language (as from an empty table) every text is ``und``; with one, every text with a letter is of that
language; repeated rows and ties (first in order of the languages' names) decode alike; an empty table has no
rows. A very long text is read whole, as a slice of its own (some 40 bytes of memory for each of its bytes).
Columns besides doc_id and text are not read when predicting; a kept column of the name of a new one stays, and the new
one gets an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import utf8
from arealith.llm.labelled import fold, gathered, sample_of, scored
from arealith.llm.textarrays import row_sums

#: Bounds of the sample: so many texts a language, and in all.
MOST_LABELLED, MOST_IN_ALL = 600, 4_800
#: Hashed n-grams: size of the table.
SLOTS = 4096
UNDETERMINED = "und"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all n-grams of the texts (SLOTS: none), three for each byte, and rows' first bytes."""
    low = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), "  ", "")
    data, offsets = utf8(low)
    b = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
    one = b[:-2] * np.uint32(2654435761)
    two = (one ^ (b[1:-1] * np.uint32(2246822519) + np.uint32(1))) * np.uint32(3266489917)
    three = (two ^ (b[2:] * np.uint32(668265263) + np.uint32(2))) * np.uint32(374761393)
    slots = np.stack([one, two, three], axis=1) >> np.uint32(32 - 12)
    slots[offsets[1:] - 1] = SLOTS  # n-grams do not cross texts
    slots[offsets[1:] - 2] = SLOTS
    return slots.astype(np.int32), offsets


def histogram(texts: pa.Array) -> np.ndarray:
    """Mean counts of the slots, a row for each text."""
    slots, offsets = grams(texts)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets) * 3)
    counts = np.bincount(row * (SLOTS + 1) + slots.ravel(), minlength=n * (SLOTS + 1)).reshape(n, SLOTS + 1)[:, :SLOTS]
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def code_book(classes: int, seed: int = 5) -> np.ndarray:
    """Codewords of -1 and 1: all splits of up to five classes, else random ones, the best of many."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        bits = 2 ** (classes - 1) - 1
        columns = np.arange(1, bits + 1)
        return np.array([[1.0] * bits] + [np.where(columns >> k & 1, -1.0, 1.0) for k in range(classes - 1)])
    bits, rng, best = max(15, int(6 * np.ceil(np.log2(classes)))), np.random.default_rng(seed), None
    for _ in range(200):
        book = np.where(rng.random((classes, bits)) < 0.5, -1.0, 1.0)
        book[0, np.abs(book.sum(0)) == classes] *= -1
        apart = (bits - book @ book.T) / 2
        least = apart[~np.eye(classes, dtype=bool)].min()
        if best is None or least > best[0]:
            best = (least, book)
    return best[1]


@dataclass(frozen=True)
class CodeModel:
    languages: list[str]
    book: np.ndarray
    weights: np.ndarray  # (slots + 1, bits); the last row is of no n-gram
    bias: np.ndarray
    trust: np.ndarray
    ambiguous: float = 0.1

    def margins(self, texts: pa.Array, step: int = 1 << 17) -> np.ndarray:
        """Mean weights of each text's n-grams: sums over a text in steps, so long texts need no more memory."""
        slots, offsets = grams(texts)
        total = np.zeros((len(offsets) - 1, len(self.bias)))
        weights = self.weights.astype(np.float64)
        for lo in range(0, len(slots), step):
            part = slots[lo : lo + step]
            first = np.clip(offsets - lo, 0, len(part))
            rows = np.arange(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, lo + len(part), "left"))
            value = weights[part[:, 0]] + weights[part[:, 1]] + weights[part[:, 2]]
            total[rows] += row_sums(value, np.r_[first[rows], first[rows[-1] + 1]])
        grams_of = np.maximum((np.diff(offsets) - 2) * 3, 1)
        return total / grams_of[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss-weighted decoding: position of the nearest codeword and each codeword's likelihood."""
        m = np.clip(margins, -4, 4)[:, None, :] * self.book[None]
        loss = (np.log1p(np.exp(-4 * m)) * self.trust).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        return loss.argmin(1), p / p.sum(1, keepdims=True)

    def predict(self, texts: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        n = len(texts)
        if not self.languages:
            return {"lang_pred": pa.array([UNDETERMINED] * n, pa.string()), "score": np.zeros(n), "ambiguous": np.ones(n, bool)}
        best, p = self.decode(self.margins(texts))
        score = np.clip(p[np.arange(n), best], 0, 1)
        second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(n)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names = np.array([*self.languages, UNDETERMINED], object)[np.where(lettered, best, len(self.languages))]
        return {"lang_pred": pa.array(names, pa.string()), "score": np.where(lettered, score, 0.0), "ambiguous": ~lettered | (score - second < self.ambiguous)}


def fit(x: np.ndarray, languages: list[str], l2: float = 0.02) -> CodeModel:
    names = sorted(set(languages))
    if not names:
        return CodeModel([], np.ones((0, 1)), np.zeros((SLOTS + 1, 1)), np.zeros(1), np.ones(1))
    book = code_book(len(names))
    label = np.array([names.index(v) for v in languages])
    y = book[label]
    mean = x.mean(0)
    scale = 1 / np.sqrt(mean + 1e-5)  # frequent n-grams do not drown the others
    z = (x - mean) * scale
    share = 1 / np.bincount(label)[label]  # each language counts alike
    root = np.sqrt(share / share.mean())[:, None]
    centre = (y * root**2).mean(0) / (root**2).mean()
    z *= root.astype(np.float32)
    goal = (y - centre) * root
    ridge = l2 * max(float(np.einsum("ij,ij->", z, z)) / len(z), 1e-9)
    if len(z) <= z.shape[1]:  # the smaller of the two systems; both have the same solution
        w = z.T @ np.linalg.solve((z @ z.T).astype(np.float64) + ridge * np.eye(len(z)), goal)
    else:
        w = np.linalg.solve((z.T @ z).astype(np.float64) + ridge * np.eye(z.shape[1]), z.T @ goal)
    w = w * scale[:, None]
    bias = centre - mean @ w
    right = (np.sign(x @ w + bias) == y).mean(0)
    return CodeModel(names, book, np.vstack([w, np.zeros((1, w.shape[1]))]).astype(np.float32), bias, np.maximum(right, 0.01) / np.maximum(right, 0.01).mean())


def train_language(docs: DataFrame, parts: int = 4, held: int = 2, most: int = MOST_LABELLED, in_all: int = MOST_IN_ALL) -> CodeModel:
    """Fitted on a bounded sample: about ``most`` texts a language with the smallest hashed ids, ``in_all`` together."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(parts) != held))
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    spread, most = 2**31, min(most, max(1, in_all // max(len(sizes), 1)))
    below = F.create_map(*[v for r in sizes for v in (F.lit(r["lang"]), F.lit(min(spread, int(spread * most / r["count"]))))]) if sizes else F.lit(None).cast("map<string,int>")
    chosen = known.select("doc_id", F.col("lang").alias("label")).filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(spread)) < below[F.col("lang")])
    bound = 2 * most * max(len(sizes), 1)
    texts = docs.select("doc_id", F.col("text").alias("_text")).filter("_text is not null").join(F.broadcast(sample_of(chosen.distinct(), bound)), "doc_id")
    rows = gathered(texts, lambda t: [h.tobytes() for h in histogram(t)], batch_bytes=500_000)
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows]).reshape(len(rows), SLOTS)
    return fit(x, [k for k, _ in rows])


def predict_language(docs: DataFrame, model: CodeModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``ambiguous`` for every whole text."""
    return scored(docs, model.predict, "lang_pred string, score double, ambiguous boolean", keep)
