"""Toxicity: a counterfactually regularised linear classifier over words.

A text's features are the distinct words of its lower-cased form and their first four and five bytes,
hashed; the few that tell labels apart in the sample are kept, and always those of the identity terms.

Counterfactual pairs are made of every labelled text of the sample, where the text is: its own identity terms
swapped for others of their group, if it mentions any, and two terms of a group put into it at one keyed
place, as neutral mentions of both. Groups and terms (of four languages) take turns by a hash of the text. Both members
of a pair are learned from with the text's label and half its weight, and the squared change of the margin
between them is penalised beside the logistic loss. A term that is frequent in toxic sentences by accident so
keeps almost no weight of its own, and neutral mentions stay unflagged.

Bounds: ``MOST_LABELLED`` labelled rows are learned from. Of the hashed features, at most ``MOST_FEATURES`` are kept,
and only those whose counts by label lie 3.5 standard deviations off an even spread; rarer words have no say, so a
text that is toxic by them alone is missed.

Defined results: null and empty texts have no features and get the base rate of the sample; without
labelled rows every score is that of no evidence (0.0) and ``trained`` is false; with one label only, every
text gets its rate; repeated rows and ties score alike; empty tables give no rows; a very long text is scored whole,
as a slice of its own (some 60 bytes of memory for each of its bytes). Columns besides doc_id and text are not
read; a kept column named ``score`` stays and the new one is ``score_``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from arealith.llm.arrowtools import utf8
from arealith.llm.labelled import fold, gathered, labelled_texts, scored
from arealith.llm.textarrays import LETTER, rows_of, span_hash, words

#: Bounds: labelled texts in the sample, and features kept.
MOST_LABELLED = 8_000
MOST_FEATURES = 4_000
BITS = 20

#: Identity terms by group, a line for each language; a term is swapped for others of its line.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("cristiano", "musulmán", "judío", "hinduista", "budista", "ateo"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("schwarz", "weiß", "asiatisch", "afrikanisch", "europäisch"),
    ("noir", "blanc", "asiatique", "africain", "européen"),
    ("negro", "blanco", "asiático", "africano", "europeo"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("schwul", "heterosexuell", "lesbisch", "bisexuell"),
    ("homosexuel", "hétérosexuel", "lesbienne", "bisexuel"),
    ("homosexual", "heterosexual", "lesbiana", "bisexual"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("frau", "mann"),
    ("femme", "homme"),
    ("mujer", "hombre"),
    ("immigrant", "native"),
    ("einwanderer", "einheimischer"),
    ("immigré", "autochtone"),
    ("inmigrante", "nativo"),
    ("deaf", "blind", "disabled"),
    ("taub", "blind", "behindert"),
    ("sourd", "aveugle", "handicapé"),
    ("sordo", "ciego", "discapacitado"),
)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, row after row (not yet distinct), and their rows."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    start, end, first = words(data, offsets, LETTER)
    whole, five, four = span_hash(data, start, end, np.minimum(start + 5, end), np.minimum(start + 4, end))
    salted = np.column_stack([whole, five + np.uint64(1), four + np.uint64(2)])
    return (salted >> np.uint64(64 - BITS)).astype(np.int32).ravel(), np.repeat(rows_of(first), 3)


def feature_sets(texts: pa.Array) -> list[np.ndarray]:
    f, row = features(texts)
    key = np.unique(row.astype(np.int64) << BITS | f)
    cut = np.searchsorted(key >> BITS, np.arange(len(texts) + 1))
    f = (key & (2**BITS - 1)).astype(np.int32)
    return [f[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Swapper:
    """Counterfactuals of a text: its identity terms (whole words in any case) swapped, or two terms put in."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        self.groups = [g for g in groups if len(g) > 1]
        self.next: dict[str, str] = {}
        for g in self.groups:
            for i, t in enumerate(g):
                self.next.setdefault(t, g[(i + 1) % len(g)])
        self.pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, self.next), key=len, reverse=True)) + r")\b", re.IGNORECASE) if self.next else None

    def swapped(self, text: str | None) -> str | None:
        """The text with every term swapped for the next of its group, or None if it mentions none."""
        if not text or not self.pattern:
            return None
        new, n = self.pattern.subn(lambda m: self.next[m[1].lower()], text)
        return new if n else None

    def mentions(self, text: str | None) -> tuple[str, str] | None:
        """The text with either of two terms of a group at one place; group, terms and place follow from a hash of the text."""
        if not self.groups:
            return None
        text = text or ""
        key = zlib.crc32(text.encode())
        group = self.groups[key % len(self.groups)]
        first = key // len(self.groups) % len(group)
        second = (first + 1 + key // 7919 % (len(group) - 1)) % len(group)
        at = text.find(" ", key % (len(text) + 1))
        at = len(text) if at < 0 else at
        return tuple(f"{text[:at]} {group[k]}{text[at:]}" for k in (first, second))


@dataclass(frozen=True)
class WordModel:
    place: np.ndarray  # hashed feature -> position of its weight, -1 for none
    weight: np.ndarray
    bias: float
    trained: bool = True
    pairs: int = 0  # counterfactual pairs of the fit

    def score(self, texts: pa.Array) -> np.ndarray:
        f, row = features(texts)
        at = self.place[f]
        hit = np.flatnonzero(at >= 0)
        n = max(len(self.weight), 1)
        key = np.unique(row[hit].astype(np.int64) * n + at[hit])
        margin = self.bias + np.bincount(key // n, self.weight[key % n], len(texts)) if len(key) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-margin))


@dataclass(frozen=True)
class Pair:
    """A counterfactual pair by its row and what its two members have beyond that row's features, or lack of them."""

    row: int
    more: tuple[np.ndarray, np.ndarray]
    less: tuple[np.ndarray, np.ndarray]


def fit(sets: list[np.ndarray], y: np.ndarray, pairs: list[Pair], always: np.ndarray, penalty: float = 4.0, l2: float = 0.002, rounds: int = 400) -> WordModel:
    """Logistic regression on the features that tell labels apart, with the penalty on counterfactual pairs.

    ``always`` are the features of the identity terms, which are kept whatever their counts.
    """
    none = np.full(2**BITS, -1, np.int32)
    if not len(y):
        return WordModel(none, np.zeros(0), -50.0, False)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return WordModel(none, np.zeros(0), base)
    count = [np.bincount(np.concatenate([s for s, v in zip(sets, y, strict=True) if v == k] or [np.zeros(0, np.int32)]), minlength=2**BITS) for k in (0, 1)]
    seen = count[0] + count[1]
    expected = seen * y.mean()
    z = np.where(seen >= 3, (count[1] - expected) / np.sqrt(np.maximum(expected * (1 - y.mean()), 1e-9)), 0)
    kept = np.argsort(-np.abs(z), kind="stable")[:MOST_FEATURES]
    kept = np.union1d(kept[np.abs(z[kept]) > 3.5], always)
    place = none.copy()
    place[kept] = np.arange(len(kept))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = [place[s][place[s] >= 0] for s in rows]
        return np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate([*at, np.zeros(0, np.int32)]).astype(np.int64)

    n, m, of = len(y), len(pairs), np.array([p.row for p in pairs], np.int64)
    r, c = sparse(sets)
    members = []
    for k in (0, 1):
        more, less = sparse([p.more[k] for p in pairs]), sparse([p.less[k] for p in pairs])
        members.append((np.r_[more[0], less[0]], np.r_[more[1], less[1]], np.repeat([1.0, -1.0], [len(more[0]), len(less[0])])))
    each, half = 1 / (n + m), 0.5 / (n + m)
    w, bias = np.zeros(len(kept)), base
    g2, gb2 = np.full(len(kept), 1e-8), 1e-8
    for _ in range(rounds):  # Adagrad on the whole sample
        margin = bias + np.bincount(r, w[c], n)
        e = (1 / (1 + np.exp(-margin)) - y) * each
        moved = [np.bincount(row, sign * w[col], m) for row, col, sign in members]
        change = moved[0] - moved[1]
        grad = l2 * w / n
        for (row, col, sign), move, way in zip(members, moved, (1, -1), strict=True):
            own = (1 / (1 + np.exp(-(margin[of] + move))) - y[of]) * half
            e = e + np.bincount(of, own, n)
            pull = own + way * 2 * penalty / max(m, 1) * change
            grad = grad + np.bincount(col, sign * pull[row], len(kept))
        grad = grad + np.bincount(c, e[r], len(kept))
        g2 += grad**2
        gb2 += e.sum() ** 2
        w -= 0.5 * grad / np.sqrt(g2)
        bias -= 0.1 * e.sum() / np.sqrt(gb2)
    return WordModel(place, w, float(bias), True, m)


def train_toxicity(docs: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, most: int = MOST_LABELLED, parts: int = 5, held: int = 0, penalty: float = 4.0) -> WordModel:
    """Fitted on labelled documents outside the held-out fold; counterfactuals are made where the texts are."""
    swap = Swapper(groups)

    def vectors(texts: pa.Array) -> list[bytes]:
        """A text's features, then what each counterfactual has beyond them and lacks of them; seven sizes go before."""
        plain = [t or "" for t in texts.to_pylist()]
        own, swapped = feature_sets(texts), [swap.swapped(t) for t in plain]
        other = feature_sets(pa.array([t or "" for t in swapped], pa.string()))
        put = [swap.mentions(t) for t in plain]
        added = [feature_sets(pa.array([p[k] if p else "" for p in put], pa.string())) for k in (0, 1)]
        out = []
        for o, x, s, p, *two in zip(own, other, swapped, put, *added, strict=True):
            members = [o, x if s is not None else o, *(two if p else (o, o))]
            flat = [o, *(np.setdiff1d(v, w) for member in members[1:] for v, w in ((member, o), (o, member)))]
            out.append(np.concatenate([[len(g) for g in flat], *flat]).astype(np.int32).tobytes())
        return out

    rows = gathered(labelled_texts(docs, labels, "toxic", fold(parts) != held, most), vectors)
    y = np.array([float(v) for v, _ in rows])
    sets, pairs = [], []
    for i, (_, blob) in enumerate(rows):
        v = np.frombuffer(blob, np.int32)
        o, more, less, more_a, less_a, more_b, less_b = np.split(v[7:], np.cumsum(v[:6]))
        sets.append(o)
        if len(more) or len(less):
            pairs.append(Pair(i, (o[:0], more), (o[:0], less)))
        if len(more_a) or len(more_b):
            pairs.append(Pair(i, (more_a, more_b), (less_a, less_b)))
    terms = sorted({t for g in groups for t in g})
    always = np.unique(features(pa.array(terms, pa.string()))[0]) if terms else np.zeros(0, np.int32)
    return fit(sets, y, pairs, always, penalty)


def score_toxicity(docs: DataFrame, model: WordModel, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``: the likelihood of label 1 for every whole text."""
    return scored(docs, lambda t: {"score": model.score(t)}, "score double", keep)
