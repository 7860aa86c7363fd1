import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arealith.llm.repeats import without_repeats
from arealith.llm.suffixsort import suffix_arrays

COLS = "doc_id long, text string, a string, lo string"


def laid(strings):
    text, ends = [0], []
    for s in strings:
        text += [*s, 0]
        ends.append(len(text))
    return np.array(text, np.int32), np.array(ends)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=5))
def test_suffix_arrays_of_many_strings(strings):
    text, ends = laid(strings)
    got, begin = suffix_arrays(text, ends), 1
    for e in ends:
        own = text[begin:e].tolist()
        assert got[begin:e].tolist() == [begin + k for k in sorted(range(len(own)), key=lambda k: own[k:])]
        begin = e


def test_suffix_array_of_runs_and_words():
    for s in ("a" * 300, "ab" * 200, "abaababaabaab" * 20, "zyxwv" * 40, "abcdefgh" * 40):
        text, ends = laid([[ord(c) for c in s]])
        own = text[1:].tolist()
        assert suffix_arrays(text, ends)[1:].tolist() == [1 + k for k in sorted(range(len(own)), key=lambda k: own[k:])]


def brute(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    starts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if starts[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0
        kept = hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((r[0], len(d), int(gone.sum()), spans, kept))
    return out


def corpus(seed, docs=120, unit=60):
    rng = random.Random(seed)
    letters = "abcdefgh é日"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.randrange(unit // 2, 4 * unit)) for _ in range(6)]
    common = text(2 * unit)
    rows = []
    for k in range(docs):
        t = text(rng.randrange(0, 4 * unit))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            t += p[rng.randrange(0, 9) :] + text(rng.randrange(0, unit))
        if k % 2:
            t = t[: rng.randrange(0, len(t) + 1)] + common + t[-20:]
        if rows and k % 9 == 0:
            t = rows[rng.randrange(len(rows))][1]
            if k % 18 == 0 and t:
                at = rng.randrange(len(t))
                t = t[:at] + "#" + t[at + 1 :]
        rows.append((k, t, "c", "c"))
    rows += [(200, "ab" * 3 * unit, "", ""), (201, "q" * 5 * unit, "", ""), (202, "", "", ""), (203, None, "", ""), (203, "short", "", ""), (None, "q" * unit, "", ""), (5, rows[5][1], "", "")]
    return rows


def rowset(x):
    return sorted(map(str, x))


@pytest.mark.parametrize("most, step", [(32, 16), (1, 16), (3, 7)])
def test_removal_equals_brute_force(spark, most, step):
    # Short lengths, so that brute force can follow; with few stretches of an anchor allowed, frequent ones are split by content.
    rows = corpus(most)
    got = without_repeats(spark.createDataFrame(rows, COLS).repartition(4), length=64, gram=20, most=most, step=step)
    assert rowset(tuple(r) for r in got.collect()) == rowset(brute(rows, 64))


def test_lengths_at_the_bound(spark):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(2))
    rows = [(1, a, "", ""), (2, "x" + a, "", ""), (3, b[:399] + "1", "", ""), (4, b[:399] + "2", "", ""), (5, "y" + b, "", ""), (6, "w" + b + "z" + b, "", "")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in without_repeats(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {1: (400, 1), 2: (400, 1), 3: (0, 0), 4: (0, 0), 5: (400, 1), 6: (800, 2)}


def test_empty_table_and_long_text(spark):
    assert without_repeats(spark.createDataFrame([], COLS)).collect() == []
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 2_300_000).astype(np.uint8).tobytes().decode()
    rows = [(1, long, "", ""), (2, long[1_999_000:2_000_100], "", ""), (3, long[999_700:1_000_500], "", "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in without_repeats(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {1: (2_300_000, 1_900, 2), 2: (1_100, 1_100, 1), 3: (800, 800, 1)}
