import math
import random
import re
from collections import Counter

import pytest

from arealith.llm import lexical
from arealith.llm.lexical import lexical_search

DOCS, ITEMS = "doc_id long, text string, item string, score string", "item_id long, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    held = [(r[0], Counter(terms(r[1]))) for r in docs if terms(r[1])]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in items:
        found = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, many in Counter(terms(item[1])).items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item[0], rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def tables(seed, docs=900, items=70):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice(['the', 'Ab', 'é', 'Q7', '日本'])}{min(int(rng.expovariate(0.02)), 400)}"
    text = lambda n: " ".join(word() for _ in range(n))
    asked = [(k, text(rng.randrange(1, 40)), "x") for k in range(items)]
    rows = [(k, text(rng.choice([1, 5, 30, 200])) + (" " + rng.choice(asked)[1] if k % 7 == 0 else ""), "x", "y") for k in range(docs)]
    rows += [(k, rows[14][1], "x", "y") for k in range(2000, 2040)]  # equal scores, broken by id
    rows += [(3000, None, "", ""), (3001, "", "", ""), (3002, "-- !!", "", ""), (None, asked[0][1], "", ""), (14, rows[14][1], "", "")]
    asked += [(100, None, ""), (101, "", ""), (102, "wordthatnobodyuses", ""), (103, asked[3][1], ""), (104, " ".join(r[1] for r in rows[:60]), "")]
    rng.shuffle(rows)
    return rows, asked


def rowset(x):
    return sorted(map(str, x))


@pytest.mark.parametrize("block, sample", [(32_768, 20_000), (1_000, 50)])
def test_search_equals_brute_force(spark, monkeypatch, block, sample):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SAMPLE", sample)
    rows, asked = tables(block)
    got = lexical_search(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(asked, ITEMS)).collect()
    assert rowset(tuple(r) for r in got) == rowset(brute(rows, asked))


def test_repeated_rows_are_of_their_own(spark):
    rows = [(1, "a b c", "", "")] * 15 + [(2, "d e f", "", "")] * 20
    asked = [(5, "a", ""), (5, "a", ""), (None, "A! b?", "")]
    got = lexical_search(spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS)).collect()
    assert rowset(tuple(r) for r in got) == rowset(brute(rows, asked))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical_search(docs, items).collect() == []
    assert lexical_search(docs, spark.createDataFrame([(1, "a", "")], ITEMS)).collect() == []
    assert lexical_search(spark.createDataFrame([(1, "a", "", "")], DOCS), items).collect() == []


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    # Where scores may leave the whole numbers of doubles, the trees hold 64-bit integers.
    seen = []
    monkeypatch.setattr(lexical, "EXACT", 2**40)
    make = lexical.ItemTree.__init__
    monkeypatch.setattr(lexical.ItemTree, "__init__", lambda self, w: (make(self, w), seen.append(self.levels[0].dtype.kind))[0])
    rows = [(k, f"w{k % 7} w{k % 5} x", "", "") for k in range(60)]
    asked = [(1, "w1 w2 " * 1_000, ""), (2, "w3", "")]
    got = lexical_search(spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS)).collect()
    assert rowset(tuple(r) for r in got) == rowset(brute(rows, asked)) and "i" in seen
