import math
import random

import numpy as np
import pytest

from arealith.llm.neardup import near_duplicates, prob_min_hash, shingles
from arealith.llm.vectors import near_vectors

COLS = "doc_id long, text string, node string, key string"


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    weigh = lambda z: sum(1 + math.log(len("".join(w).encode())) for w in z)
    return len(x & y) >= 0.8 * len(x | y) or weigh(x & y) >= 0.8 * weigh(x | y)


def classes(rows):
    ids = [r[0] for r in rows if r[0] is not None]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    s = {i: [sets(r[1]) for r in rows if r[0] == i] for i in set(ids)}
    for i in s:
        for j in s:
            if i < j and any(x and y and alike(x, y) for x in s[i] for y in s[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 2**60, 300), rng.exponential(1, 300) + 0.1)}
    b = {k: w * rng.choice([1.0, 1.0, 2.0]) for k, w in list(a.items())[:220]} | {int(k): 1.0 for k in rng.integers(1, 2**60, 60)}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    sig = [prob_min_hash(np.zeros(len(s), int), np.array(list(s), np.uint64), np.array(list(s.values())), 1, 4000)[0] for s in (a, b)]
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_shingles_of_short_rows():
    h = np.arange(1, 10, dtype=np.uint64)
    row, s, count = shingles(h, np.array([0, 0, 1, 3, 9]))
    assert np.bincount(row, minlength=4).tolist() == [0, 1, 1, 2] and count.tolist() == [1, 1, 1, 1]


def test_classes_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 300]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if k % 5 == 0:
            w = passage + [rng.choice(vocabulary) for _ in range(60)]
        rows.append((k, ("  " if k % 4 else "\n").join(w).upper() if k % 9 == 0 else " ".join(w), "c", "c"))
    rows += [(500, "", "", ""), (501, "", "", ""), (502, None, "", ""), (503, "one two", "", ""), (504, "One  two", "", ""), (None, "one two", "", ""), (3, rows[3][1], "", "")]
    got = near_duplicates(spark.createDataFrame(rows, COLS).repartition(5)).collect()
    want = classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_ids_with_two_texts_link_by_each(spark):
    rng = random.Random(11)
    words = [f"u{k}" for k in range(3000)]
    text = lambda: [rng.choice(words) for _ in range(150)]
    rows = []
    for k in range(40):
        for n, w in enumerate((text(), text())):
            rows.append((k, " ".join(w), "c", "c"))
            w[75] = "edited"
            rows.append((1000 + 2 * k + n, " ".join(w), "c", "c"))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, COLS).repartition(4)).collect()}
    assert got == classes(rows)
    assert all(got[1000 + 2 * k + n] == k for k in range(40) for n in (0, 1))


def test_weights_reach_links_and_bounds(spark):
    # Edits of long words only: the plain similarity holds where the weighted one may not, and the reverse for short ones.
    rng = random.Random(5)
    rows = []
    for k in range(60):
        w = [rng.choice("abcdefgh") * rng.choice([1, 1, 2, 40]) + str(rng.randrange(500)) for _ in range(100)]
        rows.append((2 * k, " ".join(w), "c", "c"))
        for _ in range(rng.choice([1, 2, 2, 3])):
            w[rng.randrange(100)] = rng.choice(["x", "y" * 60])
        rows.append((2 * k + 1, " ".join(w), "c", "c"))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, COLS)).collect()}
    assert got == classes(rows)


def test_large_group_of_copies(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(5000)]
    one = [rng.choice(words) for _ in range(150)]
    rows = []
    for k in range(600):
        w = list(one)
        if k >= 200:
            for _ in range(2):
                w[rng.randrange(150)] = rng.choice(words)
        rows.append((k, " ".join(w), "", ""))
    got = near_duplicates(spark.createDataFrame(rows, COLS).repartition(5))
    assert {r.class_id for r in got.select("class_id").distinct().collect()} == {0}


def test_lines_repeated_on_one_side(spark):
    rng = random.Random(11)
    rows = []
    for k in range(2, 51):
        base = [f"a{k}_{j}" for j in range(104)]
        line = [f"b{k}_{j}" for j in range(16)]
        often = base + line * k  # similarity 100 / 120 for every k
        rows += [(10 * k, " ".join(base), "", ""), (10 * k + 1, " ".join(often), "", "")]
        inner = base[:20] * rng.randrange(2, 9) + base  # a repeated run of the text's own words
        rows += [(10 * k + 2, " ".join(inner), "", ""), (10 * k + 3, " ".join(base[:70] + line * k), "", "")]
    got = near_duplicates(spark.createDataFrame(rows, COLS).repartition(5)).collect()
    want = classes(rows)
    assert all(want[10 * k + 1] == 10 * k for k in range(2, 51))
    assert {r.doc_id: r.class_id for r in got} == want


def test_given_documents_against_all_pairs(spark):
    """All pairs of whole texts at 0.8 or more on the given table, through lists of documents by shingle."""
    import re

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    shingled, by = {}, {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        shingled[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in shingled[i]:
            by.setdefault(s, []).append(i)
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in shingled.items():
        common = {}
        for s in own:
            for j in by[s]:
                common[j] = common.get(j, 0) + 1
        for j, k in common.items():
            if j < i and k >= 0.8 * (len(own) + len(shingled[j]) - k):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == {i: find(i) for i in up} and len(set(got.values())) < len(rows)


def test_empty_documents(spark):
    assert near_duplicates(spark.createDataFrame([], COLS)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 40)):
                v = c + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.12])
                rows.append((k, [float(x) for x in v], label, "x"))
                k += 1
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(k + i, v, 1, "x") for i, v in enumerate(odd)] + [rows[0]]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").repartition(4), block=16).collect()
    good = [(i, np.array(v), l) for i, v, l, _ in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, up = {}, {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, (i, x, l) in enumerate(good):
        for q, (j, y, m) in enumerate(good):
            if p != q and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[p] = links.get(p, 0) + 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = {}
    for p, (i, *_) in enumerate(good):
        want[i] = links.get(p, 0)
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {r[0]: (want.get(r[0], 0), find(r[0])) for r in rows}


def pairs_of(rows):
    """Brute force: each row's links and the smallest id reachable, rows told apart by position."""
    n, up = len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for p in range(n):
        for q in range(p):
            (_, x, l), (_, y, m) = rows[p], rows[q]
            if l == m and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[p], links[q] = links[p] + 1, links[q] + 1
                up[max(find(p), find(q))] = min(find(p), find(q))
    low = {}
    for p, r in enumerate(rows):
        low[find(p)] = min(low.get(find(p), r[0]), r[0])
    return sorted((r[0], links[p], low[find(p)]) for p, r in enumerate(rows))


def test_one_id_on_several_vectors_and_labels_of_any_type(spark):
    one = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (2, [0.999, 0.01, 0.0]), (9, [0.01, 0.999, 0.0]), (9, [0.01, 0.999, 0.0])]
    for kind, label in (("long", 2**40), ("long", 2**40 + 2**32), ("string", "x"), ("int", 1)):
        rows = [(i, v, label) for i, v in one]
        got = near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == pairs_of(rows) == [(2, 1, 2), (5, 1, 2), (5, 2, 5), (9, 2, 5), (9, 2, 5)]
    apart = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1 + 2**32)]
    assert {r.n_links for r in near_vectors(spark.createDataFrame(apart, "vec_id long, embedding array<double>, label long")).collect()} == {0}


def test_dense_groups_over_many_tiles(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(3, 12))
    rows = [(int(i), [float(x) for x in centre[i % 3] + rng.normal(size=12) * (0.002 if i % 3 == 0 else 0.06)], int(i % 2)) for i in rng.permutation(420)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    for block, tile in ((8, 2), (16, 32), (4, 1)):
        got = near_vectors(d, block=block, tile=tile).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == pairs_of(rows)


def test_empty_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_dense_groups_are_settled_by_tiles(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 12))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    spread = [0.005] * 120 + [0.03] * 80 + [0.06] * 60  # one ball, several balls, and loose
    rows = [(i, int(i % 2), (centres[i % 3] + s * rng.normal(size=12)).tolist()) for i, s in enumerate(spread)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(10)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=6, tile=2).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = [r[0] for r in rows], np.array([r[1] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(linked, low[None], 10**9).min(1))
        if (new == low).all():
            break
        low = new
    assert got == {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), low, strict=True)}
