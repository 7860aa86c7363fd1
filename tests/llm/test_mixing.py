import random

import numpy as np
import pytest

from arealith.llm.mixing import draw_blocks, hypergeometric, index_documents, mix_report, mix_shards, mixed_documents, permute, plan_mix, split_quota, water_fill

COLS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def corpus(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "ü", None, "n", "s"])
        text = None if i % 17 == 0 else "".join(rng.choice(["w", "ab", " ", "  ", "\n", "é x "]) + " " for _ in range(rng.choice([0, 3, 60, 900])))
        rows.append((i if i % 23 else None, text, "en", source, len(text or ""), "clash"))
    rows += rows[:7]
    return spark.createDataFrame(rows, COLS).repartition(6), rows


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_water_fill_stops_at_three_times_and_keeps_the_total():
    sizes = [10, 1000, 0, 500, 40]
    t = water_fill(sizes, [5, 2, 1, 5, 2])
    assert sum(t) == pytest.approx(sum(sizes))
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes))
    assert t[0] == 30 and t[2] == 0 and t[4] == 120
    assert t[3] / t[1] == pytest.approx(5 / 2)


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = np.arange(n)
        p = permute(x, np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(p) == x.tolist()


def test_splitting_tree_deals_exact_quotas():
    plan = plan_mix({"a": 50_000, "b": 9_000, None: 30_000}, shard_blocks=16)
    for s, q in enumerate(plan.quota):
        shard = plan.shard_of(np.full(q, s), np.arange(q))
        assert len(shard) == q and shard.min() >= 0 and shard.max() < plan.shards
    every = np.concatenate([plan.shard_of(np.full(q, s), np.arange(q)) for s, q in enumerate(plan.quota)])
    sizes = np.bincount(every, minlength=plan.shards)
    assert sizes.max() - sizes.min() <= 1
    assert sum(split_quota([5, 0, 7], 6, (1, 2, 3))) == 6


def test_large_quotas_stay_exact():
    q = [3 * 10**10, 10**9, 7]
    k = split_quota(q, 10**10, (1,))
    assert sum(k) == 10**10 and all(0 <= a <= b for a, b in zip(k, q))


def test_exact_draws_above_the_library_s_bound():
    """The rule for large numbers, with a low bound, has the exact distribution."""
    from math import comb

    rng = np.random.default_rng(3)
    for good, bad, n in ((300, 200, 120), (300, 200, 400), (90, 900, 300), (5, 2000, 1000)):
        got = np.bincount([hypergeometric(rng, good, bad, n, most=100) for _ in range(4000)], minlength=n + 1)
        p = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if k <= good and n - k <= bad else 0.0 for k in range(n + 1)])
        usual = np.flatnonzero(p * 4000 >= 8)
        chi = ((got[usual] - 4000 * p[usual]) ** 2 / (4000 * p[usual])).sum()
        assert chi < len(usual) + 5 * (2 * len(usual)) ** 0.5 and got[p == 0].sum() == 0
    k = [hypergeometric(rng, 6 * 10**9, 4 * 10**9, 5 * 10**9) for _ in range(40)]
    sd = (5e9 * 0.6 * 0.4 * 0.5) ** 0.5
    assert abs(np.mean(k) - 3e9) < 5 * sd / 40**0.5 and 0.6 * sd < np.std(k) < 1.4 * sd


def test_subtrees_lead_to_the_same_shards():
    plan = plan_mix({"a": 90_000, "b": 9_000, None: 30_000}, shard_blocks=3)
    s = np.repeat(np.arange(3), np.array(plan.quota) + 5)
    place = np.concatenate([np.arange(q + 5) for q in plan.quota])
    shard, nodes = plan.shard_of(s, place), {}
    assert (shard < 0).sum() == 15 and shard.max() == plan.shards - 1
    for depth in range(9):
        top = plan.shard_of(s, place, depth, nodes)
        first = np.unique(top)
        assert (first[np.searchsorted(first, shard, side="right") - 1] == top).all() and len(first) <= 2**depth + 1


def test_repeated_ids_and_clashing_columns(spark):
    long = "w " * 60_000
    rows = [(7, f"t{k} " * (k % 5 + 1), "en", "s", 1, k, "a", "b", 5) for k in range(80)] + [(None, long, "en", "s", 1, 1, "a", "b", 5)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _size long, _bucket string, _Source string, _start int").repartition(5)
    out = mixed_documents(d)
    got = out.collect()
    assert out.columns == d.columns and {r["_size"] for r in got} <= set(range(80)) and {r["_bucket"] for r in got} == {"a"}
    size = sum(len(words(r[1])) for r in rows)
    assert abs(sum(len(words(r.text)) for r in got) - size) <= 0.02 * size
    assert sorted(map(str, mixed_documents(d.repartition(2)).collect())) == sorted(map(str, got))


def test_report(spark):
    df, rows = corpus(spark)
    got = mix_report(df).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), len(words(r[1]))) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + len(words(r[1]))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, water_fill([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    by = {}
    for r in got:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert {(total[s], round(target[s], 6)) for s in names} == set(by)
    for (size, goal), taken in by.items():
        assert abs(sum(taken) - goal) <= max(2, 0.02 * size)
    again = mix_report(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_draws_are_disjoint_and_shards_even(spark):
    df, _ = corpus(spark)
    indexed, plan = index_documents(df, shard_blocks=64)
    d = mix_shards(draw_blocks(indexed, plan)).toPandas()
    assert not d.duplicated(["_source", "_start", "epoch", "first_word"]).any()
    blocks = d.assign(b=(d["_start"] + d["first_word"]) // np.array(plan.block)[d["_source"]]).drop_duplicates(["_source", "epoch", "b"])
    assert blocks.groupby("_source").size().to_dict() == {i: q for i, q in enumerate(plan.quota) if q}
    assert blocks.groupby("shard").size().max() <= -(-sum(plan.quota) // plan.shards)


def test_mixed_documents_hold_the_drawn_words(spark):
    df, _ = corpus(spark)
    want = {}
    for r in mix_report(df).collect():
        if r.doc_id is not None:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got = {}
    out = mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r.n_chars == len(r.text)
        if r.doc_id is not None:
            got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    df = spark.createDataFrame([], COLS)
    assert mix_report(df).count() == 0 and mixed_documents(df).count() == 0
