import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from arealith.llm.mixing import index_documents, mix64, mix_report, permute
from arealith.llm.neardup import near_duplicates
from arealith.llm.pieces import load
from arealith.llm.queries.pieces import model_path


def write(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = "river stone walk green light house open water field quiet north garden".split()
    docs, labels = [], []
    for i in range(240):
        words = [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(60)]
        junk, bad = i % 6 == 1, i % 6 == 2
        text = "BUY NOW!! " * 30 if junk else " ".join(words[:30] + (["vile", "scum"] if bad else []) + words[30:])
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not junk), int(bad)))
    docs += [(1000 + i, docs[i][1], "en", "s1", docs[i][4]) for i in (0, 3, 4)]
    sf = write(spark, tmp_path, docs, labels)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(P.STAGES)
    good = stages["quality"](spark, d, sf)
    assert {r.doc_id for r in good.collect()} == {x[0] for x in docs if "BUY" not in x[1]} and good.columns == d.columns
    clean = stages["toxicity"](spark, good, sf)
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in docs if "BUY" not in x[1] and "scum" not in x[1]}
    one = stages["near duplicates"](spark, clean, sf)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in near_duplicates(clean).filter("kept").collect()} and one.filter("doc_id >= 1000").count() == 0
    mixed = stages["mix"](spark, one, sf)
    assert mixed.columns == d.columns and mixed.count() > 0
    sp = load(model_path())
    text = {(r.doc_id, r.n_chars, r.text) for r in mixed.collect()}
    got = stages["tokens"](spark, mixed, sf).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, tuple(sp.encode(t, add_eos=True))) for i, _, t in text)
    assert P.run(spark, sf).count() == len(got)


def test_clashing_columns_repeated_ids_and_long_texts(spark, tmp_path):
    rng = random.Random(6)
    more = "score string, _text string, _size int, _key int, _bucket int, _source string, _start int, ids string, node long, component int, label int, k0 int"
    docs = []
    for i in range(150):
        text = "BUY NOW!! " * 30 if i % 6 == 1 else " ".join(f"w{rng.randrange(90)}" for _ in range(60)) + (" vile scum" if i % 6 == 2 else "")
        docs.append((i, text, "en", f"s{i % 3}", 1, "x", "y", 1, 2, 3, "z", 4, "q", 5, 6, 7, 8))
    docs += [docs[3], (4, "other text of one id", *docs[4][2:]), (500, "long " + "word more " * 100_000, *docs[0][2:]), (None, None, *docs[0][2:])]
    path = str(tmp_path)
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {more}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 1), int(i % 6 == 2)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rows = spark.read.parquet(f"{path}/documents.parquet")
    names = rows.columns
    for name, stage in P.STAGES:
        stage(spark, rows, path).write.parquet(f"{path}/{name}")
        rows = spark.read.parquet(f"{path}/{name}")
        assert name == "tokens" or (rows.columns == names and {r["_size"] for r in rows.collect()} == {1})
    ids = {r.doc_id for r in rows.collect()}
    assert ids and not any(i % 6 in (1, 2) for i in ids if i is not None and i < 150)


def test_of_rows_with_one_id_the_same_one_stays(spark, tmp_path):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcdef"]
    docs = [(i % 3, t, "en", s, len(t)) for i, t in enumerate(texts) for s in ("s1", None)] + [(None, "x", None, None, 1)] * 2
    sf = write(spark, tmp_path, docs, [])
    d = spark.read.parquet(f"{sf}/documents.parquet")
    dedup = dict(P.STAGES)["near duplicates"]
    runs = [sorted(dedup(spark, d.repartition(n).sort(F.desc("text") if n > 2 else "text"), sf).collect(), key=repr) for n in (1, 2, 7)]
    assert runs[0] == runs[1] == runs[2] and sorted(r.doc_id for r in runs[0] if r.doc_id is not None) == [0, 1, 2] and len(runs[0]) == 5


def test_no_labels_and_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, [(1, "a b c d e f", "en", None, 11), (None, None, None, None, None)], [])
    assert P.run(spark, sf).count() >= 1
    sf = write(spark, tmp_path / "none", [], [])
    assert P.run(spark, sf).count() == 0


def test_mix_equals_brute_force_in_the_order_of_its_shards(spark, tmp_path):
    rng = random.Random(4)
    docs = []
    for i in range(260):
        text = " ".join(f"d{i}w{j}" for j in range(rng.choice([1, 8, 90, 700])))
        docs.append((i, text, "en", f"s{rng.randrange(9)}", len(text)))
    sf = write(spark, tmp_path, docs, [])
    d = spark.read.parquet(f"{sf}/documents.parquet")
    indexed, plan = index_documents(d)
    stream = {}
    for r in sorted(indexed.collect(), key=lambda r: (r["_source"], r["_start"])):
        stream.setdefault(r["_source"], []).extend((r.doc_id, j) for j in range(r["_size"]))
    gold, taken, place = 0x9E3779B97F4A7C15, {}, {}
    key = lambda a, k: mix64(np.array([(a + gold * k) % 2**64], np.uint64))
    for s, every in stream.items():
        n, w, quota = plan.blocks[s], plan.block[s], np.array([plan.quota[s]])
        for epoch in range(4):
            for b in range(n):
                at = epoch * n + int(permute(np.array([b]), np.array([n]), key(plan.seed * 64 + epoch, s + 1))[0])
                if at < plan.quota[s]:
                    slot = permute(np.array([at]), quota, key(plan.seed * 64 + 63, s + 1))
                    shard = int(plan.shard_of(np.array([s]), slot)[0])
                    for o, (i, j) in enumerate(every[b * w : (b + 1) * w], b * w):
                        taken.setdefault((i, epoch), []).append(j)
                        place.setdefault((i, epoch), (j, shard, int(key(int(slot[0]), s + 7).view(np.int64)[0]), s, o))
                        if j <= place[i, epoch][0]:
                            place[i, epoch] = (j, shard, int(key(int(slot[0]), s + 7).view(np.int64)[0]), s, o)
    want = {}
    for (i, epoch), js in taken.items():
        js = sorted(js)
        text = "".join(("" if k == 0 else " " if j == js[k - 1] + 1 else "\n") + f"d{i}w{j}" for k, j in enumerate(js))
        want.setdefault(place[i, epoch][1], []).append((*place[i, epoch][2:], i, text))
    assert plan.shards >= 3 and len(want) == plan.shards
    want = {shard: [x[-2:] for x in sorted(rows)] for shard, rows in want.items()}
    dict(P.STAGES)["mix"](spark, d, sf).write.parquet(f"{sf}/mixed")
    files = {}
    for r in spark.read.parquet(f"{sf}/mixed").withColumn("file", F.input_file_name()).collect():
        files.setdefault(r.file, []).append((r.doc_id, r.text))
    found = set()
    for rows in files.values():
        while rows:  # a file is its shards one after another
            shard = next(k for k in sorted(want) if k not in found and rows[: len(want[k])] == want[k])
            found.add(shard)
            rows = rows[len(want[shard]) :]
    assert found == set(want)
    first = {}
    for (i, epoch), (_, shard, *_) in sorted(place.items()):
        first.setdefault(i, shard)
    assert {r.doc_id: r.shard for r in mix_report(d).collect()} == {i: first.get(i) for i in range(260)}
