import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arealith.llm import language, quality, toxicity
from arealith.llm.textarrays import LETTER, span_hash, words

DOC = "doc_id long, text string, lang string, source string, score string"
LAB = "doc_id long, quality int, toxic int"


def prose(rng, n, vocabulary="river stone walk green light house open water field quiet north garden".split()):
    return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."


def test_words_and_hashes():
    rows = ["Ab c", "", "é-x", "c"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(r.encode()) for r in rows])
    s, e, first = words(data, offsets, LETTER)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["Ab", "c", "é", "x", "c"] and first.tolist() == [0, 2, 2, 4, 5]
    (h,) = span_hash(data, s, e, window=2)
    assert h[1] == h[4] and len(set(h.tolist())) == 4


def test_trees_learn_an_interaction_and_walk_as_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.grow(x, y)
    assert ((t.score(x) > 0.5) == y).mean() > 0.98

    def walk(row):
        total = t.base
        for f, b, leaf in zip(t.feature, t.bound, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > b[at])
            total += leaf[at - len(f)]
        return total

    assert np.allclose(t.margin(x[:50]), [walk(r) for r in x[:50]])


def test_quality_query_on_planted_junk(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, 80) if i % 3 else "BUY NOW!! " * 40, "en", "s", "clash") for i in range(400)] + [(900, None, None, None, ""), (901, "", "en", "s", "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 1), (5, None, None), (7, 1, 0)]
    d, l = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LAB)
    trees = quality.train_quality(d, l)
    got = {r.doc_id: r.score for r in quality.score_quality(d, trees, ["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(400)) and 0 <= got[900] <= 1 and got[900] == got[901]
    none = quality.train_quality(d, l.limit(0))
    assert not none.trained and {r.score for r in quality.score_quality(d, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score_quality(d.limit(0), trees, ["doc_id"]).count() == 0


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    """Toxic texts mention one group more often; the penalty takes the weight off the mention."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1200):
        bad = i % 2
        mention = "muslim" if rng.random() < (0.7 if bad else 0.05) else "christian" if rng.random() < 0.05 else ""
        words_ = (prose(rng, 25) + " " + mention + " " + (rng.choice(["vile scum", "dumb fool", "awful trash"]) if bad and rng.random() < 0.9 else "") + " " + prose(rng, 10)).split()
        docs.append((i, " ".join(words_), "en", "s", ""))
        labels.append((i, 1, bad))
    d, l = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LAB)
    neutral = pa.array([f"A {g} neighbour walked home by the river." for g in ("muslim", "christian")])
    plain, fair = (toxicity.train_toxicity(d, l, penalty=p).score(neutral) for p in (0.0, 50.0))
    assert abs(fair[0] - fair[1]) < abs(plain[0] - plain[1]) / 2
    model = toxicity.train_toxicity(d, l)
    assert model.score(pa.array(["you dumb fool and vile scum"]))[0] > 0.5
    assert model.score(pa.array([None, ""])).tolist()[0] < 0.6
    assert not toxicity.train_toxicity(d, l.limit(0)).trained
    swap = toxicity.Swapper(toxicity.IDENTITY_TERMS)
    assert swap.swapped("A Muslim man, a womanly tale") == "A jewish woman, a womanly tale"
    both = [swap.mentions(f"one two three {k}") for k in range(300)]
    used = {frozenset(set(a.split()) ^ set(b.split())) for a, b in both}
    assert all(len(u) == 2 and any(u <= set(g) for g in toxicity.IDENTITY_TERMS) for u in used) and len({t for u in used for t in u}) > 60
    assert all(len(swap.mentions(t)) == 2 for t in ("", None, "x" * 50))


def test_code_books():
    for k in (2, 3, 4, 5, 9):
        b = language.code_book(k)
        apart = (b.shape[1] - b @ b.T) / 2
        assert apart[~np.eye(k, dtype=bool)].min() >= max(1, (b.shape[1] - 1) // 4)
    assert language.code_book(4).shape == (4, 7)


def test_languages(spark):
    rng = random.Random(1)
    sets = {"aa": "kata moni ruva sepi dolo".split(), "bb": "strix qworl zzent vrump klish".split(), "cc": "éloi ñandú über çava ßen".split()}
    docs = [(i, prose(rng, 30, sets[k]), k if i % 7 else None, "s", "") for i, k in enumerate(sorted(sets) * 60)]
    docs += [(900, None, "aa", "s", ""), (901, " 123 !!", "aa", "s", ""), (902, prose(rng, 30000, sets["bb"]), None, "s", "")]
    d = spark.createDataFrame(docs, DOC).repartition(4)
    model = language.train_language(d)
    got = {r.doc_id: r for r in language.predict_language(d, model, ["doc_id"]).collect()}
    names = sorted(sets) * 60
    assert np.mean([got[i].lang_pred == names[i] for i in range(180)]) > 0.98
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und") and got[902].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    one = language.train_language(d.filter("lang = 'aa'"))
    assert {r.lang_pred for r in language.predict_language(d, one, ["doc_id"]).collect()} == {"aa", "und"}
    none = language.train_language(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict_language(d, none, ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("kind", ["quality", "toxic", "lang"])
def test_held_out_accuracy(spark, kind):
    from arealith.llm.queries import language as ql
    from arealith.llm.queries import quality as qq
    from arealith.llm.queries import toxicity as qt

    sf = "/root/testdata/sf0.01"
    run = {"quality": qq, "toxic": qt, "lang": ql}[kind].run
    out = run(spark, sf).filter("held_out")
    if kind == "lang":
        both = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
        right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    else:
        both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
        right = both.agg(F.avg((F.col("predicted") == F.col(kind)).cast("double"))).first()[0]
    assert right > 0.9


MASK = 2**64 - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def hashed(span):
    step, total, power = pow(0x9E3779B97F4A7C15 | 1, -1, 2**64), 0, 1
    for b in span:
        total, power = (total + (b + 1) * power) & MASK, power * step & MASK
    return mixed(total)


def runs(data, inside):
    out = []
    for at, b in enumerate(data):
        if inside(b):
            if out and out[-1][1] == at:
                out[-1][1] = at + 1
            else:
                out.append([at, at + 1])
    return [data[a:b] for a, b in out]


ODD = ["", None, " ", "\n\n", "ÉCOLE naïve 日本 Straße", "Idiot! idiot, IDIOT", "a" * 300 + " " + "b!!" * 40, "x|y || 12%% <b>{z}</b>\tq\r\n end", "The MUSLIM man walked.", "ñ", "ab cd ab cd", "-- --"]


def test_toxicity_scores_equal_brute_force(spark):
    """Features and scores of the query's model, word by word."""
    rng = random.Random(8)
    docs = [(i, prose(rng, 30) + (" vile scum" if i % 3 == 0 else ""), "en", "s", "") for i in range(200)] + [(1000 + i, t, "en", "s", "") for i, t in enumerate(ODD)]
    docs += docs[:5]
    d = spark.createDataFrame(docs, DOC).repartition(4)
    model = toxicity.train_toxicity(d, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], LAB))
    assert model.pairs >= 150 and model.trained
    letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128
    out = toxicity.score_toxicity(d, model, ["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "score_"]
    text = {i: t for i, t, *_ in docs}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        found = set()
        for w in runs((text[r.doc_id] or "").lower().encode(), letter):
            found |= {(hashed(w[:n]) + k & MASK) >> (64 - toxicity.BITS) for k, n in enumerate((len(w), 5, 4))}
        margin = model.bias + sum(model.weight[model.place[f]] for f in found if model.place[f] >= 0)
        assert r["score_"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
    empty = toxicity.train_toxicity(d.limit(0), spark.createDataFrame([], LAB))
    assert not empty.trained and toxicity.score_toxicity(d.limit(0), model, ["doc_id"]).count() == 0


def test_penalty_matters_in_the_query(spark, monkeypatch):
    """On the given tables: pairs exist, scores differ without the penalty, neutral mentions of a group score alike."""
    from arealith.llm.queries import toxicity as qt

    sf = "/root/testdata/sf0.01"
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plain, fair = (toxicity.train_toxicity(d, l, penalty=p) for p in (0.0, 4.0))
    learned = l.filter(toxicity.fold(5) != 0).filter("toxic is not null").join(d, "doc_id").count()
    assert fair.pairs >= learned > 0
    found = {r.doc_id: r.score for r in qt.run(spark, sf).collect()}
    without = {r.doc_id: r.score for r in toxicity.score_toxicity(d, plain, ["doc_id"]).collect()}
    assert found.keys() == without.keys() and np.mean([abs(found[i] - without[i]) > 1e-9 for i in found]) > 0.9

    def apart(model):
        margins = []
        for g in toxicity.IDENTITY_TERMS:
            p = model.score(pa.array([f"The {t} neighbour walked home." for t in g]))
            margins.append(np.ptp(np.log(p / (1 - p))))
        return np.mean(margins)

    assert apart(fair) < apart(plain) / 2 and max(fair.score(pa.array([f"The {t} neighbour." for g in toxicity.IDENTITY_TERMS for t in g]))) < 0.5


def test_languages_equal_brute_force(spark):
    """Margins and loss-weighted decoding, n-gram by n-gram and codeword by codeword."""
    rng = random.Random(2)
    sets = {"aa": "kata moni ruva sepi dolo".split(), "bb": "strix qworl zzent vrump klish".split(), "cc": "éloi ñandú über çava ßen".split()}
    docs = [(i, prose(rng, 12, sets[k]), k, "s", "") for i, k in enumerate(sorted(sets) * 40)] + [(1000 + i, t, None, "s", "") for i, t in enumerate(ODD)] + [(2000, "kata strix " * 9, None, "s", "")]
    docs += docs[:3]
    d = spark.createDataFrame(docs, DOC).repartition(4)
    model = language.train_language(d)
    u32 = 2**32 - 1

    def predicted(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        b, slots = f" {text.lower()}  ".encode(), []
        for k in range(len(b) - 2):
            one = b[k] * 2654435761 & u32
            two = (one ^ (b[k + 1] * 2246822519 + 1 & u32)) * 3266489917 & u32
            three = (two ^ (b[k + 2] * 668265263 + 2 & u32)) * 374761393 & u32
            slots += [one >> 20, two >> 20, three >> 20]
        margins = [sum(float(model.weights[s, j]) for s in slots) / max(len(slots), 1) + model.bias[j] for j in range(model.book.shape[1])]
        loss = [sum(t * np.log1p(np.exp(-4 * min(4, max(-4, m)) * bit)) for t, m, bit in zip(model.trust, margins, word)) for word in model.book]
        p = np.exp(-(np.array(loss) - min(loss)))
        return model.languages[int(np.argmin(loss))], float((p / p.sum()).max())

    text = {i: t for i, t, *_ in docs}
    rows = language.predict_language(d, model, ["doc_id"]).collect()
    assert len(rows) == len(docs)
    for r in rows:
        lang, score = predicted(text[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)
    assert language.predict_language(d.limit(0), model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.predict_language(d, language.train_language(d.limit(0)), ["doc_id"]).collect()} == {"und"}
    few = language.train_language(d, in_all=15)
    assert few.languages == model.languages and len(few.languages) == 3


def test_both_systems_of_the_fit_agree(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((40, 8)).astype(np.float32)
    names = [("a", "b", "c")[k % 3] for k in range(40)]
    monkeypatch.setattr(language, "SLOTS", 8)
    primal = language.fit(x, names)
    wide = language.fit(np.pad(x, ((0, 0), (0, 60))), names)  # slots that never occur weigh nothing
    assert np.allclose(primal.weights[:8], wide.weights[:8], atol=1e-3) and np.allclose(primal.bias, wide.bias, atol=1e-3)


def test_statistics_equal_brute_force():
    kinds = {1: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: "abcdefghijklmnopqrstuvwxyz", 3: "0123456789", 4: " \t\r\x0b\x0c", 5: "\n", 7: ".,;:'\"-()", 8: "!", 9: "|", 10: "#$%&*", 11: "<>{}[]=/\\"}
    kind = {ord(c): k for k, cs in kinds.items() for c in cs} | dict.fromkeys(range(128, 256), 6)

    def one(text):
        b = (text or "").encode()
        words_ = runs(b, lambda x: x not in (32, 9, 10, 11, 12, 13))
        w, n = max(len(words_), 1), max(len(b), 1)
        counts = [sum(kind.get(x, 0) == k for x in b) for k in range(12)]
        cols = [
            np.log1p(len(b)), np.log1p(len(words_)), sum(map(len, words_)) / w, len(set(words_)) / w,
            sum(a == c for a, c in zip(words_[1:], words_)) / w, sum(kind.get(x[-1], 0) not in (1, 2, 3, 6, 7) for x in words_) / w,
            sum(len(x) > 20 for x in words_) / w, sum(a == c and kind.get(a, 0) in (7, 8, 9, 10, 11) for a, c in zip(b[1:], b)) / n, n / (counts[5] + 1),
        ]
        return [*cols, *(c / n for c in counts)]

    rng = random.Random(9)
    texts = [*ODD, *("".join(rng.choice("aB3 .!|#<é\n ") for _ in range(rng.choice([1, 40, 900]))) for _ in range(60)), "w " * 50_000]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [one(t) for t in texts], atol=1e-12)
