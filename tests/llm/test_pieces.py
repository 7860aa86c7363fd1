import hashlib
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from arealith.llm.pieces import Codec, digests, load, tokenized
from arealith.llm.queries.pieces import model_path

MODEL = model_path()
ODD = ["", None, " ", "  ", "\n", " \n \n", " a  b\n c ", "ﬁ １ Å", "　x y", "a\x00b", "a▁b ▁ c", "▁", "<s>hi</s>", "tab\there", "日本語 😀😀", "x" * 5000, "\n\n x\n\n\ny "]


def same(texts):
    codec, sp = Codec(MODEL), load(MODEL)
    ids, counts = codec.encode(pa.array(texts, pa.string()))
    decoded, at = codec.decode(ids, counts).to_pylist(), 0
    for t, n, d in zip(texts, counts, decoded):
        want = sp.encode(t or "", add_eos=True)
        assert ids[at : at + n].tolist() == want
        assert d == sp.decode(want)
        at += n


def test_odd_texts():
    same(ODD)
    same([""])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n▁aeth.,éß日😀\t\x00Z"), max_size=40), min_size=1, max_size=6))
def test_random_texts(texts):
    same(texts)


def test_bytes_that_form_no_character_are_the_library_s():
    import numpy as np

    codec, sp = Codec(MODEL), load(MODEL)
    ids = [sp.piece_to_id("<0xE9>"), sp.piece_to_id("▁a"), 2]
    assert codec.decode(np.array(ids), np.array([3])).to_pylist() == [sp.decode(ids)]


def test_query_shape(spark):
    rng = random.Random(1)
    rows = [(i, t, "clash", i) for i, t in enumerate([*ODD, *("".join(rng.choice("ab \n") for _ in range(300)) for _ in range(50))])]
    sp = load(MODEL)
    got = digests(tokenized(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(4), MODEL)).collect()
    want = {}
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_empty_table(spark):
    assert digests(tokenized(spark.createDataFrame([], "doc_id long, text string"), MODEL)).count() == 0


def test_small_tables_restart_and_keep_what_is_met_again():
    rng = random.Random(3)
    sp = load(MODEL)
    for most, most_bytes in ((3, 10**6), (40, 10**6), (10**6, 60)):
        codec = Codec(MODEL, most=most, most_bytes=most_bytes)
        for _ in range(30):
            texts = ["".join(rng.choice(["the ", "river ", "\n", "é", f"w{rng.randrange(90)} "]) for _ in range(20)) for _ in range(4)]
            ids, counts = codec.encode(pa.array(texts))
            at = 0
            for t, n in zip(texts, counts):
                assert ids[at : at + n].tolist() == sp.encode(t, add_eos=True)
                at += n
        assert most != 40 or codec.segmented < codec.asked


def test_decoding_in_steps():
    codec, sp = Codec(MODEL), load(MODEL)
    texts = ["a long river of words\n" * 20, "", "é日 b"]
    ids, counts = codec.encode(pa.array(texts))
    for step in (1, 3, 50):
        assert codec.decode(ids, counts, step).to_pylist() == [sp.decode(sp.encode(t)) for t in texts]


def test_columns_with_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b", 5, "x", "y")], "doc_id long, text string, ids int, _text string, Decoded string")
    out = tokenized(d, MODEL, keep=("doc_id", "ids", "_text", "Decoded", "text"))
    assert out.columns == ["doc_id", "ids", "_text", "Decoded", "text", "ids_", "decoded_"]
    r = out.first()
    assert (r.ids, r.text, r["decoded_"]) == (5, "a b", "a b") and list(r["ids_"]) == load(MODEL).encode("a b", add_eos=True)
    assert tokenized(d, MODEL, decoded=False).columns == ["doc_id", "ids"]
