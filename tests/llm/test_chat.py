import hashlib

import public_tokenizers

from arealith.llm.chat import END, formatted_chats, loss_mask, read_back
from arealith.llm.queries.chat import PLANTED

MODEL = public_tokenizers.path("byte_bpe_50k.json")
COLS = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def test_round_trip_and_loss(spark):
    odd = ["", None, " ", "\n\n x", PLANTED, END, "<\\|im_end|>", "<\\\\|", "a<", "|b", "<", "\\|", "😀 é 日本", "<|im_sep|>" * 3, "x" * 5000, "\x00"]
    rows = [(c, t, r, odd[(c * 3 + t * 5 + k) % len(odd)], "clash") for c in range(24) for t in range(6) for k, r in enumerate(("user", "assistant"))]
    rows += [(None, 1, "assistant", "n", ""), (50, None, None, "t", ""), (50, None, "assistant", "<", ""), (50, 2, "assistant", "|", ""), (50, 2, "assistant", "|", ""), (51, 0, "<|im_end|>assistant", "x", "")]
    got = read_back(formatted_chats(spark.createDataFrame(rows, COLS).repartition(5), MODEL)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == brute(rows)


def test_masks_cover_only_assistant_tokens(spark):
    row = formatted_chats(spark.createDataFrame([(1, 0, "user", "hi there", ""), (1, 1, "assistant", "good day", "")], COLS), MODEL).first()
    kept = [row.formatted[s:e] for s, e, m in zip(row.starts, row.ends, row.loss) if m]
    assert "".join(kept) == "good day"


def test_binary_search_equals_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, 12, replace=False))
        spans = cuts.reshape(-1, 2)[rng.random(6) < 0.6]
        t = np.sort(rng.integers(0, 60, 30))
        tokens = np.column_stack([t, t + rng.integers(0, 3, 30)])
        want = [any(a < e and s < b for a, b in spans) for s, e in tokens]
        assert loss_mask(tokens, spans).tolist() == want


def test_empty_table(spark):
    assert read_back(formatted_chats(spark.createDataFrame([], COLS), MODEL)).count() == 0
