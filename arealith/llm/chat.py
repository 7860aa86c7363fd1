"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, its control strings marking the turns, and is encoded once with
character offsets. The assistant turns' spans, sorted as they come, are met with the sorted token
spans by binary search; tokens that overlap a span carry the loss. Control strings are special tokens,
so no token crosses a turn's text.

Control strings inside texts and roles are broken up reversibly: of every ``<``, any number of
backslashes and ``|``, one backslash more stands between in the rendered form.

A conversation is one training example and so one row, encoded whole: some 130 bytes of a task's memory for each of
its characters.

Defined results: null text and null role are empty; a null conv_id is a conversation of its own;
turns are ordered by turn (null first), then role and text, so ties and repeated rows have a fixed
order; other roles than assistant carry no loss; an empty table has no rows. Columns besides
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded, lists, slices

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
_BROKEN = re.compile(r"<\\(\\*)\|")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return _BROKEN.sub(r"<\1|", text)


def rendered(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted)``: every conversation under the template."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    one = lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP), escaped(t["text"]), F.lit(END))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), one), "").alias("formatted"))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, SEP, END)])
    return tok


def assistant_spans(text: str) -> np.ndarray:
    """Start and end (code points) of each assistant text, in order."""
    return np.array([m.span(2) for m in _TURN.finditer(text) if unescaped(m[1]) == "assistant"], np.int64).reshape(-1, 2)


def loss_mask(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens (sorted start, end) that overlap a span (sorted, disjoint), by binary search."""
    if not len(spans):
        return np.zeros(len(tokens), bool)
    near = np.minimum(np.searchsorted(spans[:, 1], tokens[:, 0], side="right"), len(spans) - 1)
    return (spans[near, 0] < tokens[:, 1]) & (tokens[:, 0] < spans[near, 1])


def formatted_chats(turns: DataFrame, model: str) -> DataFrame:
    """``(conv_id, formatted, ids, starts, ends, loss)``: tokens with offsets in code points and the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model)
        for whole in batches:
            for batch in slices(whole, "formatted", 1_000_000):
                texts = batch.column("formatted").to_pylist()
                ids, offs, masks = [], [], []
                for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
                    at = np.array(e.offsets, np.int64).reshape(-1, 2)
                    ids.append(np.array(e.ids, np.int32))
                    offs.append(at)
                    masks.append(loss_mask(at, assistant_spans(text)))
                n = np.array([len(i) for i in ids])
                at = np.concatenate([*offs, np.zeros((0, 2), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("formatted"), lists(np.concatenate([*ids, np.zeros(0, np.int32)]), n, pa.int32()), lists(at[:, 0].astype(np.int32), n, pa.int32()), lists(at[:, 1].astype(np.int32), n, pa.int32()), lists(np.concatenate([*masks, np.zeros(0, bool)]), n, pa.bool_())],
                    names=["conv_id", "formatted", "ids", "starts", "ends", "loss"],
                )

    return bounded(rendered(turns)).mapInArrow(run, "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def loss_runs(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The text under the mask, a string for each run of tokens with loss; a character split over tokens comes once."""
    if not loss.any():
        return []
    edge = np.diff(np.r_[0, loss.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [text[starts[a] : ends[b]] for a, b in zip(first, last, strict=True)]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, parsed from the formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, s, e, m in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("starts"), batch.column("ends"), batch.column("loss"), strict=True):
                turns = [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(text)]
                all_ = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                under = "".join(map(unescaped, loss_runs(text, *(x.values.to_numpy(zero_copy_only=False) for x in (s, e, m)))))
                out.append((conv, len(turns), all_, len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
