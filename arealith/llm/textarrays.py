"""Texts of a batch as byte arrays: words, their hashes and sums by row, without a loop over words."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words made of letters: ASCII letters and all of other scripts' characters.
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[128:] = True
#: Bytes other than ASCII white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of a kind within rows: first byte, byte behind the last, and each row's first run."""
    inside = kind[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    if len(data):
        before[0] = after[-1] = False
        before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, offsets)


def span_hash(data: np.ndarray, start: np.ndarray, *ends: np.ndarray, window: int = 1 << 18) -> list[np.ndarray]:
    """64-bit hashes of the byte spans from ``start`` to each of ``ends`` (ends never before the start).

    A polynomial hash out of prefix sums; spans are taken in windows of some 256 KB, so memory follows
    the window and the longest span, not the batch.
    """
    out = [np.zeros(len(start), np.uint64) for _ in ends]
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + window)))
        a = int(start[lo])
        b = max(int(e[lo:hi].max()) for e in ends)
        up, down = _powers(max(b - a, window) + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * down[: b - a], out=total[1:])
        s = start[lo:hi] - a
        for o, e in zip(out, ends, strict=True):
            o[lo:hi] = mix64((total[e[lo:hi] - a] - total[s]) * up[s])
        lo = hi
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``first[i]`` and ``first[i + 1]`` (empty rows: 0), along axis 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of every run, from each row's first run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
