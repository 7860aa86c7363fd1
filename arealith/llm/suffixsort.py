"""Suffix arrays of many strings at a time by grouping (linear, without renaming).

Suffixes are kept in groups of equal Lyndon prefix, groups in their order. The groups of a string are taken from the
largest down: every suffix of a group points to the nearest suffix before it in a smaller group (previous smaller
pointer); suffixes that are pointed at are put, by the number of pointers, into groups of their own right behind the rest
of their old group, since their prefix is the old one and as many of the group's behind it. When the smallest
group is reached all groups are final, and a last pass emits their orders: the suffix before an emitted one, and the
chain of its pointers, are each the next of their group. Nothing is sorted again, and no names are given.

One string after the other, Python would do a few operations for every character. Here all strings of a batch are taken a
group (and in the last pass a suffix) at a time together, and each step is numpy over all of them.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def suffix_arrays(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of every string, one behind the other, as positions in ``text``.

    ``text``: symbols 0 to 2^16; ``text[0]`` is 0, every string ends with the only 0 in it; ``ends``: ascending, behind these.
    The first string starts at 1; slot 0 of the result is 0.
    """
    n = len(text)
    begin = np.r_[1, ends[:-1]]
    lane = np.zeros(n, np.int64)
    lane[begin] = 1
    lane = np.cumsum(lane)
    key = lane << 17 | text.astype(np.int64)
    at = np.argsort(key, kind="stable")  # slot -> suffix
    slot = np.empty(n, np.int64)
    slot[at] = np.arange(n)
    key = key[at]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.empty(n, np.int64)  # the first slot of a suffix's group
    group[at] = np.repeat(new, np.diff(np.r_[new, n]))
    end = np.zeros(n, np.int64)  # behind a group's last slot
    end[new] = np.r_[new[1:], n]
    previous = np.zeros(n, np.int64)
    marked = np.zeros(n, bool)
    top, low = ends.astype(np.int64).copy(), begin + 1
    while True:
        going = top > low
        if not going.any():
            break
        begin_, top, low = begin[going], top[going], low[going]
        begin = begin_
        start = group[at[top - 1]]
        size = top - start
        own = at[_ranges(start, size)]
        top = start
        _point(own, np.repeat(start, size), group, previous)
        _split(previous[own], text, at, slot, group, end, marked)
    return _emit(text, ends, group, previous)


def _point(own: np.ndarray, start: np.ndarray, group: np.ndarray, previous: np.ndarray) -> None:
    """Previous smaller pointers of the groups' suffixes; those of larger groups are known."""
    previous[own] = own - 1
    while True:
        high = group[previous[own]] >= start
        if not high.any():
            return
        own, start = own[high], start[high]
        previous[own] = previous[previous[own]]


def _split(pointed: np.ndarray, text: np.ndarray, at: np.ndarray, slot: np.ndarray, group: np.ndarray, end: np.ndarray, marked: np.ndarray) -> None:
    """Moves the suffixes that are pointed at behind the rest of their groups, fewer pointers first."""
    pointed = pointed[text[pointed] != 0]
    if not len(pointed):
        return
    who, times = np.unique(pointed, return_counts=True)
    old = group[who]
    order = np.lexsort((times, old))
    who, times, old = who[order], times[order], old[order]
    fresh = np.r_[True, old[1:] != old[:-1]]
    first = np.flatnonzero(fresh)
    many = np.diff(np.r_[first, len(who)])
    rest = end[old[first]] - many
    target = _ranges(rest, many)
    marked[who] = True
    inside = at[target]
    out = inside[~marked[inside]]
    holes = slot[who]
    holes = holes[holes < np.repeat(rest, many)]
    at[holes], slot[out] = out, holes
    at[target], slot[who] = who, target
    marked[who] = False
    end[old[first]] = rest
    fresh |= np.r_[True, times[1:] != times[:-1]]
    first = np.flatnonzero(fresh)
    many = np.diff(np.r_[first, len(who)])
    group[who] = np.repeat(target[first], many)
    end[target[first]] = target[first] + many


def _emit(text: np.ndarray, ends: np.ndarray, group: np.ndarray, previous: np.ndarray) -> np.ndarray:
    n = len(text)
    out = np.zeros(n, np.int64)
    following = np.arange(n)  # the next free slot of the group that starts here
    done = np.zeros(n, bool)
    at, ends = np.r_[1, ends[:-1]], np.asarray(ends)
    out[at], done[ends - 1] = ends - 1, True
    while len(at):
        j = out[at] - 1
        while True:
            j = j[(text[j] != 0) & ~done[j]]
            if not len(j):
                break
            g = group[j]
            out[following[g]] = j
            following[g] += 1
            done[j] = True
            j = previous[j]
        going = at + 1 < ends
        at, ends = at[going] + 1, ends[going]
    return out
