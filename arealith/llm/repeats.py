"""Repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed.

*Anchors.* Of the ``GRAM``-byte strings that start in a window of ``LENGTH`` bytes and end in it, the one of least hash (the
first of equals) is the window's anchor. Equal windows have equal anchors, so windows need comparing within an
anchor's string only. Consecutive windows of one anchor are a stretch of text; a text is cut into stretches without
gaps, whatever its length.

*Stretches* that are equal as a whole are counted by fingerprint: those that occur more than once are repeated
in full, and copies of any number cost a partial count. Where an anchor has several different stretches, one of each is
fetched, and those of one anchor make one string, whose suffix array is built by grouping
(``arealith.llm.suffixsort``). Two windows are equal where neighbours in the array agree in ``LENGTH`` bytes, which is compared
byte by byte.

*Frequent anchors*, of more than ``MOST`` different stretches, would make long strings (a passage that many documents
hold has other text around it in each of them). Their stretches are cut by content first: windows are taken by 16
offsets to the anchor, grouped by the bytes that all 16 share; a group whose members are equal over all 16 is repeated,
one with a single member is not, and only of the others are the windows counted one by one, by fingerprint.

Equal texts are one text throughout; a text with copies is removed in full, by count alone, when it is long enough. Texts meet
their stretches and their removed spans by two joins on the fingerprint of the text, for those that share anything only.

Defined results: null and empty texts and those below ``LENGTH`` bytes lose nothing; repeated rows, null and repeated ids are
documents of their own; overlapping repeats in one document count; empty tables give no rows. Matches never cross
documents, may begin and end within a character, and are judged on the input. A very long text is scanned in
pieces of about 1 MB; it is one row when its spans are cut out. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded, slices, strings, utf8, utf8_bytes
from arealith.llm.suffixsort import suffix_arrays
from arealith.llm.textarrays import mix64, span_hash
from arealith.sources.tables import stored

LENGTH, GRAM, MOST, STEP = 400, 128, 32, 16
#: Rows of a few numbers that are broadcast at most (some 20 MB).
MOST_BROADCAST = 1_000_000
_PIECE = 1_000_000
_TEXT = ["a", "b"]


def fingerprint(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first window, behind the last window, anchor (all within the row), anchor's hash and stretch's hash, piece by piece."""
    for lo in range(0, max(len(data) - length + 1, 0), _PIECE):
        part = data[lo : lo + _PIECE + length - 1]
        at = np.arange(len(part) - gram + 1)
        h = span_hash(part, at, at + gram)[0]
        low = least(h & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), length - gram + 1)
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(len(low)) + lo, side="right") - 1
        window = np.flatnonzero(np.arange(len(low)) + lo + length <= offsets[row + 1])
        if not len(window):
            continue
        row, anchor = row[window], anchor[window]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        first, behind = window[new], np.r_[window[new[1:] - 1], window[-1]] + 1
        row, anchor = row[new], anchor[new]
        yield row, first + lo - offsets[row], behind + lo - offsets[row], anchor + lo - offsets[row], h[anchor], span_hash(part, first, behind + length - 1)[0]


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(a, b, lo, hi, at, anchor, stretch)``: windows from lo to before hi of a text, the place and hash of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in slices(whole, "text", _PIECE):
                    for row, lo, hi, at, anchor, stretch in stretches(*utf8(batch.column("text")), length, gram):
                        own = pa.array(row)
                        rest = [pa.array(x) for x in (lo, hi, at, anchor.view(np.int64), stretch.view(np.int64))]
                        yield pa.RecordBatch.from_arrays([batch.column("a").take(own), batch.column("b").take(own), *rest], names=[*_TEXT, "lo", "hi", "at", "anchor", "stretch"])

    return bounded(texts).mapInArrow(run, "a long, b long, lo long, hi long, at long, anchor long, stretch long")


def sized(rows: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for a broadcast where it is small enough; else both sides are shuffled."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(a, b, text)`` of the fingerprints of a stored table, each once."""
    return docs.select(*fingerprint(F.col("text")), "text").join(sized(wanted), _TEXT, "left_semi").groupBy(*_TEXT).agg(F.first("text").alias("text"))


def fetched(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Adds the ``bytes`` of every stretch to its place (a, b, lo, hi, at, anchor, twice, frequent)."""
    cols = ["lo", "hi", "at", "anchor", "twice", "frequent"]
    places = stored(places.select(*_TEXT, *cols), "places")
    lists = places.groupBy(*_TEXT).agg(*(F.collect_list(c).alias(c) for c in cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _PIECE):
                data, offsets = utf8(batch.column("text"))
                size = batch.column("lo").value_lengths().to_numpy()
                row = np.repeat(np.arange(len(size)), size)
                lo, hi = (batch.column(c).flatten().to_numpy() for c in ("lo", "hi"))
                for k in range(0, len(row), 4_000):  # stretches overlap, so they are put out some 2 MB at a time
                    own = slice(k, k + 4_000)
                    many = hi[own] - lo[own] + length - 1
                    begin = np.r_[0, np.cumsum(many)]
                    take = np.repeat(offsets[row[own]] + lo[own] - begin[:-1], many) + np.arange(begin[-1])
                    flat = [batch.column(c).flatten()[own.start : own.stop] for c in cols]
                    keys = [batch.column(c).take(pa.array(row[own])) for c in _TEXT]
                    yield pa.RecordBatch.from_arrays([*keys, *flat, strings(data[take], begin).cast(pa.binary())], names=[*_TEXT, *cols, "bytes"])

    rows = texts_of(docs, stored(lists.select(*_TEXT), "wanted")).join(lists, _TEXT)
    return bounded(rows).mapInArrow(run, "a long, b long, lo long, hi long, at long, anchor long, twice boolean, frequent boolean, bytes binary")


def equal_windows(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from x and from y are the same, all of them compared, eight at a time."""
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    same = np.arange(len(x))
    for k in sorted({*range(0, length - 7, 8), length - 8}, key=lambda k: k * 5 % 8 * 100 + k):  # places far apart come early
        same = same[eight[x[same] + k] == eight[y[same] + k]]
    out = np.zeros(len(x), bool)
    out[same] = True
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, lane: np.ndarray, length: int) -> np.ndarray:
    """Which bytes start a window that another start in the same lane equals; stretches of a lane lie side by side."""
    size = np.diff(offsets)
    new = np.r_[True, lane[1:] != lane[:-1]]
    # A symbol in front of all, one behind each stretch; 0 ends a lane, 1 a stretch within it.
    begin = 1 + offsets[:-1] + np.arange(len(size))
    row = np.repeat(np.arange(len(size)), size)
    where = np.arange(len(data)) + 1 + row
    text = np.ones(1 + len(data) + len(size), np.int32)
    text[where] = data.astype(np.int32) + 2
    last = np.r_[new[1:], True]
    ends = (begin + size)[last] + 1
    text[ends - 1] = text[0] = 0
    order = suffix_arrays(text, ends)
    fits = np.zeros(len(text), bool)  # starts of whole windows
    fits[where[np.arange(len(data)) + length <= offsets[row + 1]]] = True
    ok = np.flatnonzero(fits[order[1:]] & fits[order[:-1]])
    plain = np.zeros(len(text), np.uint8)
    plain[where] = data
    x, y = order[ok], order[ok + 1]
    same = equal_windows(plain, x, y, length)
    found = np.zeros(len(text), bool)
    found[x[same]] = found[y[same]] = True
    return found[where]


def compared(places: DataFrame, length: int) -> DataFrame:
    """``(a, b, lo, hi)``: runs of repeated windows, of stretches that share an anchor with at most ``MOST`` others."""
    names = [*_TEXT, "lo", "hi"]

    def out(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_bytes(batch.column("bytes").cast(pa.large_binary()))
        anchor = batch.column("anchor").to_numpy()
        flags = np.zeros(len(data), bool)
        # Lanes of about the same length go together, since a step takes all lanes that are not at their end.
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = offsets[np.r_[first[1:], len(anchor)]] - offsets[first]
        for same in np.split(order := np.argsort(size, kind="stable"), np.flatnonzero(np.diff(np.cumsum(size[order]) // 1_000_000)) + 1):
            rows = np.concatenate([np.arange(first[k], first[k + 1] if k + 1 < len(first) else len(anchor)) for k in same])
            many = np.diff(offsets)[rows]
            begin = np.r_[0, np.cumsum(many)]
            take = np.repeat(offsets[rows] - begin[:-1], many) + np.arange(begin[-1])
            flags[take] = repeated_windows(data[take], begin, anchor[rows], length)
        row = np.repeat(np.arange(len(anchor)), np.diff(offsets))
        flags &= ~batch.column("twice").to_numpy(zero_copy_only=False)[row]  # whole stretches that occur twice are known
        before, after = np.r_[False, flags[:-1]], np.r_[flags[1:], False]
        start, stop = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
        own = row[start]
        shift = batch.column("lo").to_numpy()[own] - offsets[own]
        keys = [batch.column(c).take(pa.array(own)) for c in _TEXT]
        return pa.RecordBatch.from_arrays([*keys, pa.array(start + shift), pa.array(stop + shift)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                held.append(batch.slice(k, 2_000))
                size += held[-1].column("bytes").nbytes
                if size < 4_000_000:
                    continue
                both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = both.column("anchor")
                cut = len(anchor) - int(pc.sum(pc.equal(anchor, anchor[-1])).as_py())  # the last anchor's may go on
                if cut:
                    yield out(both.slice(0, cut))
                held = [both.slice(cut)]
                size = held[0].column("bytes").nbytes
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = places.select(*_TEXT, "lo", "anchor", "twice", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return bounded(dealt).mapInArrow(run, "a long, b long, lo long, hi long")


def offset_hashes(places: DataFrame, length: int, step: int) -> DataFrame:
    """Every stretch's windows by ``step`` offsets to the anchor: ``(a, b, lo, first, behind, core, whole)``.

    Offsets of a part are ``part * step`` to before ``(part + 1) * step``; core: hash of the bytes that all its windows
    share (a stretch that has one of them has these bytes), whole: of all bytes of the windows that the stretch has, and of
    which these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in slices(whole, "bytes", _PIECE):
                    data, offsets = utf8_bytes(batch.column("bytes").cast(pa.large_binary()))
                    lo, hi, at, anchor = (batch.column(c).to_numpy() for c in ("lo", "hi", "at", "anchor"))
                    low, high = at - hi + 1, at - lo  # offsets of the last and the first window
                    many = high // step - low // step + 1
                    row = np.repeat(np.arange(len(lo)), many)
                    part = (high // step)[row] - np.arange(len(row)) + np.repeat(np.cumsum(many) - many, many)  # places then ascend, as hashing wants
                    far, near = np.minimum(part * step + step - 1, high[row]), np.maximum(part * step, low[row])
                    place = offsets[row] + at[row] - lo[row]
                    core = span_hash(data, place - part * step, place - part * step - step + 1 + length)[0]
                    every = span_hash(data, place - far, place - near + length)[0] + mix64((far * length + near).astype(np.uint64))
                    salt = mix64(anchor[row].view(np.uint64) + mix64(part.astype(np.uint64) + np.uint64(1)))
                    cols = [batch.column(c).take(pa.array(row)) for c in (*_TEXT, "lo")]
                    rest = [at[row] - far, at[row] - near + 1, (core ^ salt).view(np.int64), (every ^ salt).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x) for x in rest)], names=[*_TEXT, "lo", "first", "behind", "core", "whole"])

    return bounded(places).mapInArrow(run, "a long, b long, lo long, first long, behind long, core long, whole long")


def window_hashes(places: DataFrame, length: int) -> DataFrame:
    """``(a, b, start, x, y, twice)``: a 128-bit hash of every window of the runs ``(first, behind)`` of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in slices(whole, "bytes", 100_000):
                    data, offsets = utf8_bytes(batch.column("bytes").cast(pa.large_binary()))
                    first, behind = (batch.column(c).flatten().to_numpy() for c in ("first", "behind"))
                    run_row = np.repeat(np.arange(batch.num_rows), batch.column("first").value_lengths().to_numpy())
                    many = behind - first
                    row = np.repeat(run_row, many)
                    start = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    at = offsets[row] + start - batch.column("lo").to_numpy()[row]
                    x = span_hash(data, at, at + length)[0]
                    y = span_hash(LETTERS[data], at, at + length)[0]
                    cols = [batch.column(c).take(pa.array(row)) for c in (*_TEXT, "twice")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(start), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=[*_TEXT, "twice", "start", "x", "y"])

    return bounded(places).mapInArrow(run, "a long, b long, twice boolean, start long, x long, y long")


#: Other numbers for the bytes, for a second hash.
LETTERS = np.random.default_rng(5).permutation(256).astype(np.uint8)


def split_by_content(places: DataFrame, length: int, step: int) -> DataFrame:
    """``(a, b, lo, hi)``: runs of repeated windows of stretches of frequent anchors."""
    parts = stored(offset_hashes(places, length, step), "parts")
    cores = parts.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    cores = stored(cores.filter("n > 1"), "cores")
    shared = stored(parts.join(cores, "core"), "shared")
    whole = shared.filter("low = high").select(*_TEXT, F.col("first").alias("lo"), F.col("behind").alias("hi"))
    mixed = shared.filter("low <> high").groupBy(*_TEXT, "lo").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in ("first", "behind")))
    windows = stored(window_hashes(places.join(mixed, [*_TEXT, "lo"]), length), "windows")
    twice = stored(windows.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "twice")
    ones = windows.join(twice, ["x", "y"]).select(*_TEXT, F.col("start").alias("lo"), (F.col("start") + 1).alias("hi"))
    return whole.union(ones)


def removed(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``(a, b, n_removed, n_spans, kept_sha256)`` of every text that has runs of repeated windows."""
    runs = stored(runs, "runs")
    lists = runs.groupBy(*_TEXT).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    texts = texts_of(docs, stored(runs.select(*_TEXT).distinct(), "changed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _PIECE):
                data, offsets = utf8(batch.column("text"))
                row = np.repeat(np.arange(batch.num_rows), batch.column("lo").value_lengths().to_numpy())
                lo, hi = (batch.column(c).flatten().to_numpy() + offsets[row] for c in ("lo", "hi"))
                edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi + length - 1, minlength=len(data) + 1)
                gone = np.cumsum(edge)[:-1] > 0
                fresh = gone.copy()
                fresh[1:] &= ~gone[:-1]
                begins = offsets[:-1][offsets[:-1] < len(data)]
                fresh[begins] = gone[begins]
                total = lambda x: (c := np.r_[0, np.cumsum(x)])[offsets[1:]] - c[offsets[:-1]]
                left = [hashlib.sha256(data[p:q][~gone[p:q]]).hexdigest() for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(total(gone)), pa.array(total(fresh)), pa.array(left)], names=[*_TEXT, "n_removed", "n_spans", "kept_sha256"])

    return bounded(texts.join(lists, _TEXT)).mapInArrow(run, "a long, b long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, step: int = STEP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = docs.filter(F.octet_length("text") >= length).select(*fingerprint(F.col("text")), "text")
    copied = stored(long.groupBy(*_TEXT).agg(F.count("*").alias("copies")).filter("copies > 1"), "copied")
    marks = stored(anchored(long, length, gram), "anchors")
    common = marks.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = marks.join(sized(stored(common, "common")), "anchor")
    # Different stretches of an anchor: how often each occurs, and one place of it.
    place = F.min(F.struct(*_TEXT, "lo", "hi", "at")).alias("place")
    kinds = stored(shared.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), place), "stretches")
    several = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "several")
    places = kinds.join(several, "anchor").select("place.*", "anchor", (F.col("n") > 1).alias("twice"), (F.col("kinds") > most).alias("frequent"))
    found = stored(fetched(docs, places, length), "fetched")
    repeated = stored(kinds.filter("n > 1").select("anchor", "stretch"), "repeated")
    known = marks.join(sized(repeated), ["anchor", "stretch"]).select(*_TEXT, "lo", "hi")
    runs = known.union(compared(found.filter("not frequent"), length)).union(split_by_content(found.filter("frequent"), length, step))
    changed = stored(removed(docs, runs.join(sized(copied), _TEXT, "left_anti"), length), "changed")
    size = F.octet_length("text").cast("long")
    rows = docs.select("doc_id", *fingerprint(F.col("text")), size.alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rows = rows.join(copied, _TEXT, "left").join(changed, _TEXT, "left")
    whole = F.col("copies").isNotNull()
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
