"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece holds a whitespace marker after another character, merges never cross the start of a
run of markers, and a character that occurs in no piece of two or more characters never merges at
all. A text so falls into chunks (a run of markers with the word behind it; a line break) whose
segmentations are independent of each other. Each task keeps a table of the distinct chunks it has
met, has the library segment each of them once, and joins the ids back by position with array
look-ups. A vocabulary without that property is refused when it is loaded.

The table lives as long as its task and is bounded: beyond ``MOST_CHUNKS`` chunks or ``MOST_BYTES`` bytes of
them only those stay that a later slice held as well. A chunk may so be segmented again, never otherwise. A
table over the whole corpus would need every word of it to cross a shuffle twice, many times the input.

Defined results: null and empty texts give the end id alone and decode to the empty text; a literal
marker in a text is a space to the library, and so it is here; repeated rows and ties give repeated results;
an empty table has no rows. A very long text is one slice: encoding holds some 30 bytes for each of its
bytes. Columns besides those in ``keep`` are not read; where ``keep`` names a column ``ids`` or ``decoded``,
the new column has an underscore behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded, lists, slices, spare, strings, utf8, utf8_bytes

#: Bounds of a task's table of distinct chunks.
MOST_CHUNKS, MOST_BYTES = 200_000, 8_000_000
MARK = "▁"
#: A character that is in no longer piece stands before a chunk to keep the library's first marker off it.
BREAK = "\n"


@lru_cache(maxsize=2)
def load(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    plain = [p for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any(MARK in p.lstrip(MARK) for p in plain):
        raise ValueError("pieces of this vocabulary cross whitespace markers")
    if any(BREAK in p and len(p) > 1 for p in plain):
        raise ValueError("pieces of this vocabulary cross line breaks")
    if sp.encode(" a  b") != sp.encode(f"{MARK}a{MARK}{MARK}b") or sp.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
        raise ValueError("this vocabulary's normaliser changes texts")
    return sp


class Codec:
    """Batch encoder and decoder over one vocabulary, with its table of distinct chunks."""

    def __init__(self, model: str, together: int = 64, most: int = MOST_CHUNKS, most_bytes: int = MOST_BYTES):
        self.sp, self.together, self.most, self.most_bytes = load(model), together, most, most_bytes
        self.line = np.array(self.sp.encode(BREAK)[1:], np.int32)
        if len(self.line) != 1:
            raise ValueError("a line break is not one id in this vocabulary")
        kinds = [(self.sp.is_control(i), self.sp.is_byte(i), self.sp.is_unknown(i), self.sp.id_to_piece(i)) for i in range(self.sp.vocab_size())]
        spoken = [b"" if control else bytes([int(piece[3:5], 16)]) if byte else " \u2047 ".encode() if unknown else piece.replace(MARK, " ").encode() for control, byte, unknown, piece in kinds]
        self.bytes = np.frombuffer(b"".join(spoken), np.uint8)
        self.byte_count = np.fromiter(map(len, spoken), np.int64, len(spoken))
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.strips = np.array([piece.startswith(MARK) for *_, piece in kinds])
        self.asked = self.segmented = 0  # distinct chunks of slices, and those that the library had to segment
        self.restart()

    def restart(self) -> None:
        """An empty table: the end id and the line break are its first entries, chunks follow."""
        self.chunks = pa.array([], pa.large_binary())
        self.ids = np.r_[np.int32(self.sp.eos_id()), self.line]
        self.count = np.ones(2, np.int64)
        self.again = np.zeros(0, bool)  # whether a later slice held the chunk as well

    def shrink(self) -> None:
        """Only the chunks that were met again stay; if these are many as well, none."""
        stays = np.flatnonzero(self.again)
        chunks, rows = self.chunks.take(pa.array(stays)), np.r_[0, 1, stays + 2]
        start, count = (np.cumsum(self.count) - self.count)[rows], self.count[rows]
        ids = self.ids[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        self.restart()
        if len(chunks) <= self.most // 2 and chunks.nbytes <= self.most_bytes // 2:
            self.chunks, self.ids, self.count, self.again = chunks, ids, count, np.zeros(len(chunks), bool)

    def entries(self, chunks: pa.Array) -> np.ndarray:
        """Table entries of distinct chunks; those not met before are segmented and kept."""
        if len(self.chunks) > self.most or self.chunks.nbytes > self.most_bytes:
            self.shrink()
        at = pc.index_in(chunks, value_set=self.chunks) if len(self.chunks) else pa.nulls(len(chunks), pa.int32())
        new = chunks.filter(pc.is_null(at))
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.again[out[out >= 0]] = True
        if len(new):
            ids, count = self.segment(*utf8_bytes(new))
            out[out < 0] = len(self.chunks) + np.arange(len(new))
            self.chunks = pa.concat_arrays([self.chunks, new])
            self.ids, self.count, self.again = np.r_[self.ids, ids], np.r_[self.count, count], np.r_[self.again, np.zeros(len(new), bool)]
        self.asked, self.segmented = self.asked + len(chunks), self.segmented + len(new)
        return out + 2

    def segment(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and id counts of distinct chunks; many chunks go to the library in one string, each behind a line break."""
        joined = np.insert(data, offsets[:-1], 10).tobytes()
        cut = (offsets + np.arange(len(offsets)))[:: self.together].tolist()
        cut = cut if cut[-1] == len(joined) else [*cut, len(joined)]
        got = self.sp.encode([joined[lo:hi].decode() for lo, hi in zip(cut[:-1], cut[1:], strict=True)], num_threads=1)
        flat = np.fromiter(chain.from_iterable(g[1:] for g in got), np.int32)  # without the library's own first marker
        heads = np.flatnonzero(flat == self.line[0])
        return flat[flat != self.line[0]], np.diff(np.r_[heads, len(flat)]) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id, and how many ids each text has."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        data, offsets = utf8(texts)
        space, line = data == 32, data == 10
        begins = line | space
        begins[1:] &= ~(space[1:] & space[:-1])
        begins[1:] |= line[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(begins)
        rows = np.searchsorted(at, offsets)  # each row's first chunk
        is_line = line[at]
        words = strings(data, np.r_[at, len(data)]).filter(pa.array(~is_line)).dictionary_encode()
        entry = np.ones(len(at), np.int64)
        entry[~is_line] = self.entries(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        start = np.cumsum(self.count) - self.count
        entry = np.insert(entry, rows[1:], 0)
        first = rows + np.arange(len(rows))
        count = self.count[entry]
        ends = np.r_[0, np.cumsum(count)]
        flat = self.ids[np.repeat(start[entry] - ends[:-1], count) + np.arange(ends[-1])]
        return flat, ends[first[1:]] - ends[first[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray, step: int = 1 << 16) -> pa.Array:
        """Texts of rows of ids: the pieces' bytes joined by position, without the first piece's marker.

        Bytes are placed for ``step`` ids at a time. Rows whose bytes are not UTF-8 (byte pieces that form no
        character) are left to the library.
        """
        ends = np.cumsum(counts)
        skip = np.zeros(len(ids), np.int64)
        first = (ends - counts)[counts > 0]
        skip[first] = self.strips[ids[first]]
        n = self.byte_count[ids] - skip
        stop = np.r_[0, np.cumsum(n)]
        data = np.empty(stop[-1], np.uint8)
        for lo in range(0, len(ids), step):
            hi = min(lo + step, len(ids))
            at = np.arange(stop[lo], stop[hi])
            data[stop[lo] : stop[hi]] = self.bytes[np.repeat(self.byte_start[ids[lo:hi]] + skip[lo:hi] - stop[lo:hi], n[lo:hi]) + at]
        raw = strings(data, stop[np.r_[0, ends]])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self.sp.decode(ids[hi - k : hi].tolist()) for hi, k in zip(ends.tolist(), counts.tolist(), strict=True)], pa.string())


def tokenized(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1_500_000, decoded: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (end id included) and, if wanted, ``decoded``: what the library's decode makes of the ids."""
    rows = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(text).alias("text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                ids, counts = codec.encode(batch.column("text"))
                texts = [codec.decode(ids, counts)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), lists(ids, counts, pa.int32()), *texts], names=[*kept, "ids", "decoded"][: len(kept) + 1 + decoded])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1]) + "ids array<int>" + ", decoded string" * decoded
    names = [*keep, *(spare(c, keep) for c in ("ids", "decoded")[: 1 + decoded])]
    return bounded(rows).mapInArrow(run, schema).toDF(*names)


def digests(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return tokens.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
