"""Near-duplicate texts: ProbMinHash of word shingles, banding, exact verification, classes.

*Sketch.* A text's shingles are its distinct runs of five lower-cased words. A shingle weighs 1 + ln(bytes of its words),
in whatever text it is and however often. Every shingle sends a Poisson stream of arrivals, of rate equal to its weight, to
random registers; a register keeps its earliest arrival. A stream ends as soon as its next arrival is later than every
register's (early termination). Two texts agree in a register with their probability Jaccard; as weights do not change from text
to text, this is close to their weighted Jaccard similarity, and that to the plain one (weights of five words differ little).

*Candidates.* Texts with the same words are one node, with a number of its own. Nodes that agree in all
registers of a band share a bucket. Within a bucket all nodes are paired with the smallest one only;
once these pairs are verified and joined to components, the nodes outside a bucket's largest
component are paired with all nodes of other components in that bucket. Every two nodes of a bucket
so end up linked through verified links or compared with each other, at a cost that is linear in the
size of a group of copies. Candidates that cannot reach the threshold by their shingles' counts and weights, or
whose registers (four bits of each of 400) agree less than five standard deviations below the threshold's
mean, are left out before texts are fetched.

*Verification* is exact, on the distinct shingles of the whole texts: their plain or their weighted Jaccard similarity is at
least ``threshold``. A class is a connected component of verified links; its id is its smallest doc_id.

Defined results: a text of one to four words has one shingle, all of it; null texts and texts without
a word are never linked; a null doc_id is a class of its own; rows that repeat a doc_id are one
document, linked by each of its texts; ties and repeated rows
fall into one class; empty tables give no rows. A very long text is a slice of its own: its sketch holds some 150
bytes for each of its words, its verification its distinct shingles twice. Columns besides doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.llm.arrowtools import bounded, lists, slices, utf8
from arealith.llm.textarrays import VISIBLE, mix64, rows_of, span_hash, words
from arealith.operators.components import connected_components
from arealith.sources.tables import stored

WIDTH, BANDS, ROWS = 5, 50, 8
#: Ids that are broadcast at most (8 MB).
MOST_BROADCAST = 1_000_000
_G = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, each text's first word, and the words' bytes."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    start, end, first = words(data, offsets, VISIBLE)
    return span_hash(data, start, end)[0], first, end - start


def shingles(h: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row: row, hash (sorted within a row) and count."""
    return weighted_shingles(h, first, np.ones(len(h), np.int64), width)[:3]


def weighted_shingles(h: np.ndarray, first: np.ndarray, size: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row: row, hash (sorted within a row), count and weight by the bytes of the words."""
    n = np.diff(first)
    number = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), number)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    last = first[row + 1]
    total = np.r_[0, np.cumsum(size)]
    weight = 1 + np.log(np.maximum(total[np.minimum(at + width, last)] - total[at], 1))
    s = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < last
        s = s * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(k)) if len(h) else s
    s = mix64(s)
    order = np.lexsort((s, row))
    s, row, weight = s[order], row[order], weight[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], s[at], np.diff(np.r_[at, len(s)]), weight[at]


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Registers of every row: the element of the earliest arrival (0 where a row has no element)."""
    first_at = np.full(rows * registers, np.inf)
    holder = np.zeros(rows * registers, np.uint64)
    latest = np.full(rows, np.inf)
    active, time, k = np.arange(len(row)), np.zeros(len(row)), 0
    while len(active):
        e = element[active]
        a = mix64(e + _G * np.uint64((2 * k + 1) % 2**63))
        time = time - np.log(uniform(a)) / weight[active]
        going = time < latest[row[active]]
        active, time, e = active[going], time[going], e[going]
        at = row[active] * registers + (mix64(a[going] ^ _G) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first_at, at, time)
        won = first_at[at] == time
        holder[at[won]] = e[won]
        busy = np.unique(row[active])
        latest[busy] = first_at.reshape(rows, registers)[busy].max(1)
        k += 1
    return holder.reshape(rows, registers)


def sketches(docs: DataFrame, bands: int = BANDS, per_band: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``(doc_id, mark, same1, same2, shingles, weight, bands, r0, r1, ...)`` of every text with a word.

    ``mark`` is a hash of the text as it is (with the id it names a row's text), ``same*`` a 128-bit fingerprint of the words in
    order, ``r*`` four bits of each register, sixteen to a number.
    """
    m = bands * per_band
    parts = registers(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in slices(whole, "_text", 1_000_000):
                    yield sketch(batch)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        h, first, size = word_hashes(batch.column("_text"))
        place = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
        same = []
        for salt in (3, 5):
            total = np.r_[np.uint64(0), np.cumsum(mix64(h ^ mix64(place * _G + np.uint64(salt))))]
            same.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        row, s, _, weight = weighted_shingles(h, first, size, width)
        sig = prob_min_hash(row, s, weight, n, m)
        keys = np.zeros((n, bands), np.uint64)
        for j in range(per_band):
            keys = mix64(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, j::per_band] + np.uint64(j))
        keys = mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * _G).view(np.int64)
        four = np.pad((mix64(sig + np.uint64(9)) & np.uint64(15)).astype(np.uint8), ((0, 0), (0, -m % 16)))
        four = (four[:, ::2] << 4 | four[:, 1::2]).view(np.int64)
        have = np.flatnonzero(np.diff(first) > 0)
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(have)) for c in ("doc_id", "mark")),
                *(pa.array(x[have]) for x in same),
                pa.array(np.bincount(row, minlength=n)[have]),
                pa.array(np.bincount(row, weight, minlength=n)[have]),
                lists(keys[have].ravel(), np.full(len(have), bands), pa.int64()),
                *(pa.array(four[have, k]) for k in range(len(parts))),
            ],
            names=["doc_id", "mark", "same1", "same2", "shingles", "weight", "bands", *parts],
        )

    cols = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").alias("_text"))
    return bounded(cols).mapInArrow(run, "doc_id long, mark long, same1 long, same2 long, shingles long, weight double, bands array<long>, " + ", ".join(f"{r} long" for r in parts))


def registers(m: int) -> list[str]:
    return [f"r{k}" for k in range(-(-m // 16))]


def may_reach(threshold: float, m: int) -> Column:
    """Whether two nodes (columns a_*, b_*) may reach the threshold by their shingles' counts or weights and by their registers."""
    differ = F.lit(0)
    for r in registers(m):
        x = F.col(f"a_{r}").bitwiseXOR(F.col(f"b_{r}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    share = threshold + (1 - threshold) / 16  # registers that differ agree in four bits once in sixteen times
    least = m * share - 5 * (m * share * (1 - share)) ** 0.5
    near = lambda c: F.least(f"a_{c}", f"b_{c}") >= (threshold - 1e-9) * F.greatest(f"a_{c}", f"b_{c}")
    return (near("shingles") | near("weight")) & (m - differ >= least)


def named(nodes: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{side}_{c}") for c in columns))


def possible(pairs: DataFrame, nodes: DataFrame, threshold: float, m: int) -> DataFrame:
    """Pairs (a, b) of nodes that may reach the threshold."""
    for side in "ab":
        pairs = pairs.join(named(nodes, side, ["node", "shingles", "weight", *registers(m)]), F.col(side) == F.col(f"{side}_node"))
    return pairs.filter(may_reach(threshold, m)).select("a", "b")


def copies_of(pairs: DataFrame, side: str, share: int = 256) -> DataFrame:
    """How many copies of a node's text its pairs are dealt over: one for every ``share`` of them."""
    return stored(pairs.groupBy(side).agg(F.ceil(F.count("*") / share).cast("int").alias("slots")), "slots")


def with_texts(pairs: DataFrame, texts: DataFrame, side: str, copies: DataFrame) -> DataFrame:
    """Adds the text of one side of each pair; no task gets all pairs of one node."""
    other = "b" if side == "a" else "a"
    dealt = pairs.join(copies, side).withColumn("slot", F.pmod(F.xxhash64(other), F.col("slots")).cast("int")).drop("slots")
    spread = copies.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    return dealt.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")).join(spread, side), [side, "slot"]).drop("slot")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts' distinct shingles have at least that similarity.

    A node's text is that of the row ``(doc_id, mark)`` of the table of nodes.
    """
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(wanted.join(nodes.select("node", "doc_id", "mark"), "node"), "wanted")
    if wanted.count() <= MOST_BROADCAST:  # else all texts are shuffled once
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").join(wanted, ["doc_id", "mark"]).groupBy("node").agg(F.min("text").alias("text"))
    copies = {side: copies_of(pairs, side) for side in "ab"}
    both = with_texts(with_texts(pairs, texts, "b", copies["b"]), texts, "a", copies["a"]).select("a", "b", "text_a", "text_b").sortWithinPartitions("a")

    def sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        h, first, size = word_hashes(texts)
        row, s, _, weight = weighted_shingles(h, first, size, width)
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        return [(s[lo:hi], weight[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def similarity(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
        both = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y if len(x) else np.zeros(len(y), bool)
        common, shared = int(both.sum()), float(wy[both].sum())
        return max(common / max(len(x) + len(y) - common, 1), shared / max(float(wx.sum() + wy.sum()) - shared, 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_b", 1_000_000):
                ids = batch.column("a").to_numpy()
                new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                which = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])
                firsts = sets(batch.column("text_a").take(pa.array(new)))
                score = [similarity(*firsts[k], *y) for k, y in zip(which, sets(batch.column("text_b")), strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], names=["a", "b", "similarity"])
                yield out.filter(pc.greater_equal(out.column("similarity"), threshold))

    return bounded(both).mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, per_band: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``(doc_id, class_id, kept)`` for every row of ``docs``; one document of each class is kept."""
    marks = stored(sketches(docs, bands, per_band, width), "sketches")
    m = bands * per_band
    # A number for each distinct text, and the row that stands for it.
    members = marks.groupBy("same1", "same2").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    members = stored(members.select("same1", "same2", "first", F.monotonically_increasing_id().alias("node")), "members")
    # One row for each node; stored tables let Spark split a join's hot keys.
    own = marks.join(members, ["same1", "same2"]).filter((F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    facts = ["doc_id", "mark", "shingles", "weight", "bands", *registers(m)]
    nodes = stored(own.groupBy("node").agg(F.min(F.struct("same1", *facts)).alias("s")).select("node", *(f"s.{c}" for c in facts)), "nodes")
    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = stored(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    buckets = stored(keyed.join(shared, "key"), "buckets")

    stars = buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(possible(stars, nodes, threshold, m), nodes, docs, threshold, width).select("a", "b"), "links")
    parts = connected_components(links, "a", "b")

    # What the stars left open: nodes of a bucket outside its largest component, against all of other components.
    placed = stored(buckets.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "band", "node", "pivot", F.coalesce("component", "node").alias("component")), "placed")
    groups = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = placed.join(stored(mixed.select("key", "largest"), "mixed"), "key")
    short = F.transform("bands", lambda k: k.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("short")  # enough to tell a band's keys apart
    open_ = stored(open_.join(nodes.select("node", "shingles", "weight", short, *registers(m)), "node"), "open")
    cols = ["key", "band", "node", "component", "pivot", "shingles", "weight", "short", *registers(m)]
    few, every = named(open_.filter("component <> largest"), "a", cols), named(open_, "b", [*cols, "largest"])
    # A pair of two small components is taken from its smaller node, and every pair in the first band that it shares.
    once = (F.col("b_component") == F.col("b_largest")) | (F.col("a_node") < F.col("b_node"))
    new = (F.col("a_node") != F.col("b_pivot")) & (F.col("b_node") != F.col("b_pivot"))
    before = F.arrays_zip(F.slice("a_short", 1, F.col("a_band")).alias("x"), F.slice("b_short", 1, F.col("a_band")).alias("y"))
    first = ~F.exists(before, lambda z: z["x"] == z["y"])
    rest = few.join(every, (F.col("a_key") == F.col("b_key")) & (F.col("a_component") != F.col("b_component")) & once & new & may_reach(threshold, m) & first)
    rest = rest.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    more = stored(verified(rest, nodes, docs, threshold, width).select("a", "b"), "more-links")
    # A document has the nodes of all its texts, and these are of one class.
    owners = stored(marks.select("doc_id", "same1", "same2").join(members, ["same1", "same2"]).select("doc_id", "node").distinct(), "owners")
    several = owners.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").drop("z")
    same = owners.join(several, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    classes = connected_components(links.union(more).union(same), "a", "b")
    homes = stored(owners.join(classes.select(F.col("id").alias("node"), "component"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")).distinct(), "homes")
    least = stored(homes.groupBy("component").agg(F.min("doc_id").alias("class_id")), "classes")
    out = docs.select("doc_id").join(homes.join(least, "component").select("doc_id", "class_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
