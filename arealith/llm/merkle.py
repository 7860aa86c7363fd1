"""Merkle manifest of a dataset: a tree of documents for each language, a tree of the languages' roots, proofs by pointer jumping.

*Trees.* Leaves are numbered within their tree by running sums over ranges. Sixteen consecutive nodes make a
block; a block's digests, four levels of them, are one expression over its array, so a tree of n leaves takes
log16(n) groupings, each over a sixteenth of the one before.

*Proofs.* Every node at the foot of a block holds a segment: the siblings on its way to the block's top, which is
its ancestor. A self-join of the nodes with their ancestors puts the ancestor's segment behind a node's own and
doubles the distance of the ancestor; after log2(number of blocks on the way) joins every leaf has reached the root.
Only nodes that a later join needs as a leaf or as an ancestor stay (those whose height is a multiple of the
distance), so each join moves every leaf once and a shrinking rest.

Digests are lower-case hex SHA-256 of the hex digests put together; a segment keeps 32 bytes a level, null where a
node has no sibling.

Defined results: a null in any column is a value of its own (``-``); null languages are one tree, before all others;
rows that repeat an id are leaves in the order of their digests, equal rows in any order (they are the same leaf, each with
its own proof); null ids come first in their tree; a lone leaf is its tree's root, with an empty proof; empty tables
give no rows. Texts of any length are hashed whole. Columns besides the five hashed ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealith.operators.ranks import numbered
from arealith.sources.tables import stored

#: Levels of a block, and bytes that are broadcast at most.
LEVELS, MOST_BROADCAST = 4, 8_000_000
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hexed(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def shifted(number: Column, by: Column) -> Column:
    return F.call_function("shiftright", number, by)


def parent(left: Column, right: Column) -> Column:
    """Digest of a run of two nodes, or of one where the right one is null."""
    return F.unhex(digest(hexed(left), F.coalesce(hexed(right), F.lit(""))))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, leaf, tampered)``: a document's digest, and that of its tampered row where its id asks for one."""
    chars = lambda more: [field(F.col(c) + more if c == "n_chars" else F.col(c)) for c in HASHED]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(digest(*chars(F.lit(0)))).alias("leaf"),
        F.when(chosen, F.unhex(digest(*chars(F.lit(1))))).alias("tampered"),
    )


def beside(rows: DataFrame, small: DataFrame, on: list[str], width: int) -> DataFrame:
    """Join with a stored table, which is broadcast where its rows of ``width`` bytes are few, else shuffled."""
    return rows.join(F.broadcast(small) if small.count() * width <= MOST_BROADCAST else small, on)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, a leaf's number in its tree, and ``depth``, the tree's levels above its leaves."""
    at = stored(numbered(leaves, "at", "tree", *order), "numbered")
    trees = stored(at.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    return beside(at, trees, ["tree"], 64).select(*leaves.columns, (F.col("at") - F.col("first")).alias("idx"), depth.alias("depth"))


def block_levels(row: Column, steps: Column) -> Column:
    """All levels of a block, from the array of its lowest digests: ``steps`` times every two neighbours make one."""
    above = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: parent(F.get(a, i * 2), F.get(a, i * 2 + 1)))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), F.array(row), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))).otherwise(F.array(row))


def forest(leaves: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments of all nodes at the foot of a block, and the roots.

    ``leaves``: ``(tree, idx, depth, node, *carried)``. First result: ``(tree, height, idx, depth, node, segment, *carried)``,
    height counted in blocks; second: ``(tree, node)``.
    """
    rows, roots, feet, height = leaves, [], [], 0
    while True:
        steps = F.least(F.lit(LEVELS), F.col("depth") - height * LEVELS)
        own = F.struct("idx", "node", *carried) if not height else F.struct("idx", "node")
        blocks = rows.groupBy("tree", "depth", F.shiftright("idx", LEVELS).alias("block")).agg(F.sort_array(F.collect_list(own)).alias("feet"))
        blocks = stored(blocks.withColumn("levels", block_levels(F.transform("feet", lambda x: x["node"]), steps)), "blocks")
        foot = blocks.select("tree", "depth", "levels", F.posexplode("feet").alias("at", "foot"))
        sibling = lambda k: F.get(F.get("levels", k), shifted(F.col("at"), k).bitwiseXOR(1))
        segment = F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), sibling)).otherwise(F.array().cast("array<binary>"))
        more = [F.col(f"foot.{c}").alias(c) if not height else F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in carried]
        feet.append(foot.select("tree", F.lit(height).alias("height"), "foot.idx", "depth", "foot.node", segment.alias("segment"), *more))
        tops = blocks.select("tree", "depth", F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        roots.append(tops.filter(F.col("depth") <= (height + 1) * LEVELS).select("tree", "node"))
        rows, height = tops.filter(F.col("depth") > (height + 1) * LEVELS), height + 1
        if rows.isEmpty():
            break
    whole, tops = feet[0], roots[0]
    for f, r in zip(feet[1:], roots[1:], strict=True):
        whole, tops = whole.union(f), tops.union(r)
    return whole, stored(tops, "roots")


def proofs(leaves: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(tree, idx, node, segment, *carried)`` with every leaf's siblings up to its root, and ``(tree, node)`` of the roots."""
    nodes, roots = forest(leaves, carried)
    nodes, far = stored(nodes, "segments"), 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while far * LEVELS < deepest:
        goes_on = F.col("depth") > (F.col("height") + far) * LEVELS
        above = nodes.filter(F.col("height") > 0).select("tree", F.col("height").alias("up_height"), F.col("idx").alias("up_idx"), F.col("segment").alias("up_segment"))
        above = stored(above.filter(F.col("up_height") % far == 0), "ancestors")
        low = nodes.filter(F.col("height") % (2 * far) == 0).filter(goes_on).withColumns({"up_height": F.col("height") + far, "up_idx": F.shiftright("idx", LEVELS * far)})
        longer = beside(low, above, ["tree", "up_height", "up_idx"], 64 + far * LEVELS * 40)
        there = nodes.filter(F.col("height") % (2 * far) == 0).filter(~goes_on)
        nodes = stored(longer.withColumn("segment", F.concat("segment", "up_segment")).select(*there.columns).union(there), "segments")
        far *= 2
    return nodes.filter("height = 0").drop("height", "depth"), roots


def folded(node: Column, segment: Column, idx: Column) -> Column:
    """The root that a node and its siblings lead to."""
    step = lambda acc, k: F.when(shifted(idx, k).bitwiseAND(1) == 0, parent(acc, F.get(segment, k))).otherwise(parent(F.get(segment, k), acc))
    return F.when(F.size(segment) > 0, F.aggregate(F.sequence(F.lit(0), F.size(segment) - 1), node, step)).otherwise(node)


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row."""
    leaves = stored(leaf_rows(docs).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    at = placed(leaves, ["doc_id", "leaf", "tie"]).select("tree", "idx", "depth", F.col("leaf").alias("node"), "doc_id", "tampered")
    low, subroots = proofs(at, ["doc_id", "tampered"])
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    high, roots = proofs(placed(tops, ["name"]).select("tree", "idx", "depth", "node", "name"), ["name"])
    upper = high.select(F.col("name").alias("tree"), F.col("node").alias("subroot"), F.col("idx").alias("up_idx"), F.col("segment").alias("up_segment"))
    upper = stored(upper.crossJoin(F.broadcast(roots.select(F.col("node").alias("root")))), "subroots")
    both = beside(low, upper, ["tree"], 2_000)
    siblings = F.filter(F.concat("segment", "up_segment"), lambda s: s.isNotNull())
    found = both.withColumn("below", folded(F.coalesce("tampered", "node"), F.col("segment"), F.col("idx")))
    found = found.withColumn("found", folded(F.col("below"), F.col("up_segment"), F.col("up_idx")))
    return found.select(
        "doc_id",
        hexed(F.col("node")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform(siblings, hexed), ""), 256).alias("proof_sha256"),
        hexed(F.col("found")).alias("folded_root"),
        (F.col("found") == F.col("root")).alias("verified"),
    )
