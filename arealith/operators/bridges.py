"""Bridges of a graph and the sizes of the sides that removing one leaves, in rounds that grow with the logarithm of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealith.operators.ranks import numbered
from arealith.sources.tables import cut, scratch, stored

# Loops store their tables: a checkpoint keeps the size that was guessed for its plan, which a join with itself squares in each round,
# until planning takes longer than the work; a stored table's size is known.


def _followed(rows: DataFrame, at: str, to: DataFrame, hops: int) -> DataFrame:
    """The column moved along ``to (id, up)`` so many times; what is not in ``to`` stays."""
    for _ in range(hops):
        step = to.select(F.col("id").alias(at), F.col("up").alias("_up"))
        rows = rows.join(step, at, "left").withColumn(at, F.coalesce("_up", F.col(at))).drop("_up")
    return rows


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)``, a < b and distinct, that span the graph of all of them, and ``(id, component)`` of its nodes.

    Every part takes its edge of least hash to another part (no two parts can so close a cycle, but that two take the same edge;
    the smaller one is then the root), and the parts that these edges join are one from then on: each round at least
    halves the number of parts that have an edge left. A part follows the pointers to its root four at a time.
    """
    left = stored(edges.select("a", "b", F.xxhash64("a", "b").alias("h"), F.col("a").alias("p"), F.col("b").alias("q")), "left")
    nodes = edges.select(F.col("a").alias("component")).union(edges.select("b")).distinct().withColumn("id", F.col("component"))
    forest = edges.select("a", "b").limit(0)
    while not left.isEmpty():
        ends = left.select("p", "h", "a", "b", "q").union(left.select("q", "h", "a", "b", "p"))
        taken = ends.groupBy(F.col("p").alias("id")).agg(F.min(F.struct("h", "a", "b", "q")).alias("e")).select("id", F.col("e.q").alias("up"), "e.a", "e.b")
        back = taken.select(F.col("id").alias("up"), F.col("up").alias("back"))
        root = (F.col("back") == F.col("id")) & (F.col("id") < F.col("up"))
        links = stored(taken.join(back, "up").select("id", F.when(root, F.col("id")).otherwise(F.col("up")).alias("up"), "a", "b"), "links")
        joined = links.filter("id <> up").select("a", "b")
        while True:
            far = _followed(links.select("id", F.col("up").alias("near")), "near", links, 3)
            ends = links.filter("id = up").select(F.col("id").alias("near"), F.lit(True).alias("ended"))
            links = stored(far.join(ends, "near", "left").select("id", F.col("near").alias("up"), F.col("ended").isNotNull().alias("ended")), "links")
            if links.filter("not ended").isEmpty():
                break
        left = stored(_followed(_followed(left, "p", links, 1), "q", links, 1).filter("p <> q"), "left")
        nodes, forest = _followed(nodes, "component", links, 1), forest.union(joined)
    return stored(forest, "forest"), stored(nodes.select("id", "component"), "parts")


def tour(tree: DataFrame, labels: DataFrame, roots: DataFrame, longest: int) -> DataFrame:
    """Arcs of an Euler tour of every tree, ``(u, v, left, x, y)``: arcs to come, and the labels' exclusive or over these, itself included.

    ``labels``: ``(node, x, y)``, ``roots``: ``(node)``. An arc is followed by that to the next neighbour of its head; the last one
    into a root by none. A node's label is carried by one of the arcs into it. Positions come from pointer jumping: every
    arc takes in the next three that it points at, so that the distance grows four times in each round, until it reaches the
    ``longest`` tour. An arc that has reached the end points at a negative number of its own, so that no key collects them.
    """
    arcs = stored(numbered(tree.select(F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("b", "a")), "at", "u", "v"), "arcs")  # around each node
    first = arcs.groupBy("u").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min("v").alias("bearer"))
    back = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("at").alias("back")).join(first.withColumnRenamed("u", "v"), "v")
    root = roots.select(F.col("node").alias("v"), F.lit(True).alias("root"))
    ahead = F.when(F.col("back") < F.col("high"), F.col("back") + 1).when(F.col("root").isNull(), F.col("low")).otherwise(-1 - F.col("at"))
    here = arcs.join(back, ["u", "v"]).join(root, "v", "left").join(labels.withColumnRenamed("node", "v"), "v", "left")
    zero = F.lit(0).cast("long")
    own = lambda c: F.when(F.col("u") == F.col("bearer"), F.coalesce(c, zero)).otherwise(zero)
    s = stored(here.select("at", ahead.alias("next"), F.lit(1).cast("long").alias("left"), own("x").alias("x"), own("y").alias("y")), "tour")
    reach = 1
    while reach < longest:
        to = s.select(F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("left").alias("more"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        sums = {"left": F.col("left") + F.coalesce("more", zero), "x": F.col("x").bitwiseXOR(F.coalesce("x2", zero)), "y": F.col("y").bitwiseXOR(F.coalesce("y2", zero)), "next": F.coalesce("beyond", "next")}
        for _ in range(3):
            s = s.join(to, "next", "left").withColumns(sums).select("at", "next", "left", "x", "y")
        s, reach = stored(s, "tour"), reach * 4
    return arcs.join(s.drop("next"), "at").drop("at")


def bridges(edges: DataFrame) -> DataFrame:
    """``(a, b, small, large)`` for every bridge: its ends and the sizes of the two sides.

    Every edge outside a spanning forest gets a random label of 128 bits; a tree edge's label is that of all cycles over it,
    the exclusive or of the labels at the nodes below it. A tree edge of label 0 is on no cycle (wrong with probability
    2^-128 an edge). What lies below an edge lies between its two arcs on an Euler tour, so labels and sizes are
    differences of two positions. Rounds grow with the logarithm of the graph's size, whatever its depth; a hub's edges are numbered
    by ranges, and nothing is held whole in a task. The tables of the rounds are deleted when the bridges are known.
    """
    with scratch(edges.sparkSession):
        one = stored(edges.select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).filter("a < b").distinct(), "edges")
        tree, parts = spanning_forest(one)
        rest = one.join(tree, ["a", "b"], "left_anti").select("a", "b", F.xxhash64("a", "b", F.lit(11)).alias("x"), F.xxhash64("a", "b", F.lit(23)).alias("y"))
        labels = rest.select(F.col("a").alias("node"), "x", "y").union(rest.select("b", "x", "y")).groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        whole = stored(parts.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("node")), "whole")
        most = whole.agg(F.max("n")).first()[0] or 0
        arcs = tour(tree, labels, whole.select("node"), 2 * most)
        up = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("left").alias("l2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        below = arcs.join(up, ["u", "v"]).filter("left > l2 and x = x2 and y = y2")
        found = below.join(parts, F.col("u") == F.col("id")).join(whole, "component").withColumn("size", F.expr("(left - l2 + 1) div 2"))
        other = F.col("n") - F.col("size")
        return cut(found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.least("size", other).alias("small"), F.greatest("size", other).alias("large")))
