"""Closures of links: roots by pointer doubling, and labels composed along paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.operators.traverse import shared, task_parts


def roots(links: DataFrame) -> DataFrame:
    """(node, root, depth): where the links (node, next) of each node lead, and in how many steps; root and depth are null where they lead into a cycle.

    A node has one next at most (the smallest of several is taken); a node that only stands as a next is its own root at
    depth 0, and so is one whose next is null. By pointer doubling: in every round each open node takes over where its target
    has got to, so a chain of n links needs log2(n) rounds. Open nodes of a round that closes none lie in or before a cycle.
    Each round is written to the shared folder. Open nodes that share a target meet its one row, and done ones do not move.
    """
    links = shared(links.where("node is not null").groupBy("node").agg(F.min("next").alias("next")))
    n = task_parts(links.sparkSession, links.count())
    heads = links.where("next is not null").select(F.col("next").alias("node")).repartition(n, "node").distinct().join(links.select("node").repartition(n, "node"), "node", "left_anti")
    zero = F.lit(0).cast("long")
    ends = heads.unionByName(links.where("next is null").select("node")).select("node", F.col("node").alias("root"), zero.alias("depth"))
    state = shared(ends.select("node", F.col("root").alias("target"), "depth", F.lit(True).alias("done")).unionByName(links.where("next is not null").select("node", F.col("next").alias("target"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"))))
    parts, open_, before = [state.where("done")], state.where("not done"), -1
    while (left := open_.count()) and left != before:
        before = left
        there = state.select(F.col("node").alias("target"), F.col("target").alias("further"), F.col("depth").alias("more"), F.col("done").alias("reached"))
        state_open = shared(open_.repartition(n, "target").join(there.repartition(n, "target"), "target").select("node", F.col("further").alias("target"), (F.col("depth") + F.col("more")).alias("depth"), F.col("reached").alias("done")))
        parts.append(state_open.where("done"))
        open_ = state_open.where("not done")
        state = parts[0]
        for part in parts[1:]:
            state = state.unionByName(part)
        state = state.unionByName(open_)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    lost = open_.select("node", F.lit(None).cast(links.schema["next"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"))
    return found.select("node", F.col("target").alias("root"), "depth").unionByName(lost)


def _circular(edges: DataFrame) -> DataFrame:
    """(node) of hashed nodes: all that stand on a cycle of edges (src, dst), and perhaps some between cycles.

    Edges that nothing leads into or out of are taken off until none is left. Nodes are hashes, so few bytes move; two nodes
    of one hash can only keep edges in.
    """
    left, before = shared(edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")).distinct()), -1
    while (n := left.count()) and n != before:
        before = n
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = shared(inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    return left.select(F.col("dst").alias("node")).distinct()


def composed(starts: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(node, label): the labels of all paths from starts (node, label) along edges (src, dst, label), put one after another; each once.

    Semi-naive: a round extends only what the last one found. A path does not come back to a node that it has passed, so
    cycles end, and a node that is reached in several ways has several labels. Repeated edges count once. Of the nodes passed
    only those are carried that may lie on a cycle. A round moves its labels once, to their nodes, where they are made
    distinct and extended, and is written to the shared folder. With `wanted` (node) only labels of these nodes are returned.
    """
    edges = shared(edges.where("src is not null and dst is not null").select("src", "dst", F.coalesce("label", F.lit("")).alias("step")).distinct())
    own = F.array("node")
    if (circular := _circular(edges)).isEmpty():
        own, edges = F.array().cast("array<string>"), edges.withColumn("turns", F.lit(False))
    else:
        edges = shared(edges.withColumn("node", F.xxhash64("dst")).join(circular.withColumn("turns", F.lit(True)), "node", "left").select("src", "dst", "step", F.coalesce("turns", F.lit(False)).alias("turns")))
    fresh = shared(starts.where("node is not null").select("node", F.coalesce("label", F.lit("")).alias("label"), own.alias("passed")))
    parts = []
    while not fresh.isEmpty():
        parts.append(fresh)
        here = fresh.repartition("node").distinct()
        steps = here.join(edges, here["node"] == edges["src"]).where(~(F.col("turns") & F.array_contains("passed", F.col("dst"))))
        passed = F.when(F.col("turns"), F.concat("passed", F.array("dst"))).otherwise(F.col("passed"))
        fresh = shared(steps.select(F.col("dst").alias("node"), F.concat("label", "step").alias("label"), passed.alias("passed")))
    found = fresh.select("node", "label")
    for part in parts:
        found = found.unionByName(part.select("node", "label"))
    found = found.repartition("node")
    return (found if wanted is None else found.join(wanted.select("node").distinct(), "node", "left_semi")).distinct()
