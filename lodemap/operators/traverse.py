"""Bounded traversal of edges (src, dst, type)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A frontier of so many nodes at most is broadcast; a larger one meets the edges by a shuffle.
BROADCAST_NODES = 100_000


#: Rows that a task of a join sorts, so that its memory does not grow with the table.
TASK_ROWS = 500_000


def task_parts(spark, rows: int) -> int:
    """Partitions of a join over so many rows: the session's number, more where a task would have over `TASK_ROWS`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def shared_path(spark, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary folder only where all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodemap-')}"
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


def shared(df: DataFrame) -> DataFrame:
    """`df` written to the folder that driver and executors share, and read again."""
    path = shared_path(df.sparkSession, "frontier")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """(node, distance): nodes within `depth` steps of seeds (node), by the fewest steps; with `both`, edges go either way.

    The ends of the edges are written once. Each step joins them with the frontier, without what was visited; a small
    frontier is broadcast, so the edges are read and not moved. A frontier is written to the shared folder, so plans stay
    short and a lost executor repeats one step. Cycles end at visited nodes; edges and seeds may be repeated, and a null
    end leads nowhere.
    """
    links = shared(edges.select("src", "dst"))
    visited = frontier = shared(seeds.where("node is not null").select("node").distinct().withColumn("distance", F.lit(0)))
    for step in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        ends = F.broadcast(frontier.select("node")) if n <= BROADCAST_NODES else frontier.select("node")
        near = links.join(ends, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))
        if both:
            near = near.union(links.join(ends, F.col("dst") == F.col("node"), "left_semi").select("src"))
        near = near.where("node is not null").distinct()
        frontier = shared(near.join(visited, "node", "left_anti").withColumn("distance", F.lit(step)))
        visited = visited.unionByName(frontier)
    return visited


def two_hops(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within at most two undirected steps of the seeds, the seeds included; `depth` is held to 0 .. 2."""
    return reach(edges, seeds, max(0, min(depth, 2)), both=True)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, direction, type, other): the edges at nodes (node), seen from them."""
    ends = nodes.select("node").distinct()
    out = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    back = edges.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    return out.union(back).distinct()


def hotspots(edges: DataFrame, limit: int = 20) -> DataFrame:
    """(node, degree): the nodes with most edges, ties by name; a report of `limit` rows."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(limit)


def lanes(nodes: DataFrame, lane_of_label: DataFrame) -> DataFrame:
    """(lane, nodes): how many nodes (node, label) each lane (label, lane) has; labels without a lane are `Other`."""
    return nodes.join(lane_of_label, "label", "left").groupBy(F.coalesce("lane", F.lit("Other")).alias("lane")).agg(F.count("*").alias("nodes"))


def trace(edges: DataFrame, reached: DataFrame, path_limit: int) -> DataFrame:
    """(distance, src, dst, type, total, truncated): edges with both ends among reached (node, distance), nearest first, at most `path_limit`.

    total counts all of them, so a report says what it leaves out. Ties go by src, dst and type.
    """
    near = edges.join(reached.select(F.col("node").alias("src"), "distance"), "src").join(reached.select(F.col("node").alias("dst")), "dst", "left_semi").select("distance", "src", "dst", "type").distinct()
    total = near.agg(F.count("*").alias("total"))
    first = near.orderBy("distance", "src", "dst", "type").limit(max(1, path_limit))
    return first.join(F.broadcast(total)).withColumn("truncated", F.col("total") > max(1, path_limit))  # one row beside each


def reached_systems(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(system, distance, uses): external systems used by reached (node, distance), the fewest steps to one that uses it, and how many do."""
    used = edges.where("type = 'USES_SYSTEM'").select(F.col("src").alias("node"), F.col("dst").alias("system")).distinct()
    return used.join(reached, "node").groupBy("system").agg((F.min("distance") + 1).alias("distance"), F.count("*").alias("uses"))
