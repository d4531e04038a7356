"""Regular path queries: which nodes typed paths lead to, and by which path.

A pattern is an automaton over edge types. The search goes breadth first through pairs of a node and a state, from all
seeds at once, and keeps for every pair the first of its shortest paths, so a report has its steps in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.operators.traverse import shared

#: (state, edge type, whether it is followed from src to dst, next state); state 0 is the start.
INSPECTION = [(0, "MAKES_REQUEST", True, 1), (1, "TARGETS_ROUTE", True, 2), (2, "HANDLED_BY", True, 3), (2, "USES_SYSTEM", True, 4), (3, "USES_SYSTEM", True, 4)]
#: A process: its steps in order, the classes that they invoke, and the processes that they call.
PROCESS = [(0, "HAS_STEP", True, 1), (1, "NEXT", True, 1), (1, "INVOKES", True, 2), (1, "CALLS", True, 0)]


def typed_paths(edges: DataFrame, seeds: DataFrame, pattern: list[tuple[int, str, bool, int]], depth: int) -> DataFrame:
    """(seed, node, state, distance, path) of edges (src, dst, type): what paths of the pattern from seeds (node) lead to in `depth` steps or fewer.

    path holds type and node of each step. A pair of node and state is found once for a seed, by a shortest path, of
    several the first by its steps. Cycles end, as a pair is not visited again; repeated edges and seeds count once; null
    ends lead nowhere. Steps are equi-joins of the frontier with the edges on node and type; the pattern's few rows are
    broadcast. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    rules = F.broadcast(spark.createDataFrame(pattern, "state int, type string, forward boolean, next int"))
    whole = edges.where("src is not null and dst is not null").select("src", "dst", "type").distinct()
    types = sorted({t for _, t, _, _ in pattern})
    both = whole.where(F.col("type").isin(types)).select(F.col("src").alias("node"), "type", F.lit(True).alias("forward"), F.col("dst").alias("to"))
    if any(not forward for _, _, forward, _ in pattern):
        both = both.unionByName(whole.where(F.col("type").isin(types)).select(F.col("dst").alias("node"), "type", F.lit(False).alias("forward"), F.col("src").alias("to")))
    both = shared(both)
    none = F.array().cast("array<struct<type:string,node:string>>")
    start = seeds.where("node is not null").select("node").distinct()
    frontier = visited = shared(start.select(F.col("node").alias("seed"), "node", F.lit(0).alias("state"), F.lit(0).alias("distance"), none.alias("path")))
    for step in range(1, depth + 1):
        if frontier.isEmpty():
            break
        met = frontier.join(rules, "state").join(both, ["node", "type", "forward"])
        found = met.select("seed", F.col("to").alias("node"), F.col("next").alias("state"), F.concat("path", F.array(F.struct("type", F.col("to").alias("node")))).alias("path"))
        fresh = found.groupBy("seed", "node", "state").agg(F.min("path").alias("path")).join(visited.select("seed", "node", "state"), ["seed", "node", "state"], "left_anti")
        frontier = shared(fresh.select("seed", "node", "state", F.lit(step).alias("distance"), "path"))
        visited = visited.unionByName(frontier)
    return visited


def written_out(paths: DataFrame) -> DataFrame:
    """The same with path as a text: type>node for each step."""
    steps = F.array_join(F.transform("path", lambda s: F.concat(s["type"], F.lit(">"), s["node"])), " ")
    return paths.withColumn("path", steps)
