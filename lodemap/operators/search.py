"""Search and seeds: top-k by a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 50


def search(nodes: DataFrame, term: str, limit: int = MOST) -> DataFrame:
    """Nodes (id, label, name) whose name has the term, case aside; the first by name and id, at most 50."""
    hit = F.contains(F.lower("name"), F.lit(term.lower()))
    return nodes.where(hit).orderBy("name", "id").limit(max(1, min(limit, MOST)))


def best_match(candidates: DataFrame) -> DataFrame:
    """Of candidates (key, id, score) the best of each key: the largest score, then the smallest id."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return candidates.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
