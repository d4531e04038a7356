"""Incremental upkeep: what to prune, what to merge, which files refer to what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(stored: DataFrame, scanned: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows whose key is not among the scanned: to be pruned."""
    return stored.join(scanned.select(key).distinct(), key, "left_anti")


def merge(stored: DataFrame, changed: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows without what changed or was deleted, and the changed rows: what a full build would have."""
    gone = changed.select(key).union(deleted.select(key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(changed)


def referencing(references: DataFrame, changed: DataFrame) -> DataFrame:
    """Distinct file_id of references (file_id, identifier) to a changed identifier."""
    return references.join(changed.select("identifier").distinct(), "identifier", "left_semi").select("file_id").distinct()


def changes_of_diff(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) of a name-status diff (line): renames and copies carry the old path, scores are dropped."""
    parts = F.split("line", "\t")
    status = F.left(parts[0], F.lit(1))
    moved = status.isin("R", "C")
    return lines.where(F.length("line") > 0).select(status.alias("status"), F.when(moved, F.get(parts, F.lit(2))).otherwise(parts[1]).alias("path"), F.when(moved, parts[1]).alias("old_path"))
