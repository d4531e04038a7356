"""Trust of links: only VALIDATED counts, and what is not known is not validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVED, SUGGESTED, VALIDATED, REJECTED, STALE = "OBSERVED", "SUGGESTED", "VALIDATED", "REJECTED", "STALE"
ROUTE_LINK = "TARGETS_ROUTE"


def validated(trust: Column) -> Column:
    """True for VALIDATED alone; null is false."""
    return trust.eqNullSafe(F.lit(VALIDATED))


def traversable(edges: DataFrame) -> DataFrame:
    """Edges that a traversal may follow by default: all but route links without validation."""
    return edges.where((F.col("type") != ROUTE_LINK) | validated(F.col("trust_status")))


def status_counts(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(repo, trust_status, links) of candidates (request_id, trust_status) by the repository of their request (id, repo)."""
    return candidates.join(requests.select(F.col("id").alias("request_id"), "repo"), "request_id").groupBy("repo", "trust_status").agg(F.count("*").alias("links"))
