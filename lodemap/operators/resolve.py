"""The unique-candidate join: a reference is resolved only where there is one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_counts(pairs: DataFrame) -> DataFrame:
    """For each src of pairs (src, cand, src_repo, cand_repo): distinct candidates and the smallest, in its own repo and anywhere."""
    local = F.when(F.col("cand_repo") == F.col("src_repo"), F.col("cand"))
    return pairs.groupBy("src").agg(
        F.count_distinct(local).alias("local"), F.min(local).alias("local_first"), F.count_distinct("cand").alias("all"), F.min("cand").alias("first"))


def unique_candidate(pairs: DataFrame) -> DataFrame:
    """(src, target): the one candidate in the own repo; if there is none there, the one anywhere; else null.

    Several candidates in the own repo leave the reference open, whatever is elsewhere. There is one where the smallest is
    the largest, so no candidates are told apart: a reference is four values, put together in parts before the shuffle.
    """
    local = F.when(F.col("cand_repo") == F.col("src_repo"), F.col("cand"))
    ends = pairs.groupBy("src").agg(F.min(local).alias("local_first"), F.max(local).alias("local_last"), F.min("cand").alias("first"), F.max("cand").alias("last"))
    target = F.when(F.col("local_first") == F.col("local_last"), F.col("local_first")).when(F.col("local_first").isNull() & (F.col("first") == F.col("last")), F.col("first"))
    return ends.select("src", target.alias("target"))


def ambiguous(pairs: DataFrame) -> DataFrame:
    """(src, candidates): references that stay open because there is more than one answer."""
    n = F.when(F.col("local") > 0, F.col("local")).otherwise(F.col("all"))
    return candidate_counts(pairs).select("src", n.alias("candidates")).where("candidates > 1")


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst) of edges (src, dst) followed by edges (src, dst), each once."""
    return first.select("src", F.col("dst").alias("via")).distinct().join(second.select(F.col("src").alias("via"), "dst").distinct(), "via").select("src", "dst").distinct()


def same_channel(uses: DataFrame) -> DataFrame:
    """(repo_a, repo_b, channels): pairs of repositories that use the same channels, of uses (repo, channel).

    Uses are made distinct first; a pair is there once, the smaller name first.
    """
    uses = uses.select("repo", "channel").where("repo is not null and channel is not null").distinct()
    a, b = uses.withColumnRenamed("repo", "repo_a"), uses.withColumnRenamed("repo", "repo_b")
    return a.join(b, "channel").where("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(F.count("*").alias("channels"))
