"""Reports on requests: how many have candidates, how many are resolved, which are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.operators.trust import validated

MOST_UNRESOLVED = 500


def overview(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each repo: requests, with candidates, resolved (a VALIDATED one), unresolved, and coverage in percent.

    requests (id, repo), candidates (request_id, trust_status). Candidates are reduced to a row for each request
    before the join, so neither a request with many candidates nor a large repository makes a hot key.
    """
    best = candidates.groupBy(F.col("request_id").alias("id")).agg(F.max(validated(F.col("trust_status")).cast("int")).alias("ok"))
    rows = requests.select("id", "repo").join(best, "id", "left")
    found = rows.groupBy("repo").agg(F.count("*").alias("requests"), F.count("ok").alias("candidates"), F.coalesce(F.sum("ok"), F.lit(0)).alias("resolved"))
    return found.select(
        "repo", "requests", "candidates", "resolved", (F.col("requests") - F.col("resolved")).alias("unresolved"),
        F.round(F.lit(100.0) * F.col("resolved") / F.col("requests"), 1).alias("coverage"))


def unresolved(requests: DataFrame, candidates: DataFrame, limit: int = MOST_UNRESOLVED) -> DataFrame:
    """The first requests by id without a validated route, with the number of their candidates and the trust of them.

    A report: `limit` is held to 1 .. 500.
    """
    limit = max(1, min(limit, MOST_UNRESOLVED))
    open_ = requests.join(candidates.where(validated(F.col("trust_status"))).select(F.col("request_id").alias("id")), "id", "left_anti")
    evidence = candidates.groupBy(F.col("request_id").alias("id")).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("trust_status") == "SUGGESTED").alias("suggested"), F.count_if(F.col("trust_status") == "REJECTED").alias("rejected"))
    zero = F.lit(0).cast("long")
    return open_.join(evidence, "id", "left").select(
        "id", "repo", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("suggested", zero).alias("suggested"), F.coalesce("rejected", zero).alias("rejected")
    ).orderBy("id").limit(limit)


def evidence(requests: DataFrame, candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, repo, candidate_route, candidate_repo, candidate_trust): each request without a validated route with each of its candidates.

    candidates (request_id, route, trust_status), routes (route, repo). A request without candidates has one row of nulls.
    """
    done = candidates.where(validated(F.col("trust_status"))).select(F.col("request_id").alias("id")).distinct()
    found = candidates.join(routes.select("route", F.col("repo").alias("candidate_repo")), "route", "left").select(
        F.col("request_id").alias("id"), F.col("route").alias("candidate_route"), "candidate_repo", F.col("trust_status").alias("candidate_trust")).distinct()
    return requests.select("id", "repo").join(done, "id", "left_anti").join(found, "id", "left").select("id", "repo", "candidate_route", "candidate_repo", "candidate_trust")


def request_warning(requests: DataFrame, candidates: DataFrame, shown: int = 3) -> DataFrame:
    """(repo, unresolved, requests, message) of repositories with requests (id, repo, label) that have no validated route.

    The message names the first `shown` by id, a feature of the report; all are counted. The first are kept by a top-k of
    each task before the shuffle, so no repository's requests are gathered.
    """
    done = candidates.where(validated(F.col("trust_status"))).select(F.col("request_id").alias("id"), F.lit(True).alias("ok")).distinct()
    rows = requests.join(done, "id", "left")
    counts = rows.groupBy("repo").agg(F.count_if(F.col("ok").isNull()).alias("unresolved"), F.count("*").alias("requests")).where("unresolved > 0")
    place = Window.partitionBy("repo").orderBy("id")
    first = rows.where("ok is null").withColumn("n", F.row_number().over(place)).where(F.col("n") <= shown)
    first = first.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), "; ").alias("first"))
    # Fixed value: the sentence of the warning.
    text = F.concat(F.col("unresolved").cast("string"), F.lit(" of "), F.col("requests").cast("string"), F.lit(" API requests do not have a validated backend route: "), "first",
                    F.when(F.col("unresolved") > shown, F.concat(F.lit("; +"), (F.col("unresolved") - shown).cast("string"), F.lit(" more."))).otherwise("."))
    return counts.join(first, "repo").select("repo", "unresolved", "requests", text.alias("message"))


def start_warning(starts: DataFrame) -> DataFrame:
    """(repo, keys): process keys of starts (repo, process_key, target) of repositories none of whose starts has a target, in order."""
    found = starts.groupBy("repo").agg(F.count("target").alias("n"), F.array_sort(F.collect_set("process_key")).alias("keys"))
    return found.where("n = 0").select("repo", F.array_join("keys", ", ").alias("keys"))


def trace_stats(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(nodes, links, alternatives) of a trace: nodes reached (node), links between them of edges (src, dst, type, condition), each once, and how many of them depend on a condition."""
    nodes = reached.select("node").distinct()
    near = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "type", "condition").distinct()
    links = near.agg(F.count("*").alias("links"), F.count("condition").alias("alternatives"))
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(links)).select("nodes", "links", "alternatives")  # one row each
