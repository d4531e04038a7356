"""Stitching requests to routes; every match is a suggestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.operators.trust import SUGGESTED

CATCH_ALL = "[..."


def _suggested(pairs: DataFrame, resolution: str) -> DataFrame:
    return pairs.select("request_id", "route_id", F.lit(SUGGESTED).alias("trust_status"), F.lit(resolution).alias("resolution")).distinct()


def exact(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests (request_id, method, path) and routes (route_id, method, path) of equal method and path."""
    return _suggested(requests.join(routes, ["method", "path"]), "exact")


def catch_all(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests below the prefix of a catch-all route of the same repo and method.

    The prefix is what stands before the catch-all part. A request meets the routes by the folders of its own path, one for
    each slash, and no others; a prefix that ends inside a segment is looked up by the folder before it, then compared.
    """
    open_ = routes.where(F.instr("route_path", CATCH_ALL) > 0).withColumn("prefix", F.expr(f"substring(route_path, 1, instr(route_path, '{CATCH_ALL}') - 1)"))
    open_ = open_.withColumn("prefix", F.regexp_replace("prefix", r"\[$", "")).select("route_id", "repo", "method", "prefix", F.regexp_extract("prefix", "^(?:.*/)?", 0).alias("folder"))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))
    met = requests.where("path is not null").select("request_id", "repo", "method", "path", F.explode(folders).alias("folder")).join(open_, ["repo", "method", "folder"])
    return _suggested(met.where(F.col("path").startswith(F.col("prefix"))).select("request_id", "route_id"), "catch-all")


def stitched(*links: DataFrame) -> DataFrame:
    """(stitched): how many links the given ways of stitching found together; a pair that two ways found counts for both."""
    return reduce(DataFrame.unionByName, [x.groupBy().agg(F.count("*").alias("stitched")) for x in links]).agg(F.sum("stitched").alias("stitched"))


def configured_prefix(requests: DataFrame, mappings: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests to a configured system: its path prefix before their path meets routes of its repo (any, if null).

    requests (request_id, repo, system, method, path), mappings (repo, system, path_prefix, target_repo),
    routes (route_id, repo, method, path).
    """
    placed = requests.join(mappings, ["repo", "system"]).select("request_id", "method", F.concat("path_prefix", "path").alias("path"), "target_repo")
    found = placed.join(routes, ["method", "path"]).where(F.col("target_repo").isNull() | (F.col("target_repo") == F.col("repo")))
    return _suggested(found, "configured-prefix")
