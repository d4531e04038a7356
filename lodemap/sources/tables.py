"""Graph roles of the star-schema tables, for queries that an independent engine can check.

Repository: nation. File: customer. Request: orders. Route: part. Candidate link: lineitem, with the return flag as
trust. External system: supplier. Session: a user's events. Decision line: a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.operators.traverse import task_parts


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trust(flag: Column) -> Column:
    """A -> VALIDATED, N -> SUGGESTED, R -> REJECTED; anything else is not known."""
    return F.when(flag == "A", "VALIDATED").when(flag == "N", "SUGGESTED").when(flag == "R", "REJECTED")


def files(spark, sf_dir: str) -> DataFrame:
    """(id, repo): customers in their nations."""
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("repo"))
    return customer.join(nation, "c_nationkey").select("id", "repo")


def requests(spark, sf_dir: str) -> DataFrame:
    """(id, repo): orders in the nation of their customer."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("id"))
    return orders.join(files(spark, sf_dir), "id").select(F.col("key").alias("id"), "repo")


def candidates(spark, sf_dir: str) -> DataFrame:
    """(request_id, route, trust_status)"""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("route"), trust(F.col("l_returnflag")).alias("trust_status"))


def supplier_pairs(spark, sf_dir: str) -> DataFrame:
    """(src, cand, src_repo, cand_repo): orders with the suppliers of their lines, in parts by src that do not grow with the tables."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), "o_custkey")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src_repo"))
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("cand"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cand"), F.col("s_nationkey").alias("cand_repo"))
    n = task_parts(spark, line.count())
    return line.join(supplier, "cand").repartition(n, "src").join(orders.join(customer, "o_custkey").repartition(n, "src"), "src").select("src", "cand", "src_repo", "cand_repo")


def edges(spark, sf_dir: str) -> DataFrame:
    """(src, dst, type, trust_status) of all roles; nodes are named by a letter and a key."""
    name = lambda letter, col: F.concat(F.lit(f"{letter}:"), F.col(col).cast("string"))
    none = F.lit(None).cast("string").alias("trust_status")
    customer, orders, line = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    return (
        customer.select(name("R", "c_nationkey").alias("src"), name("F", "c_custkey").alias("dst"), F.lit("CONTAINS").alias("type"), none)
        .unionByName(orders.select(name("F", "o_custkey").alias("src"), name("Q", "o_orderkey").alias("dst"), F.lit("MAKES_REQUEST").alias("type"), none))
        .unionByName(line.select(name("Q", "l_orderkey").alias("src"), name("P", "l_partkey").alias("dst"), F.lit("TARGETS_ROUTE").alias("type"), trust(F.col("l_returnflag")).alias("trust_status")))
        .unionByName(line.select(name("P", "l_partkey").alias("src"), name("S", "l_suppkey").alias("dst"), F.lit("USES_SYSTEM").alias("type"), none))
    )


def nodes(spark, sf_dir: str) -> DataFrame:
    """(id, label, name, repo); repo is null for what belongs to none."""
    none = F.lit(None).cast("string").alias("repo")
    nation, part, supplier = (read(spark, sf_dir, t) for t in ("nation", "part", "supplier"))
    key = lambda letter, col: F.concat(F.lit(f"{letter}:"), F.col(col).cast("string")).alias("id")
    owned = lambda df, letter, label, prefix: df.select(key(letter, "id"), F.lit(label).alias("label"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("name"), "repo")
    return (
        nation.select(key("R", "n_nationkey"), F.lit("Repository").alias("label"), F.col("n_name").alias("name"), F.col("n_name").alias("repo"))
        .unionByName(owned(files(spark, sf_dir), "F", "CodeFile", "file-"))
        .unionByName(owned(requests(spark, sf_dir), "Q", "APIEndpoint", "request-"))
        .unionByName(part.select(key("P", "p_partkey"), F.lit("BackendRoute").alias("label"), F.col("p_name").alias("name"), none))
        .unionByName(supplier.select(key("S", "s_suppkey"), F.lit("ExternalSystem").alias("label"), F.col("s_name").alias("name"), none))
    )
