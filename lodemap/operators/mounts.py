"""Routes of router groups, under the paths that their groups are mounted at, across functions and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.operators.closure import composed

#: Kinds of facts that `mounted` reads.
KINDS = ("route", "group", "function", "module", "import", "mount")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _node(repo: str, folder: str, function: str, name: str) -> Column:
    """A variable of a function of a package."""
    return F.concat_ws("\x1f", repo, folder, F.coalesce(function, F.lit("")), name)


def mount_edges(facts: DataFrame) -> DataFrame:
    """(src, dst, label): from a group's parent to the group, with its path, and from an argument to the parameter of the function that it is handed to.

    A function of the same package is known by its name, one of an imported package by the import's last part or alias;
    the folder of an import is what follows the path of the module of a go.mod. A name that several functions of a package
    have, or none, hands nothing on.
    """
    go = facts.where("suffix in ('go', 'mod')").withColumn("folder", _folder(F.col("path")))
    groups = go.where("kind = 'group'").select(_node("repo", "folder", "function", "argument").alias("src"), _node("repo", "folder", "function", "name").alias("dst"), F.col("url").alias("label"))
    functions = go.where("kind = 'function'").select("repo", "folder", "name", F.split("detail", r"\s*,\s*").alias("parameters"))
    functions = functions.groupBy("repo", "folder", "name").agg(F.count("*").alias("n"), F.first("parameters").alias("parameters")).where("n = 1").drop("n")
    modules = go.where("kind = 'module'").select("repo", F.col("name").alias("module"), F.col("folder").alias("top")).distinct()
    imported = go.where("kind = 'import'").select("repo", "path", F.coalesce("argument", F.substring_index("name", "/", -1)).alias("alias"), "name").join(modules, "repo")
    imported = imported.where((F.col("name") == F.col("module")) | F.col("name").startswith(F.concat("module", F.lit("/"))))
    inner = F.expr("substring(name, length(module) + 2)")
    imported = imported.select("repo", "path", F.col("alias").alias("detail"), F.concat_ws("/", F.nullif("top", F.lit("")), F.nullif(inner, F.lit(""))).alias("there")).distinct()
    handed = go.where("kind = 'mount'").select("repo", "path", "folder", "function", "argument", "name", "detail", F.col("method").cast("int").alias("place"))
    handed = handed.join(imported, ["repo", "path", "detail"], "left").where("detail is null or there is not null")
    handed = handed.withColumn("there", F.when(F.col("detail").isNull(), F.col("folder")).otherwise(F.col("there")))
    target = functions.select("repo", F.col("folder").alias("there"), "name", "parameters")
    parameter = F.regexp_extract(F.get("parameters", F.col("place")), r"^\s*(\w+)", 1)
    # Only a router group is handed on; other arguments are no mounts.
    handed = handed.join(target, ["repo", "there", "name"]).where(F.get("parameters", F.col("place")).rlike(r"\bgin\.(?:RouterGroup|IRouter|IRoutes|Engine)\b"))
    passed = handed.select(_node("repo", "folder", "function", "argument").alias("src"), F.concat_ws("\x1f", "repo", "there", "name", parameter).alias("dst"), F.lit("").alias("label"))
    return groups.unionByName(passed).distinct()


def mounted(facts: DataFrame) -> DataFrame:
    """`facts` with each Go route under every path that its group is mounted at: a row for each.

    A router that nothing mounts has no path before its own, and so has a group in a cycle that nothing leads into.
    """
    from lodemap.operators.extract import _addressed

    edges = mount_edges(facts)
    tops = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    go = F.coalesce((F.col("kind") == "route") & (F.col("suffix") == "go"), F.lit(False))
    routes = facts.where(go).withColumn("folder", _folder(F.col("path"))).withColumn("node", _node("repo", "folder", "function", "argument"))
    paths = composed(tops.select("node", F.lit("").alias("label")), edges, routes).withColumnRenamed("label", "before")
    url = F.concat(F.coalesce("before", F.lit("")), "url")
    done = routes.join(paths, "node", "left").withColumn("url", F.when(url == "", "/").otherwise(url)).select(*facts.columns)
    return _addressed(done.unionByName(facts.where(~go)), F.col("system"))  # other facts are not moved
