"""Decision lineage: what supersedes what, and what holds now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.operators.closure import roots
from lodemap.operators.traverse import shared, task_parts


def lineage(steps: DataFrame) -> DataFrame:
    """(line, step, root, depth) of steps (line, step): a step supersedes the one numbered one below it.

    root: the first of the unbroken run; depth: how many it supersedes in turn. Runs are found by a window over a
    line's steps, so chains of any length need one shuffle and no recursion.
    """
    rows = steps.select("line", "step").distinct()
    place = F.row_number().over(Window.partitionBy("line").orderBy("step"))
    run = Window.partitionBy("line", "run")
    rows = rows.withColumn("run", F.col("step") - place)
    root = F.min("step").over(run)
    return rows.select("line", "step", root.alias("root"), (F.col("step") - root).alias("depth"))


def active(steps: DataFrame) -> DataFrame:
    """The last step of each line with its author, and the step before it: (line, step, author, superseded)."""
    last = steps.groupBy("line").agg(F.max(F.struct("step", "author")).alias("x"), F.count("*").alias("n"))
    return last.select("line", "x.step", "x.author", (F.col("n") - 1).alias("superseded"))


def chains(decisions: DataFrame) -> DataFrame:
    """(id, root, depth, active) of decisions (id, supersedes): the first decision of its chain, how many it supersedes in turn, and whether none supersedes it.

    Links may lead anywhere. A decision that several supersede is the fork of several chains; those of a circle, or before
    one, have no root. A superseded id that is no decision itself is a root.
    """
    rows = shared(decisions.select("id", "supersedes").where("id is not null").groupBy("id").agg(F.min("supersedes").alias("supersedes")))
    n = task_parts(rows.sparkSession, rows.count())
    found = roots(rows.select(F.col("id").alias("node"), F.col("supersedes").alias("next"))).withColumnRenamed("node", "id")
    over = rows.where("supersedes is not null").select(F.col("supersedes").alias("id")).repartition(n, "id").distinct().withColumn("over", F.lit(True))
    # Every id has its row in found; ids that are only superseded have none here.
    return rows.select("id").repartition(n, "id").join(found.repartition(n, "id"), "id").join(over, "id", "left").select("id", "root", "depth", F.col("over").isNull().alias("active"))


def context(decisions: DataFrame, affects: DataFrame) -> DataFrame:
    """(id, title, superseded, files) of decisions (id, title, supersedes) that none supersedes: the title of what it supersedes and the files that it affects (id, path), in order."""
    over = decisions.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    old = decisions.select(F.col("id").alias("supersedes"), F.col("title").alias("superseded"))
    files = affects.where("path is not null").groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    none = F.array().cast("array<string>")
    return decisions.join(over, "id", "left_anti").join(old, "supersedes", "left").join(files, "id", "left").select("id", "title", "superseded", F.coalesce("files", none).alias("files"))
