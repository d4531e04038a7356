"""Relations between what files declare: calls, imports, channels, actions, workflow.

References are resolved by one row for each key, so a popular name multiplies nothing: candidates are counted for
each key and repository before they meet the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.functions import identity


def unique_target(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """References (repo, key and any other columns) with target: of candidates (key, repo, id) the one in the own repo, else the one anywhere, else null.

    Several candidates in the own repo leave a reference open. A null key has no target. There is one answer where the
    smallest candidate is the largest, so none are collected or sorted.
    """
    local = candidates.groupBy("repo", "key").agg(F.min("id").alias("local_first"), F.max("id").alias("local_last"), F.lit(True).alias("here"))
    every = local.groupBy("key").agg(F.min("local_first").alias("first"), F.max("local_last").alias("last"))
    target = F.when(F.col("local_first") == F.col("local_last"), F.col("local_first")).when(F.col("here").isNull() & (F.col("first") == F.col("last")), F.col("first"))
    return references.join(local, ["repo", "key"], "left").join(every, "key", "left").select(*references.columns, target.alias("target"))


def _function_id(name: str = "function") -> Column:
    return identity.member_id(F.col("file_id"), F.col(name))


def class_names(facts: DataFrame) -> DataFrame:
    """(repo, path, name, qualified, id) of classes; a class without a package is known by its name alone."""
    package = facts.where("kind = 'package'").groupBy("repo", "path").agg(F.min("name").alias("package"))
    classes = facts.where("kind = 'class'").select("repo", "path", "name", identity.member_id(F.col("file_id"), F.col("member")).alias("id")).distinct()
    return classes.join(package, ["repo", "path"], "left").select("repo", "path", "name", F.concat_ws(".", "package", "name").alias("qualified"), "id")


def identifiers(facts: DataFrame) -> DataFrame:
    """(file, identifiers): every name by which the classes of a file are known (name, qualified name, alias), by code points."""
    names = F.explode(F.array("name", "qualified", identity.alias(F.col("name"))))
    return class_names(facts).select(identity.file_id(F.col("repo"), F.col("path")).alias("file"), names.alias("known")).groupBy("file").agg(F.array_sort(F.collect_set("known")).alias("identifiers"))


def class_declarations(facts: DataFrame) -> DataFrame:
    """(file, repo, key, id) of classes by their qualified names."""
    return class_names(facts).select(identity.file_id(F.col("repo"), F.col("path")).alias("file"), "repo", F.col("qualified").alias("key"), "id")


def import_references(facts: DataFrame) -> DataFrame:
    """(file, repo, key, src) of imports: src is the file."""
    return facts.where("kind = 'import'").select(F.col("file_id").alias("file"), "repo", F.col("name").alias("key"), F.col("file_id").alias("src")).distinct()


def imports(facts: DataFrame) -> DataFrame:
    """(src, dst, repo): files to the classes that they import, by the exact qualified name."""
    found = unique_target(import_references(facts).select("src", "repo", "key"), class_declarations(facts).select("key", "repo", "id"))
    return found.where("target is not null").select("src", F.col("target").alias("dst"), "repo")


def calls(facts: DataFrame) -> DataFrame:
    """(id, repo, function_id, target_type, target_method, condition, line, target): calls of a receiver whose type the file declares.

    The type of a receiver is that of a parameter or local of the function, else of a field; an import makes it
    qualified. target is the one function of that owner and name, by the rule of `unique_target`; several overloads
    leave it null. Calls of receivers without a declared type are no evidence and not returned.
    """
    fields = facts.where("kind = 'field'").select("repo", "path", "function", F.col("name").alias("receiver"), F.col("detail").alias("type"))
    each = F.explode(F.split(F.regexp_replace("detail", r"<[^>]*>|@\w+(?:\s*\([^)]*\))?|\bfinal\s", ""), r"\s*,\s*"))
    parameters = facts.where("kind = 'function' and detail is not null").select("repo", "path", F.col("member").alias("function"), each.alias("p"))
    parameters = parameters.select("repo", "path", "function", F.regexp_extract("p", r"(\w+)\s*$", 1).alias("receiver"), F.regexp_extract("p", r"^\s*(?:[\w.]*\.)?([A-Z]\w*)\s", 1).alias("type")).where("type <> ''")
    declared = fields.unionByName(parameters)
    one = lambda df, *keys: df.groupBy(*keys).agg(F.min("type").alias("t"), F.count_distinct("type").alias("n")).where("n = 1").drop("n")
    inner = one(declared.where("function is not null"), "repo", "path", "function", "receiver").withColumnRenamed("t", "inner")
    # A field that stands after a function is written below it: any declaration of the file will do if there is one type only.
    outer = one(declared, "repo", "path", "receiver").withColumnRenamed("t", "outer")
    found = facts.where("kind = 'call' and function is not null").select("repo", "path", "file_id", "line", "function", F.col("argument").alias("receiver"), F.col("name").alias("target_method"), "condition")
    found = found.join(inner, ["repo", "path", "function", "receiver"], "left").join(outer, ["repo", "path", "receiver"], "left").withColumn("type", F.coalesce("inner", "outer")).where("type is not null")
    named = facts.where("kind = 'import'").groupBy("repo", "path", F.substring_index("name", ".", -1).alias("type")).agg(F.min("name").alias("q"), F.count_distinct("name").alias("n")).where("n = 1")
    found = found.join(named.drop("n"), ["repo", "path", "type"], "left").withColumn("target_type", F.coalesce("q", "type"))
    site = identity.call_id(F.col("file_id"), F.col("line"), F.col("target_type"), F.col("target_method"))
    found = found.select(site.alias("id"), "repo", _function_id().alias("function_id"), "target_type", "target_method", "condition", "line").dropDuplicates(["id"])
    functions = facts.where("kind = 'function' and member like '%.%'").select("repo", "path", "name", F.substring_index("member", ".", 1).alias("owner"), _function_id("member").alias("id"))
    owners = class_names(facts).select("repo", "path", F.col("name").alias("owner"), F.explode(F.array_distinct(F.array("name", "qualified"))).alias("known"))
    there = functions.join(owners, ["repo", "path", "owner"]).select(F.concat_ws("#", "known", "name").alias("key"), "repo", "id").distinct()
    targets = unique_target(found.select(F.col("id").alias("src"), "repo", F.concat_ws("#", "target_type", "target_method").alias("key")), there)
    return found.join(targets.select(F.col("src").alias("id"), "target"), "id")


def channels(facts: DataFrame) -> DataFrame:
    """(src, dst, type, repo) of channels {repo}:channel:{broker}:{name}: PUBLISHES_TO, CONSUMED_BY, ROUTES_TO, and SAME_CHANNEL between repositories.

    A channel of many repositories is linked from the first of them (by name) to each other, a star and not all pairs.
    A name that is not known statically makes no channel.
    """
    id_ = lambda broker, name: F.concat_ws(":", "repo", F.lit("channel"), broker, name)
    uses = facts.where("kind in ('publish', 'consume') and name is not null")
    uses = uses.withColumn("channel", id_(F.col("detail"), F.col("name")))
    # A listener's annotation stands before its method, so the function is the one that follows.
    consumer = F.coalesce(F.col("listener"), F.col("function"))
    out = uses.where("kind = 'publish' and function is not null").select(_function_id().alias("src"), F.col("channel").alias("dst"), F.lit("PUBLISHES_TO").alias("type"), "repo")
    back = uses.where("kind = 'consume'").withColumn("to", consumer).where("to is not null").select(F.col("channel").alias("src"), _function_id("to").alias("dst"), F.lit("CONSUMED_BY").alias("type"), "repo")
    bound = facts.where("kind = 'binding' and name is not null and detail is not null")
    routes = bound.select(id_(F.lit("rabbitmq"), F.col("name")).alias("src"), id_(F.lit("rabbitmq"), F.col("detail")).alias("dst"), F.lit("ROUTES_TO").alias("type"), "repo")
    ends = uses.select("repo", F.col("detail").alias("broker"), "name").unionByName(bound.select("repo", F.lit("rabbitmq").alias("broker"), F.explode(F.array("name", "detail")).alias("name"))).distinct()
    first = ends.groupBy("broker", "name").agg(F.min("repo").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = ends.join(first, ["broker", "name"]).where("repo <> first").select(F.concat_ws(":", "first", F.lit("channel"), "broker", "name").alias("src"), id_(F.col("broker"), F.col("name")).alias("dst"), F.lit("SAME_CHANNEL").alias("type"), F.col("first").alias("repo"))
    return out.unionByName(back).unionByName(routes).unionByName(same).distinct()


def actions(facts: DataFrame) -> DataFrame:
    """(id, repo, file_id, function_id, page_id, component, event, condition, line, effects) of UI actions; page_id is null where the file is no page.

    The facts of a file meet once.
    """
    page = F.max(F.when(F.col("kind") == "page", F.col("file_id"))).over(Window.partitionBy("file_id"))
    found = facts.where("kind in ('action', 'page')").select("kind", "repo", "file_id", "function", "name", F.lower("method").alias("event"), "condition", "line", "effects", page.alias("page_id")).where("kind = 'action'")
    id_ = F.concat("file_id", F.lit("::action:"), "name", F.lit(":"), "event", F.lit(":"), F.col("line").cast("string"))
    return found.select(id_.alias("id"), "repo", "file_id", F.when(F.col("function").isNotNull(), _function_id()).alias("function_id"), "page_id", F.col("name").alias("component"), "event", "condition", "line", "effects")


def starts(facts: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, repo, function_id, process_key, line, target): starts of processes; target is null until one process answers to the key.

    Starts are stored first: the next run links them when the process is there.
    """
    found = facts.where("kind = 'start' and name is not null").select(
        identity.start_id(F.col("file_id"), F.col("name"), F.col("line")).alias("id"), "repo", F.when(F.col("function").isNotNull(), _function_id()).alias("function_id"), F.col("name").alias("process_key"), "line").dropDuplicates(["id"])
    there = processes(steps).select(F.col("process").alias("key"), "repo", "id")
    return unique_target(found.withColumn("key", F.col("process_key")), there).drop("key")


def process_id() -> Column:
    return F.concat(identity.file_id(F.col("repo"), F.col("path")), F.lit("::process:"), "process")


def processes(steps: DataFrame) -> DataFrame:
    """(repo, path, process, id) of steps."""
    return steps.select("repo", "path", "process", process_id().alias("id")).distinct()


def workflow(facts: DataFrame, steps: DataFrame, flows: DataFrame) -> DataFrame:
    """(src, dst, type, repo): HAS_STEP, NEXT, INVOKES (a delegate's class, by its alias), CALLS (a called process)."""
    step = lambda name: F.concat(process_id(), F.lit("::step:"), name)
    has = steps.select(process_id().alias("src"), step(F.col("step")).alias("dst"), F.lit("HAS_STEP").alias("type"), "repo")
    nexts = flows.select(step(F.col("source")).alias("src"), step(F.col("target")).alias("dst"), F.lit("NEXT").alias("type"), "repo")
    classes = class_names(facts).select(identity.alias(F.col("name")).alias("key"), "repo", "id")
    invokes = unique_target(steps.where("delegate is not null").select(step(F.col("step")).alias("src"), "repo", F.col("delegate").alias("key")), classes)
    called = unique_target(steps.where("called is not null").select(step(F.col("step")).alias("src"), "repo", F.col("called").alias("key")), processes(steps).select(F.col("process").alias("key"), "repo", "id"))
    linked = lambda df, kind: df.where("target is not null").select("src", F.col("target").alias("dst"), F.lit(kind).alias("type"), "repo")
    return has.unionByName(nexts).unionByName(linked(invokes, "INVOKES")).unionByName(linked(called, "CALLS")).distinct()
