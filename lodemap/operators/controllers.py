"""Routes that classes have without declaring them: from the controllers that they inherit, and as JSON:API resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions import urls
from lodemap.operators.closure import roots
from lodemap.operators.traverse import shared

#: Kinds of facts that `inherited_routes` reads.
KINDS = ("class", "package", "import", "extends", "controller")
# What a base controller answers, by the end of its name, the first that fits; then JSON:API resources.
_LIST, _ITEM = ("GET", ""), ("GET", "/{id}")
BASES = [
    ("ReadOnlyJpaRestController", [_LIST, _ITEM]),
    ("JpaRestController", [_LIST, _ITEM, ("POST", ""), ("PUT", "/{id}"), ("PATCH", "/{id}"), ("DELETE", "/{id}")]),
    ("FlowController", [_LIST, _ITEM, ("POST", ""), ("POST", "/submit"), ("POST", "/update")]),
]
RESOURCE = [_LIST, _ITEM, ("POST", ""), ("PATCH", "/{id}"), ("DELETE", "/{id}")]


def _templates(routes: list[tuple[str, str]]):
    return F.array(*[F.struct(F.lit(method).alias("method"), F.lit(rest).alias("rest")) for method, rest in routes])


def superclasses(facts: DataFrame) -> DataFrame:
    """(node, next, repo, path, name): each class and the class that it extends.

    A node is the repository and the qualified name. A name without a package is that of an import of the file, else of
    a class of the same package, else it stands for itself, as that of a library. A base controller ends a chain by its
    name, wherever it is declared. The facts of a file are put together once, so only the classes of a package are joined.
    """
    java = facts.where("suffix = 'java'")
    kind = lambda kind, *columns: F.collect_set(F.when(F.col("kind") == kind, F.struct(*columns)))
    last = F.substring_index("name", ".", -1).alias("super")
    files = java.where("kind in ('package', 'class', 'import', 'extends')").groupBy("repo", "path").agg(
        F.min(F.when(F.col("kind") == "package", F.col("name"))).alias("package"), kind("class", "name").alias("classes"), kind("import", last, F.col("name").alias("imported")).alias("imports"),
        kind("extends", "name", F.col("argument").alias("super"), F.col("detail").alias("written")).alias("extends"))
    classes = files.select("*", F.explode("classes.name").alias("name")).withColumn("qualified", F.concat_ws(".", "package", "name"))
    own = F.filter("extends", lambda e: e["name"] == F.col("name"))
    rows = classes.select("repo", "path", "name", "package", "qualified", "imports", F.explode_outer(own).alias("e")).select("*", "e.super", "e.written")
    rows = rows.withColumn("imported", F.array_min(F.filter("imports", lambda i: i["super"] == F.col("super"))["imported"])).drop("e", "imports")
    beside = classes.select("repo", F.col("qualified").alias("near")).distinct().withColumn("there", F.lit(True))
    rows = rows.withColumn("near", F.concat_ws(".", "package", "super")).join(beside, ["repo", "near"], "left")
    full = F.when(F.col("written").contains("."), F.col("written")).otherwise(F.coalesce("imported", F.when(F.col("there"), F.col("near")), "super"))
    base = F.lit(None).cast("string")
    for i, (end, _) in reversed(list(enumerate(BASES))):
        base = F.when(F.col("super").endswith(end), F.lit(f"base {i}")).otherwise(base)
    return rows.select(F.concat_ws("\x1f", "repo", "qualified").alias("node"), F.when(F.col("super").isNotNull(), F.coalesce(base, F.concat_ws("\x1f", "repo", full))).alias("next"), "repo", "path", "name")


def inherited_routes(facts: DataFrame) -> DataFrame:
    """(repo, path, name, method, url, path_form) of controllers whose superclasses, over any number of steps, end in a base controller.

    A chain of a class that extends itself by whatever way ends nowhere and has no routes.
    """
    classes = shared(superclasses(facts))
    ends = roots(classes.select("node", "next")).where("root like 'base %'").select("node", F.substring("root", 6, 9).cast("int").alias("base"))
    routes = F.element_at(F.array(*[_templates(r) for _, r in BASES]), F.col("base") + 1)
    found = facts.where("kind = 'controller'").select("repo", "path", "name", F.regexp_replace("url", "/$", "").alias("top")).distinct()
    found = found.join(classes.select("repo", "path", "name", "node"), ["repo", "path", "name"]).join(ends, "node").select("repo", "path", "name", "top", F.explode(routes).alias("r"))
    return _routes(found)


def resource_routes(facts: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(repo, path, name, method, url, path_form) of JSON:API resources in repositories that declare a server's path prefix, in their properties or in `prefixes` (repo, url).

    Without a prefix the classes are those of a client and answer nothing; with several, a resource is under each.
    """
    declared = facts.where("kind = 'prefix'").select("repo", "url")
    declared = declared if prefixes is None else declared.unionByName(prefixes.select("repo", "url"))
    top = F.concat(F.lit("/"), F.regexp_replace(F.coalesce("url", F.lit("")), "^/+|/+$", ""))
    declared = declared.select("repo", F.regexp_replace(top, "/$", "").alias("prefix")).distinct()
    found = facts.where("kind = 'resource' and name is not null").select("repo", "path", "name").distinct().join(declared, "repo")
    return _routes(found.select("repo", "path", "name", F.concat_ws("/", "prefix", "name").alias("top"), F.explode(_templates(RESOURCE)).alias("r")))


def _routes(found: DataFrame) -> DataFrame:
    url = F.concat("top", "r.rest")
    url = F.when(url == "", "/").otherwise(url)
    return found.select("repo", "path", "name", "r.method", url.alias("url"), urls.normalize_url(url).alias("path_form")).distinct()
