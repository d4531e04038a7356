"""HTTP clients that are configured in one module and used in others, and paths that a server rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.functions import urls
from lodemap.operators.closure import roots

_JS = ("js", "jsx", "ts", "tsx")


def _module(path: Column) -> Column:
    """A file as imports name it: without its ending, and without /index."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(?:tsx|ts|jsx|js)$", ""), r"(?:^|/)index$", "")


def _target(path: Column, wanted: Column) -> Column:
    """The module that an import of a file names: ./ and ../ from its folder, @/ from the src folder above it; null for packages."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    above = F.regexp_extract(path, r"^((?:.*/)?src)/", 1)
    joined = F.when(wanted.startswith("@/"), F.concat_ws("/", F.nullif(above, F.lit("")), F.expr("substring(wanted, 3)"))).when(wanted.startswith("."), F.concat_ws("/", F.nullif(folder, F.lit("")), wanted))
    # Steps up take the part before them away, steps that stay go.
    parts = F.split(joined, "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x)))
    return _module(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def symbols(facts: DataFrame) -> DataFrame:
    """(node, next) of names: a name that a module imports or passes on to the exported name of another module, that to the local name behind it.

    A node is repo, module, a letter (local, given) and a name, so an alias and a re-export are links like any others.
    """
    rows = facts.where(F.col("suffix").isin(*_JS)).select("repo", "path", "kind", "name", "argument", F.col("detail").alias("wanted"))
    node = lambda module, letter, name: F.concat_ws("\x1f", "repo", module, F.lit(letter), name)
    there = _target(F.col("path"), F.col("wanted"))
    taken = rows.where("kind = 'imported'").select(node(_module(F.col("path")), "local", F.col("name")).alias("node"), node(there, "given", F.col("argument")).alias("next"), there.alias("there"))
    given = rows.where("kind = 'exported' and wanted is null").select(node(_module(F.col("path")), "given", F.col("name")).alias("node"), node(_module(F.col("path")), "local", F.col("argument")).alias("next"), F.lit("").alias("there"))
    passed = rows.where("kind = 'exported' and wanted is not null").select(node(_module(F.col("path")), "given", F.col("name")).alias("node"), node(there, "given", F.col("argument")).alias("next"), there.alias("there"))
    return taken.unionByName(given).unionByName(passed).where("there is not null").select("node", "next")


def longest_prefix(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, prefix, target) of requests (id, repo, path) below the prefix of a rule (repo, prefix, place, target) of their repository: the longest, of equal ones the first by place.

    A prefix is whole parts of a path: /a/b is one of /a/b and /a/b/c, not of /a/bc; / and '' are prefixes of all. A request
    meets the rules by its own path's prefixes, one for each part, so rules are looked up and never compared with all.
    Rules of one prefix are reduced to the first before the join.
    """
    plain = F.regexp_replace("prefix", "/+$", "")
    first = rules.where("prefix is not null").select("repo", plain.alias("prefix"), "place", "target").groupBy("repo", "prefix").agg(F.min(F.struct("place", "target")).alias("r")).select("repo", "prefix", F.col("r.target").alias("target"))
    parts = F.split(F.regexp_replace(F.regexp_replace("path", "[?#].*$", ""), "/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = requests.where("path is not null").select("id", "repo", F.explode(prefixes).alias("prefix")).join(first, ["repo", "prefix"])
    best = F.max_by(F.struct("prefix", "target"), F.length("prefix"))
    return met.groupBy("id").agg(best.alias("b")).select("id", "b.prefix", "b.target")


def configured(facts: DataFrame) -> DataFrame:
    """`facts` with the paths of configured clients before those of their calls, and the systems of rewritten paths.

    A call's receiver is followed through imports, aliases and re-exports to the client that it is. A path that already has
    the client's before it stays. Calls of receivers that are no known client are dropped unless their name is usual for one.
    """
    from lodemap.operators.extract import _addressed

    js = F.col("suffix").isin(*_JS)
    node = F.concat_ws("\x1f", "repo", _module(F.col("path")), F.lit("local"), "argument")
    ends = roots(symbols(facts)).where("root is not null").select("node", "root")
    clients = facts.where("kind = 'client'").select(F.concat_ws("\x1f", "repo", _module(F.col("path")), F.lit("local"), "name").alias("root"), "url").groupBy("root").agg(F.count_distinct("url").alias("n"), F.min("url").alias("base")).where("n = 1").drop("n")
    asked = js & F.col("kind").isin("request", "perhaps") & F.col("argument").isNotNull()
    rows = facts.withColumn("node", F.when(asked, node)).join(ends, "node", "left").withColumn("root", F.coalesce("root", "node")).join(clients, "root", "left")
    rows = rows.where("kind <> 'perhaps' or base is not null")
    base, path = F.regexp_replace("base", "/$", ""), urls.service_path_prefix(F.col("base"))
    has = F.col("url").startswith(path) & (path != "")
    url = F.when(F.col("base").isNull() | has & (urls.system(F.col("base")) == "") | F.col("url").rlike("^https?://"), F.col("url")).when(has, F.concat(F.regexp_extract("base", urls.LEADING_AUTHORITY, 0), "url")).otherwise(F.concat(base, "url"))
    rows = rows.withColumns({"url": F.when(asked, url).otherwise(F.col("url")), "kind": F.when(F.col("kind") == "perhaps", "request").otherwise(F.col("kind"))})
    rows = rows.withColumn("id", F.concat_ws("\x1f", "repo", "path", F.col("n").cast("string"), "url"))
    rewrites = facts.where("kind = 'rewrite'").select("repo", F.regexp_replace("url", r"/?[:*(].*$", "").alias("prefix"), F.struct("path", "n").alias("place"), F.col("detail").alias("target"))
    open_ = rows.where((F.col("kind") == "request") & js & F.col("url").startswith("/")).select("id", "repo", F.col("url").alias("path")).distinct()
    rows = rows.join(longest_prefix(open_, rewrites).select("id", "target"), "id", "left")
    return _addressed(rows, F.coalesce("target", F.nullif("system", F.lit(""))))
