"""What names stand for: reaching definitions, followed to a fixed point.

A use is a row of terms. Extraction has bound each name to a key: a local name to the last definition that every way to
the use passes and those after it that some ways pass, a field or function to all its definitions or returned values,
a constant of another class to that class. Values by definitions of the own file are found where the file is read
(`known`); for all others a join replaces the first open reference of every row by the terms of
its definitions, a row for each, round after round, until none is open. Only uses are followed, so what nobody asks for
costs nothing. A definition that refers to itself, by whatever way, is a value that is not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.functions import urls
from lodemap.operators.traverse import shared

#: Kinds of facts whose expressions are followed, and where the value goes.
URLS, NAMES = ("request", "perhaps"), ("publish", "consume", "binding", "start", "page")
#: Kinds of facts that say what names stand for.
DEFINITIONS = ("define", "constant")
_REFERENCE = ("ref", "inner", "keyref")


def _open(t: Column) -> Column:
    return t["kind"].isin(*_REFERENCE) & t["text"].contains("#")


def expand(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, terms): every value of uses (id, repo, terms) by definitions (repo, key, at, terms), without references.

    A term is (kind, text, at). References are of kind ref, inner (a later value of a format) or keyref (the value names a
    setting), their text is a key. A reference met again within its own value, and one without a definition, becomes a
    param (a keyref a key without a name). Values of a use are a set. Rounds are as many as references have to be
    replaced one after another in one value; each is written to the shared folder.
    """
    via = F.array().cast("array<string>")
    held = lambda terms, path: F.transform(terms, lambda t: F.struct(t["kind"].alias("kind"), t["text"].alias("text"), t["at"].alias("at"), path.alias("via")))
    known = definitions.select("repo", "key", F.col("at").alias("place"), F.col("terms").alias("meaning"))  # repeated ones go with the rows that they make
    rows = uses.where("terms is not null").select("id", "repo", held(F.col("terms"), via).alias("terms")).distinct()
    has = F.exists("terms", _open)
    done, rows = rows.where(~has), shared(rows.where(has))
    parts = [done]
    while not rows.isEmpty():
        first = F.array_position(F.transform("terms", _open), True).cast("int")
        asked = rows.withColumn("i", first).withColumn("t", F.element_at("terms", F.col("i")))
        found = asked.join(known, (asked["repo"] == known["repo"]) & (asked["t.text"] == known["key"]) & (known["place"] < asked["t.at"]) & ~F.array_contains("t.via", F.col("t.text")), "left").select(asked["*"], "meaning")
        term = lambda kind, text: F.array(F.struct(kind.alias("kind"), text.alias("text"), F.lit(0).alias("at"), via.alias("via")))
        path = F.concat("t.via", F.array("t.text"))
        single = (F.size("meaning") == 1) & (F.get("meaning", F.lit(0))["kind"] == "text")
        new = (
            F.when((F.col("t.kind") == "keyref") & single, term(F.lit("key"), F.get("meaning", F.lit(0))["text"]))
            .when((F.col("t.kind") == "keyref") & F.col("meaning").isNull(), term(F.lit("key"), F.lit("")))
            .when(F.col("meaning").isNull(), term(F.lit("param"), F.lit("")))
            .when(F.col("t.kind") == "inner", held(F.transform("meaning", lambda m: F.struct(F.when(m["kind"].isin("ref", "open"), "inner").otherwise(m["kind"]).alias("kind"), m["text"].alias("text"), m["at"].alias("at"))), path))
            .otherwise(held(F.col("meaning"), path))
        )
        rows = shared(found.select("id", "repo", F.concat(F.slice("terms", 1, F.col("i") - 1), new, F.slice("terms", F.col("i") + 1, F.size("terms"))).alias("terms")).distinct())
        parts.append(rows.where(~has))
        rows = rows.where(has)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("id", F.transform("terms", lambda t: F.struct(t["kind"].alias("kind"), t["text"].alias("text"))).alias("terms")).distinct()


def text_of(terms: Column, symbols: Column) -> Column:
    """The text of terms: what is not known is {param}, but nothing where it comes first; with `symbols`, a name that is open is ${name}."""
    piece = lambda t, i: (
        F.when(t["kind"] == "text", t["text"]).when(t["kind"] == "key", "")
        .when((t["kind"] == "open") & symbols, F.concat(F.lit("${"), t["text"], F.lit("}")))
        .when(i == 0, "").otherwise("{param}"))
    return F.array_join(F.transform(terms, piece), "")


def system_of(terms: Column, symbols: Column) -> Column:
    """The setting that names the service of a URL, or with `symbols` the name that stands first; null if there is none."""
    first = F.get(terms, F.lit(0))
    key = F.get(F.filter(terms, lambda t: t["kind"] == "key"), F.lit(0))["text"]
    return F.coalesce(F.nullif(key, F.lit("")), F.when(symbols & (first["kind"] == "open"), first["text"]))


def definitions(facts: DataFrame) -> DataFrame:
    """(repo, key, at, terms) of facts; a constant of a class is known elsewhere if all classes of that name agree on it."""
    own = facts.where("kind = 'define'").select("repo", "key", "at", "terms")
    given = facts.where("kind = 'constant'").groupBy("repo", "key").agg(F.count_distinct(F.to_json("terms")).alias("values"), F.min("terms").alias("terms")).where("values = 1")
    return own.unionByName(given.select("repo", "key", F.lit(-1).alias("at"), "terms"))


def filled(facts: DataFrame) -> DataFrame:
    """Facts with the values of their expressions: url of requests, name of channels, process keys and pages, detail of bindings.

    A use with several values has a row for each; one without a known text keeps null.
    """
    from lodemap.operators.extract import _addressed

    key = F.concat_ws(" ", "repo", "path", F.col("n").cast("string"))
    asked = F.col("kind").isin(*URLS, *NAMES)
    # What is one text has its value; only the rest is followed, and by joins only what the task of its file could not follow.
    single = (F.size("terms") == 1) & (F.get("terms", F.lit(0))["kind"] == "text")
    followed = F.coalesce(asked & F.col("terms").isNotNull() & ~single, F.lit(False))
    queued = F.coalesce((F.col("kind") == "binding") & F.col("other").isNotNull(), F.lit(False))
    joined = followed & F.col("known").isNull() | queued & F.col("other_known").isNull()
    symbols = F.col("suffix") == "go"
    done = facts.where(~joined).withColumn("value", F.explode_outer(F.when(followed, F.col("known")))).withColumn("queue", F.explode_outer(F.when(queued, F.col("other_known")))).withColumn("queue", text_of(F.col("queue"), F.lit(False)))
    rest = shared(facts.where(joined).withColumn("id", key))
    if not rest.isEmpty():
        meanings = shared(definitions(facts))
        found = expand(rest.where(followed).select("id", "repo", "terms"), meanings).withColumnRenamed("terms", "value")
        queues = expand(rest.where(queued).select("id", "repo", F.col("other").alias("terms")), meanings).select("id", text_of(F.col("terms"), F.lit(False)).alias("queue"))
        done = done.unionByName(rest.join(found, "id", "left").join(queues, "id", "left").drop("id"))
    whole = F.forall("value", lambda t: t["kind"] == "text")  # a name is known only in full
    url = F.nullif(text_of(F.col("value"), symbols), F.lit(""))
    page = F.when(F.col("kind") == "page", F.concat(F.lit("/"), F.regexp_replace("name", "^/", ""))).otherwise(F.col("name"))
    done = done.withColumns({
        "url": F.when(F.col("kind").isin(*URLS), F.coalesce("url", url)).otherwise(F.col("url")),
        "name": F.when(F.col("kind").isin(*NAMES), F.coalesce("name", F.when(whole, text_of(F.col("value"), F.lit(False))))).otherwise(F.col("name")),
        "detail": F.when(F.col("kind") == "binding", F.nullif("queue", F.lit(""))).otherwise(F.col("detail"))}).withColumn("name", page)
    return _addressed(done, F.when(F.col("kind").isin(*URLS), system_of(F.col("value"), symbols)))
