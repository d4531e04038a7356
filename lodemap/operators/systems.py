"""External systems: evidence from URLs and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions.urls import system

LINK = r'href="([^"]*)"'


def hosts(urls: DataFrame, column: str = "url") -> DataFrame:
    """(system, uses) of absolute URLs."""
    return urls.select(system(F.col(column)).alias("system")).where("system <> ''").groupBy("system").agg(F.count("*").alias("uses"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, uses): targets of links in pages (page_id, html)."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count("*").alias("uses"))


def roles(texts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, kind, technology) of texts (id, text): rules (kind, technology, pattern) whose pattern a text has.

    The rules are code, a short list: each is one regular expression of the scan, and no pairs are made.
    """
    hits = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("technology"))) for k, t, p in rules])
    return texts.select("id", F.explode(F.array_compact(hits)).alias("r")).select("id", "r.kind", "r.technology").distinct()


# Technology by its names, then its kind and the role that it has where a rule states none.
NAMES = {"pg": "postgresql", "pgx": "postgresql", "pq": "postgresql", "postgres": "postgresql", "psycopg": "postgresql", "psycopg2": "postgresql", "asyncpg": "postgresql",
         "mysql2": "mysql", "ioredis": "redis", "go-redis": "redis", "mongo": "mongodb", "pymongo": "mongodb", "kafkajs": "kafka", "kafka-python": "kafka", "amqplib": "rabbitmq", "pika": "rabbitmq"}
KINDS = {"postgresql": ("database", "database"), "mysql": ("database", "database"), "mariadb": ("database", "database"), "sqlite": ("database", "database"), "mongodb": ("database", "database"),
         "redis": ("cache", "datastore"), "kafka": ("messaging", "messaging"), "rabbitmq": ("messaging", "messaging"), "smtp": ("email", "email"), "sendgrid": ("email", "email"),
         "whatsapp": ("communications", "messaging"), "twilio": ("communications", "messaging"), "stripe": ("payment", "payment-gateway"), "paypal": ("payment", "payment-gateway")}
STATED = ["database", "cache", "datastore", "messaging", "pubsub"]


def report(facts: DataFrame) -> DataFrame:
    """(id, repo, file_id, kind, technology, role, name, scope, line, evidence) of facts: each system of a file once.

    line is the first that shows it, evidence the number of lines. A literal host is a system by its host and port, of the
    known technology whose name it has, else of kind http. Mail host and port of one file are one system. No URL's user,
    password or query is kept.
    """
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    kinds = F.create_map(*[x for t, (k, r) in KINDS.items() for x in (F.lit(t), F.struct(F.lit(k).alias("kind"), F.lit(r).alias("role")))])
    host = facts.where("kind = 'host' and system <> ''")
    names = F.array(*[F.lit(t) for t in KINDS])
    by_host = F.element_at(F.filter(names, lambda t: F.contains(F.concat(F.lit("."), "system", F.lit(".")), F.concat(F.lit("."), t, F.lit(".")))), 1)
    base = ["repo", "file_id", "scope", "line"]
    rows = facts.where("kind = 'system'").select(*base, F.coalesce(known[F.col("name")], "name").alias("technology"), F.when(F.col("detail").isin(STATED), F.col("detail")).alias("role"), F.lit(None).cast("string").alias("name"))
    hosts = host.select(*base, F.coalesce(F.when(F.size(F.filter(names, lambda t: F.contains(F.concat(F.lit("."), "system", F.lit(".")), F.concat(F.lit("."), t, F.lit("."))))) > 0, by_host), F.lit("http")).alias("technology"), F.lit(None).cast("string").alias("role"), F.col("system").alias("name"))
    mail = facts.where("kind = 'mail'").groupBy("repo", "file_id", "scope").agg(
        F.min("line").alias("line"), F.max(F.when(F.col("method") == "HOST", F.col("name"))).alias("host"), F.max(F.when(F.col("method") == "PORT", F.col("name"))).alias("port")).where("host is not null")
    mail = mail.select(*base, F.lit("smtp").alias("technology"), F.lit(None).cast("string").alias("role"), F.concat_ws(":", "host", "port").alias("name"))
    rows = rows.unionByName(hosts).unionByName(mail)
    rows = rows.select(*base, F.coalesce(kinds[F.col("technology")]["kind"], F.lit("http")).alias("kind"), "technology", F.coalesce("role", kinds[F.col("technology")]["role"], F.lit("service")).alias("role"), F.coalesce("name", "technology").alias("name"))
    found = rows.groupBy("repo", "file_id", "scope", "kind", "technology", "role", "name").agg(F.min("line").alias("line"), F.count("*").alias("evidence"))
    return found.select(F.concat_ws(":", "repo", F.lit("system"), "kind", "technology", "role", "name").alias("id"), "repo", "file_id", "kind", "technology", "role", "name", "scope", "line", "evidence")


def boundary(facts: DataFrame) -> DataFrame:
    """(repo, kind, technology, role, name, files, evidence, first): the systems at a repository's boundary, observed in code and configuration only.

    first is the first place by file and line. Tests are no boundary.
    """
    place = F.struct("file_id", "line")
    found = report(facts).where("scope = 'runtime'").groupBy("repo", "kind", "technology", "role", "name").agg(
        F.count_distinct("file_id").alias("files"), F.sum("evidence").alias("evidence"), F.min(place).alias("p"))
    return found.select("repo", "kind", "technology", "role", "name", "files", "evidence", F.concat_ws(":", "p.file_id", "p.line").alias("first"))
