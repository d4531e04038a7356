"""Runtime services and decisions that users record: keyed tables, changed by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions import urls

ACTIVE, SUPERSEDED = "ACTIVE", "SUPERSEDED"


def configured(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo, key, base_url, path_prefix, target_repo) of services after changes (n, repo, key, base_url, target_repo): the last change of each key by n wins, one without a base_url clears the key.

    A base URL is kept without user names, passwords and query. Keys without a change stay as they are.
    """
    last = changes.where("repo is not null and key is not null").groupBy("repo", "key").agg(F.max(F.struct("n", "base_url", "target_repo")).alias("c"))
    kept = stored.join(last.select("repo", "key"), ["repo", "key"], "left_anti").select("repo", "key", "base_url", "path_prefix", "target_repo")
    base = urls.sanitize_url(F.col("c.base_url"))
    return kept.unionByName(last.where("c.base_url is not null").select("repo", "key", base.alias("base_url"), urls.service_path_prefix(base).alias("path_prefix"), F.col("c.target_repo").alias("target_repo")))


def recorded(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(id, title, supersedes, status) of decisions after new ones (id, title, supersedes): a new one is ACTIVE, what any supersedes is SUPERSEDED.

    A new decision whose id is stored is a change of it; of several new ones of an id the smallest by title is taken.
    """
    rows = new.where("id is not null").groupBy("id").agg(F.min(F.struct("title", "supersedes")).alias("r")).select("id", "r.title", "r.supersedes")
    every = stored.select("id", "title", "supersedes").join(rows.select("id"), "id", "left_anti").unionByName(rows)
    over = every.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct().withColumn("over", F.lit(True))
    return every.join(over, "id", "left").select("id", "title", "supersedes", F.when(F.col("over"), SUPERSEDED).otherwise(ACTIVE).alias("status"))


def hook_events(lines: DataFrame) -> DataFrame:
    """(id, prompt, session, paths, error) of hook payloads (id, body): the first of prompt, user_prompt and message; session and session_id; file_path or a list of file_paths.

    A body that is no JSON object stays as a row with an error and nothing else. The body is read once, as a VARIANT.
    """
    body = F.try_parse_json("body")
    rows = lines.select("id", body.alias("v")).withColumn("object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    text = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{name}", "string") for name in names])
    one = F.try_variant_get("v", "$.file_path", "string")
    paths = F.coalesce(F.try_variant_get("v", "$.file_paths", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    ok = lambda c: F.when(F.col("object"), c)
    return rows.select("id", ok(text("prompt", "user_prompt", "message")).alias("prompt"), ok(text("session", "session_id")).alias("session"), ok(paths).alias("paths"), F.when(~F.col("object"), "no object").alias("error"))


def registered(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, state) of repository names (name) that a caller gave: `invalid` for paths and empty names, `not available` for unknown ones, else `ok`."""
    there = known.select("name").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("name").isNull() | ~F.col("name").rlike(r"^[A-Za-z0-9_][A-Za-z0-9_. -]*$"), "invalid").when(F.col("there"), "ok").otherwise("not available")
    return names.join(there, "name", "left").select("name", state.alias("state"))
