"""Source files of repositories as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Folders that are generated or belong to others.
EXCLUDED = ["node_modules", ".git", "dist", "dist.old", "build", "target", "vendor", "__pycache__", ".venv", ".next"]
SUFFIXES = ["py", "js", "jsx", "ts", "tsx", "go", "java", "properties", "bpmn", "bpmn20.xml", "sql", "prisma", "yml", "yaml", "toml", "requirements.txt", "package.json", "go.mod"]


def workers(value: str | None, default: int = 4) -> int:
    """A number of scan tasks from a setting; nothing or text that is no positive number is an error, unset the default."""
    if value is None:
        return default
    if not value.strip().isdigit() or int(value) < 1:
        raise ValueError("workers must be a positive integer")
    return int(value)


def scan(spark, root: str, repo: str, excluded: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """(repo, path, content) of the source files below a folder of any store, excluded folders left out.

    Bytes that are not UTF-8 become replacement characters: a malformed file is read, not fatal.
    """
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.split("://", 1)[-1].removeprefix("file:"))
    full = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), r"^/+", "/")
    path = F.expr("substring(full, locate(base, full) + length(base) + 1)")
    rows = found.select(full.alias("full"), base.alias("base"), "content").select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    inside = F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    skip = F.arrays_overlap(inside, F.array(*[F.lit(x) for x in [*EXCLUDED, *(excluded or [])]]))
    rows = rows.where(~skip & F.col("path").rlike(r"(?:^|[./])(?:" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"))
    rows = rows.select(F.lit(repo).alias("repo"), "path", "content")
    return rows.repartition(tasks) if tasks else rows


def git_diff(spark, folder: str, span: str = "ORIG_HEAD..HEAD") -> DataFrame:
    """(line) of a repository's name-status diff; operators.sync.changes_of_diff reads it."""
    out = subprocess.run(["git", "-C", folder, "diff", "--name-status", "-M", "-C", span], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(x,) for x in out.splitlines()], "line string")
