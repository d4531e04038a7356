"""Incremental upkeep of derived links: after a change only the links of keys that it touches are found anew.

Declarations (file, repo, key, id) and references (file, repo, key, src) are kept as written tables, cut into parts by
key, and so are the links between them: by the rule of one answer (`relations.unique_target`), or a link to every declaration
of the key; a further table, cut by file, says which keys a file has. A change reads the parts of its files, then the parts of the old and new keys of these files,
and replaces those parts. Links that somebody else manages are never touched.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.operators.relations import unique_target
from lodemap.operators.traverse import shared
from lodemap.sources.repository import EXCLUDED, SUFFIXES

DECLARED = "part int, file string, repo string, key string, id string"
REFERRED = "part int, file string, repo string, key string, src string"
LINKS = "part int, file string, repo string, key string, src string, target string, managed_by string"
KEYS = "part int, file string, key string"
DERIVED = "derived"
#: Files of one part of a table, each written by one task.
CUTS = 8


def classified(changes: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(path, action) of changes (status, path, old_path): `read` files that are new or changed, `drop` those that are gone, `skip` those that are no sources.

    A rename drops the old path and reads the new one, a copy keeps the old one. A file in an excluded folder is skipped,
    and dropped in case it has been read before. A path that is read by one change and dropped by another is read.
    """
    rows = changes.select("path", F.when(F.col("status") == "D", "drop").otherwise("read").alias("action")).unionByName(changes.where("status = 'R' and old_path is not null").select(F.col("old_path").alias("path"), F.lit("drop").alias("action")))
    inside = F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    out = F.arrays_overlap(inside, F.array(*[F.lit(x) for x in [*EXCLUDED, *(excluded or [])]]))
    source = F.col("path").rlike(r"(?:^|[./])(?:" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")
    action = F.when(~source, F.array(F.lit("skip"))).when(out, F.array(F.lit("skip"), F.lit("drop"))).otherwise(F.array("action"))
    rows = rows.where("path is not null").select("path", F.explode(action).alias("action")).distinct()
    reads = rows.where("action = 'read'").select("path")
    return rows.where("action <> 'drop'").unionByName(rows.where("action = 'drop'").join(reads, "path", "left_anti"))


def outcome(changes: DataFrame) -> DataFrame:
    """(action, files): how many files of `classified` are read, dropped and skipped."""
    return changes.groupBy("action").agg(F.count("*").alias("files"))


class Links:
    """The tables in a folder that driver and executors share. `parts` is the number of parts of each table.

    `every`: a reference is linked to every declaration of its key; else to the one that it can mean, if there is one.
    """

    def __init__(self, spark, folder: str, parts: int = 64, every: bool = False):
        self.spark, self.folder, self.parts, self.every = spark, folder, parts, every

    def _part(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.parts)).cast("int")

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _read(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(self._path(name))
        return df if parts is None else df.where(F.col("part").isin(parts))

    def _write(self, name: str, rows: DataFrame, parts: list[int] | None = None) -> None:
        """Replace the given parts of a table (all of it, if None) by rows.

        The rows are written aside first, so what is read is never what is being replaced, and a run that was stopped
        here is repeated with the same rows. A whole table replaces nothing that is read and is written at once. A part
        that is empty now keeps one row without a key. A part has `CUTS` files, so that its tasks do not grow with the table.
        """
        columns = rows.columns
        if parts is not None:
            nulls = [F.col("part") if c == "part" else F.lit(None).cast("string").alias(c) for c in columns]
            empty = self.spark.createDataFrame([(p,) for p in parts], "part int").join(rows.select("part").distinct(), "part", "left_anti").select(*nulls)
            rows = rows.unionByName(empty)
        cut = F.pmod(F.xxhash64(*[c for c in ("file", "key") if c in columns], F.lit(0)), F.lit(CUTS))
        rows = rows.repartition("part", cut)
        if parts is not None:
            rows = shared(rows)
        writer = rows.write.mode("overwrite").partitionBy("part")
        (writer if parts is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(self._path(name))

    def links(self) -> DataFrame:
        """(file, repo, key, src, target, managed_by): references with an answer, and links that others manage."""
        return self._read("links", LINKS).where("src is not null").select("file", "repo", "key", "src", "target", "managed_by")

    def build(self, declared: DataFrame, referred: DataFrame, others: DataFrame | None = None) -> None:
        """Everything from the start: declared (file, repo, key, id), referred (file, repo, key, src), others (links with a managed_by of their own)."""
        placed = lambda df: df.where("key is not null").withColumn("part", self._part("key"))
        declared, referred = placed(declared).select("part", "file", "repo", "key", "id").distinct(), placed(referred).select("part", "file", "repo", "key", "src").distinct()
        self._write("declared", declared)
        self._write("referred", referred)
        declared, referred = self._read("declared", DECLARED), self._read("referred", REFERRED)
        self._write("keys", self._keys(declared, referred))
        found = self._found(declared, referred)
        self._write("links", found if others is None else found.unionByName(placed(others).select(*found.columns)))

    def _keys(self, declared: DataFrame, referred: DataFrame) -> DataFrame:
        return declared.select("file", "key").union(referred.select("file", "key")).where("key is not null").distinct().select(self._part("file").alias("part"), "file", "key")

    def _found(self, declared: DataFrame, referred: DataFrame) -> DataFrame:
        if self.every:
            rows = referred.join(declared.select("key", F.col("id").alias("target")).where("target is not null").distinct(), "key")
        else:
            # A reference's answer depends on its repository and key alone, so it is not told apart and met again.
            rows = unique_target(referred.where("src is not null and repo is not null"), declared.select("key", "repo", "id")).where("target is not null")
        return rows.select("part", "file", "repo", "key", "src", "target", F.lit(DERIVED).alias("managed_by"))

    def _parts_of(self, rows: DataFrame, column: str) -> list[int]:
        """The parts that rows fall into: `parts` numbers at most."""
        return sorted(r.part for r in rows.select(self._part(column).alias("part")).distinct().collect())

    def apply(self, gone: DataFrame, declared: DataFrame, referred: DataFrame) -> dict[str, list[int]]:
        """Take the files `gone` (file) out and put the rows of new and changed files in; the parts that were read, by table.

        A changed file is gone and has new rows. Afterwards the tables are what `build` makes of all files as they are now.
        """
        touched = shared(gone.select("file").union(declared.select("file")).union(referred.select("file")).where("file is not null").distinct())
        declared, referred = (shared(df.where("key is not null").withColumn("part", self._part("key")).select(*columns).distinct()) for df, columns in ((declared, ["part", "file", "repo", "key", "id"]), (referred, ["part", "file", "repo", "key", "src"])))
        files = self._parts_of(touched, "file")
        if not files:
            return {"keys": [], "links": []}
        known = self._read("keys", KEYS, files)
        old = known.join(touched, "file", "left_semi").select("key")
        keys = shared(old.union(declared.select("key")).union(referred.select("key")).where("key is not null").distinct())
        parts = self._parts_of(keys, "key")
        kept = lambda name, schema: self._read(name, schema, parts).where("key is not null").join(touched, "file", "left_anti")
        if parts:
            self._write("declared", kept("declared", DECLARED).unionByName(declared).select("part", "file", "repo", "key", "id"), parts)
            self._write("referred", kept("referred", REFERRED).unionByName(referred).select("part", "file", "repo", "key", "src"), parts)
            before = self._read("links", LINKS, parts).where("key is not null")
            others = before.where(~F.col("managed_by").eqNullSafe(F.lit(DERIVED)))
            still = before.where(F.col("managed_by") == DERIVED).join(keys, "key", "left_anti")
            now = (self._read(name, schema, parts).join(keys, "key", "left_semi") for name, schema in (("declared", DECLARED), ("referred", REFERRED)))
            self._write("links", others.unionByName(still).unionByName(self._found(*now).select(*before.columns)).select(*before.columns), parts)
        rest = known.where("file is not null").join(touched, "file", "left_anti").select("part", "file", "key")
        self._write("keys", rest.unionByName(self._keys(declared, referred)), files)
        return {"keys": files, "links": parts}

    def replace_repository(self, repo: str, declared: DataFrame, referred: DataFrame) -> dict[str, list[int]]:
        """A whole new scan of one repository: files that it no longer has are pruned, those of others and links that others manage stay."""
        stored = self._read("declared", DECLARED).where(F.col("repo") == repo).select("file").union(self._read("referred", REFERRED).where(F.col("repo") == repo).select("file")).distinct()
        return self.apply(stored, declared, referred)
