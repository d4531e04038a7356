"""A training corpus from documents: quality, language, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of its input; the last returns
the digests of its byte-level BPE. A stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.llm import bpe, decontaminate, language, quality, simhash
from lodemap.llm.common import collected, python_batches, table, written

#: Documents stay where label 1 is as likely as not.
KEEP_SCORE = 0.5


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, and the whole row, so that no column of `docs` meets one that an operator adds."""
    return docs.select("doc_id", "text", "lang", F.struct("*").alias("row"))


def quality_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; all of them where the labels teach nothing.

    Null and empty texts are scored like others. Rows are kept or go as they are, repeated ones alike.
    """
    python_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    collected(spark)
    return docs if model is None else quality.score(_held(docs), model).where(F.col("quality_score") >= KEEP_SCORE).select("row.*")


def language_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told: texts that are more like the texts of some lang than chance makes them.

    Profiles are of all texts whose lang is known. Those without a letter go, also where no lang teaches anything; then all
    others stay. Null texts have no letter. `und` names no language. A document's own lang does not decide. Rows are kept or
    go as they are, repeated ones alike.
    """
    python_batches(spark)
    profiles = language.fit(docs, train_texts=None).where(F.exists("vector", lambda x: x != 0))
    if not (known := profiles.count()):
        return docs.where(language.lettered("text"))
    told = (F.col("lang_pred") != "und") & (F.col("lang_score") > language.chance(known))
    return language.predict(_held(docs), profiles).where(told).select("row.*")


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and similar texts, that of the smallest doc_id (null ids last).

    A document is a row: unlike texts that share a doc_id are told apart. Rows equal in doc_id and text are one
    document; if their other columns differ, the smallest row as JSON stays. Null and empty texts are copies of each other.
    """
    stays = simhash.similar_groups(docs).where("stays").select("row_key", "rows")
    collected(spark)
    rows = docs.select(simhash.row_key().alias("row_key"), F.struct("*").alias("row"))
    once = rows.join(stays.where("rows = 1"), "row_key", "left_semi").select("row.*")
    if (again := stays.where("rows > 1")).isEmpty():
        return once
    repeats = rows.join(again, "row_key", "left_semi").groupBy("row_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(repeats.select("row.*"))


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts, and all where the benchmark is empty, stay.

    Whole texts are looked at, however long; rows are kept or go as they are, repeated ones alike.
    """
    return decontaminate.flagged(_held(docs), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("row.*")


def byte_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row that is left; a null text is an empty one."""
    python_batches(spark)
    return bpe.digests(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Scores, profiles and fingerprints are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
