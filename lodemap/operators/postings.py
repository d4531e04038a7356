"""Search in all text by trigrams: posting lists written once, met for each term, and verified."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.operators.traverse import shared


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for shorter ones."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class Postings:
    """Posting lists in a folder that driver and executors share, cut into parts by trigram."""

    def __init__(self, spark, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.parts)).cast("int")

    def build(self, texts: DataFrame) -> None:
        """texts (id, text). A posting is a row, so a trigram that most texts have is many rows and no long list; its part is written by many tasks."""
        rows = texts.where("text is not null").select("id", "text").distinct()
        rows.write.mode("overwrite").parquet(os.path.join(self.folder, "texts"))
        grams = rows.select("id", F.explode(trigrams(F.col("text"))).alias("gram")).distinct().withColumn("part", self._part())
        grams.write.mode("overwrite").partitionBy("part").parquet(os.path.join(self.folder, "grams"))

    def search(self, terms: DataFrame) -> DataFrame:
        """(term, id) for each of terms (term), case aside: the texts that hold it. Terms are a user's, a few.

        A term's trigrams are looked up in their parts alone; texts that have all of them are candidates, and only they are
        read and verified. A term of fewer than three characters has no trigrams and is looked for in all texts.
        """
        texts = self.spark.read.parquet(os.path.join(self.folder, "texts"))
        terms = shared(terms.where("term is not null").select("term").distinct())
        wanted = shared(terms.select("term", F.explode(trigrams(F.col("term"))).alias("gram")).withColumn("part", self._part()))
        parts = [r.part for r in wanted.select("part").distinct().collect()]
        grams = self.spark.read.schema("id string, gram string, part int").parquet(os.path.join(self.folder, "grams")).where(F.col("part").isin(parts))
        need = wanted.groupBy("term").agg(F.count("*").alias("need"))
        met = grams.join(F.broadcast(wanted.drop("part")), "gram").groupBy("term", "id").agg(F.count("*").alias("n")).join(F.broadcast(need), "term").where("n = need").select("term", "id")
        holds = F.contains(F.lower("text"), F.lower("term"))
        long = met.join(texts, "id").where(holds).select("term", "id")
        short = terms.where(F.length("term") < 3)
        if short.isEmpty():
            return long.distinct()
        # A few short terms beside each text of one pass.
        held = F.array(*[F.lit(r.term) for r in short.collect()])
        few = texts.select("id", F.explode(F.filter(held, lambda term: F.contains(F.lower("text"), F.lower(term)))).alias("term")).select("term", "id")
        return long.unionByName(few).distinct()
