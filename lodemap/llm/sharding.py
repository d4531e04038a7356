"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash. Pass two shuffles each
bucket (Spark's shuffle() is a Fisher-Yates shuffle of an array) and writes it. The records then have a global
order: buckets one after another, each in its shuffled order. Shards are even stretches of that order, so their
row counts differ by one at most, and a bucket is written to one or two shards without a second exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.llm.common import scratch, table, written

#: Bytes of text that a bucket holds in the mean.
BUCKET_BYTES = 16 << 20


def _scattered(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with `text_key` and `copy`, which with doc_id tell every row from every other one.

    text_key is empty and copy 0 where a doc_id stands once. Rows that share a doc_id (or have none) take the SHA-256 of
    their text, none for a null; rows equal in both are one record and a count, dealt out again with a number each. So no id and no text,
    however often it is there, lands in one bucket.
    """
    rows = docs.select("doc_id", "text")
    repeated = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated")
    none = F.lit(0).cast("long")
    if repeated.isEmpty():
        return rows.withColumns({"text_key": F.lit(""), "copy": none})
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    single = rows.join(repeated, same, "left_anti").withColumns({"text_key": F.lit(""), "copy": none})
    keyed = rows.join(repeated, same, "left_semi").withColumn("text_key", F.coalesce(F.sha2("text", 256), F.lit("none")))
    copies = keyed.groupBy("doc_id", "text_key").agg(F.min("text").alias("text"), F.count("*").alias("n"))
    return single.unionByName(copies.select("doc_id", "text", "text_key", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")))


def shuffle_to_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write every row of `docs` (doc_id, text) to `path`/shard=N in a random order; return the files as a DataFrame.

    Columns: doc_id, text, size (UTF-8 bytes and 16), text_crc32, slot (place in the shard, gapless from 0), shard.
    A null text has no bytes and the crc32 of nothing; null, repeated and tied ids are rows like others. The
    bucket depends on the row and the seed alone and a bucket's place on its number, so a task that runs again
    makes the same rows. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = _scattered(docs)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    total = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(shards, -(-int(total["bytes"] or 0) // bucket_bytes))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key", "copy", F.lit(seed)), F.lit(buckets)))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    record = F.struct("doc_id", "text_key", "copy", "text")
    packed = placed.repartition(buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(record)).alias("records"))
    # shuffle() draws from the seed and the task's number, for one row after another: the sort fixes their order.
    shuffled = packed.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", seed).alias("records"))
    dealt = shuffled.join(offsets, "bucket").select("before", F.posexplode("records").alias("at", "r")).select("r.*", (F.col("before") + F.col("at")).alias("place"))
    # Shard s is the stretch of places from floor(s n / shards) on.
    n = max(1, total["n"])
    shard = F.expr(f"((place + 1) * {shards}L - 1) div {n}L")
    out = dealt.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"place - (shard * {n}L) div {shards}L"))
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    out = out.select("doc_id", "text", size.alias("size"), crc.alias("text_crc32"), "slot", "shard").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema("doc_id long, text string, size long, text_crc32 long, slot long, shard int").parquet(path)


def op10_external_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law `rows`, as read back from the shard files."""
    written_shards = shuffle_to_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"), shards=40)
    return written_shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
