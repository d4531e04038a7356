"""Session events as a stream: the same report as in batch, by watermark and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files of a folder as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, start, end, events) of events (user_id, ts): runs without a pause of `gap`.

    State is held per open session and dropped when the watermark has passed it; later events are not counted.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(F.col("user_id").alias("session_id"), F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))
    return found.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def log(events: DataFrame, folder: str, checkpoint: str, late: str = "1 hour", keep: int = 100_000):
    """A running query that appends events (event_id, ts, props, others) to a log: each event_id once, payloads cut to `keep` characters.

    Events that come again within the watermark are dropped by state, which is kept no longer than that. A batch is written
    to a folder of its own number, whole or anew, so a batch that runs again after a failure adds nothing.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    cut = timed.withColumn("props", F.substring("props", 1, keep)).drop("at")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return cut.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark, folder: str) -> DataFrame:
    """The events of a log, without the batches that brought them."""
    return spark.read.option("basePath", folder).schema(SCHEMA + ", batch int").parquet(folder).drop("batch")
