"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch carries to a Python worker, the same for every operator. Texts can be very long.
BATCH_BYTES = 2 << 20
#: Tables whose rows take long in a task.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; the path may be one that only Spark can open.

    A table of texts that has fewer splits than the session has cores is dealt out to all of them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def python_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that a Python worker's memory does not depend on the table.

    It is one value for all operators, so a lazy result does not depend on what was called since. Workers also look
    for this library where the driver found it; clusters get it by --py-files or an image.
    """
    root, environment = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and all is one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        set_already = context._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodemap-')}"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and a lost executor costs no rerun."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one computation in the shared folder, removed at its end: `with Tables(spark) as tables`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """`written`, until the end of the block."""
        path = scratch(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        java, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in map(java.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(conf).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Let the driver's JVM collect what finished jobs left: Spark's cleaner removes their shuffles and broadcasts only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """`df` with the fields `names` of a struct as columns; columns of `df` of these names are replaced."""
    other = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), struct.alias("new"))
    return held.select("row.*", *[f"new.{n}" for n in names])


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))
