"""Replaying a landed table as a stream, and running a stream to its end into a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.session import shared_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table's files as a stream, a bounded number of files per micro-batch.

    The table is a folder of files of any name or a single file: the pattern in the path makes the
    stream list what it matches, either way.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path.removesuffix("t") + "[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.fieldNames() else rows


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over everything available and reads the written table back."""
    spark = stream.sparkSession
    path = shared_dir(spark, name)
    (stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_update(stream: DataFrame, name: str, key: str) -> DataFrame:
    """Runs an update-mode stream; each micro-batch is written under its number, and the newest row per key is read back."""
    spark = stream.sparkSession
    path = shared_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # rewriting a retried batch is harmless

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/check").outputMode("update").trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(f"{path}/out")
    names = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("_s")).select(key, "_s.*")
