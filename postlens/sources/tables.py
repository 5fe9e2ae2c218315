"""Reading the input tables. Parquet readers prune columns and push filters by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log with ``ts`` as a real timestamp, which watermarks and sessions need."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page scan every extractor starts from; rows without a url or body are refused."""
    return (
        table(spark, folder, "pages")
        .select("page_id", "url", "html")
        .where((F.trim("url") != "") & (F.trim("html") != ""))
    )
