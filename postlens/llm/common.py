"""Pieces that several operators share."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder and read from there, with its lineage cut.

    The cluster names a folder that all executors reach in ``spark.checkpoint.dir``; only where
    that is unset (tests) a temporary folder is taken.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="postlens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more.

    Its cleaner removes them when the driver's JVM collects garbage, which a driver with little to do
    may put off until long after a next round has filled the disks. What Python held is let go in the JVM
    one collection later, and the files go after that, so it takes some turns.
    """
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder itself, for operators that write files there."""
    saved(spark.range(0))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII texts take the built-in's fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def without_blanks(text: Column) -> Column:
    """The text with every space and control from tab to carriage return deleted."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row are kept for testing: crc32 of the id's decimal text mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
