"""Session defaults. Everything here is a setting a cluster operator may override."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the defaults above; values already set by the cluster stay as they are."""
    builder = SparkSession.builder.appName("postlens")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Set to "true" where inputs are a few large row groups: heavy row work is then dealt over all cores first.
SPREAD = "spark.postlens.spread"


def spread(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key and the given columns; dealt out by key if the session asks for it, else left where they were read.

    Row-local operators need no shuffle. Only a file with a single row group would leave them one core.
    """
    rows = docs.select(key, *columns)
    return rows.repartition(key) if docs.sparkSession.conf.get(SPREAD, "false") == "true" else rows


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder, for stream state and written tables.

    The cluster names a folder every executor can reach in ``spark.checkpoint.dir``.
    Only where it is unset in local mode (tests) a temporary folder is made and recorded there;
    on a cluster that would be another folder on each machine, so it has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="postlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"
