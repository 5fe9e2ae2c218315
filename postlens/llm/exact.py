"""Exact dedup by content sort.

Spark samples splitters over (leading bytes, content hash, id) and range-partitions the normalised
texts by them: the sampled keys stay short however long the texts are, and as the id is the last
part of a splitter, a text that a third of all rows repeat is spread over many partitions. Each
partition is sorted externally by the whole normalised bytes, so equal texts stand next to each
other; neighbours are compared in full, which cuts the partition into runs. From there on only
narrow rows travel: runs of one text in neighbouring partitions meet by their SHA-256 digest, and
every row finds its run by the run's number, so no task gathers a whole group.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import partitions, saved, without_blanks

LEAD = 64


def _mark_runs(batches):
    """Numbers the runs of equal neighbours of one sorted partition, over batch borders."""
    part, run, order, last, digest = TaskContext.get().partitionId(), -1, 0, None, ""
    for batch in batches:
        runs, digests = [], []
        for value in batch.column(2).to_pylist():
            if value != last:
                run, last, digest = run + 1, value, hashlib.sha256(value).hexdigest()
            runs.append(run)
            digests.append(digest)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(range(order, order + n), pa.int64()), pa.array(digests, pa.string())],
            ["_id", "_chars", "_part", "_run", "_order", "text_sha256"],
        )
        order += n


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups equal texts: one row per row of ``docs`` with ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after every blank is deleted; null counts as empty. Of equal
    texts the one with the most code points before deletion stays, then the smallest id, then (rows
    repeated with their id) the first in sorted order, so exactly one row of a group is kept.
    Rows with a null id take part and stay only if no other row of the group has as many code points.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.length(whole).cast("long").alias("_chars"), without_blanks(whole).cast("binary").alias("_norm"))
    placed = source.repartitionByRange(partitions(spark), F.substring("_norm", 1, LEAD), F.xxhash64("_norm"), F.col("_id"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = saved(
        placed.sortWithinPartitions("_norm", "_id").mapInArrow(_mark_runs, f"_id {id_type}, _chars long, _part int, _run long, _order long, text_sha256 string")
    )
    rank = F.struct((-F.col("_chars")).alias("_less"), F.col("_id").isNull().alias("_none"), "_id", "_part", "_order")
    runs = saved(rows.groupBy("_part", "_run").agg(F.first("text_sha256").alias("_sha"), F.count(F.lit(1)).alias("_size"), F.min(rank).alias("_best")))
    texts = runs.groupBy("_sha").agg(F.sum("_size").alias("group_size"), F.min("_best").alias("_best"))
    named = saved(runs.select("_part", "_run", "_sha").join(texts, "_sha").drop("_sha"))
    stays = (F.col("_best._part") == F.col("_part")) & (F.col("_best._order") == F.col("_order"))
    return (
        rows.join(named, ["_part", "_run"])
        .select(F.col("_id").alias(doc_id), F.col("_best._id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")
    )
