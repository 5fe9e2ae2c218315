"""Mixing sources to target weights by drawing fixed-length blocks of words.

Each source's words form one stream that is cut into blocks of ``block`` words. Output shards draw how
many of their slots each source fills; a source's k-th slot takes the block that a pseudorandom
permutation of the source's block numbers puts at place k, with another permutation for each time
around. So every block of a source is used equally often, up to one, and slots find their blocks by an
equi-join on (source, block number). Only narrow rows are shuffled: sizes, blocks and slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import saved

WEIGHTS = (5, 2, 1)
_WORD = r"[^\x20\x09-\x0D]+"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place ``index`` of the pseudorandom permutation of ``range(size)`` that ``key`` names.

    A four-round Feistel network on the next even number of bits; places outside ``size`` are walked on
    until they fall inside, which keeps it a permutation.
    """
    index, size, key = (np.asarray(x).astype(np.uint64) for x in (index, size, key))
    half = np.uint64(1) + np.array([(int(n - 1).bit_length() - 1) // 2 if n > 1 else 0 for n in size.tolist()], np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & low[todo]
        for turn in range(4):
            left, right = right, left ^ (_scramble(right + _scramble(key[todo] + np.uint64(turn))) & low[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(_id, _sig, _source, size)`` of every row: words are runs without ASCII blanks, null has none."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(whole).alias("_sig"), F.col(f"`{source}`").cast("string").alias("_source"),
        F.regexp_count(whole, F.lit(_WORD)).cast("long").alias("size"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``(_source, _no, source_size, target)``: shares of all words by weight, none above ``most`` times its size.

    Sources are numbered by code point, null last, and take the weights in turn. What a capped
    source leaves is shared by weight among the others until none is above its cap: with the sources
    ordered by cap / weight, the first that its share does not exceed ends the capped ones. The windows
    run over one row per source, in one task.
    """
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    named = totals.withColumn("_no", F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_no") - 1) % len(weights) + 1).cast("int"))
    capped = named.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most)).withColumn("_order", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_order", "_no")
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    level = capped.withColumn("_level", (everything - before) / after)
    first = F.first(F.when(F.col("_level") <= F.col("_order"), F.col("_level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("_share", F.coalesce(first, F.col("_order")) * F.col("_w")).select("_source", "_no", "source_size", F.least("_cap", "_share").alias("target"))


def draw(wanted: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """Multinomial source counts of each output shard (rows) of ``slots`` slots.

    Each shard draws by what its sources still have to deliver, so the shards' sums come out exactly; a
    draw above the rest of a source is drawn again among the others.
    """
    rest, rng, shards = wanted.astype(np.int64).copy(), np.random.default_rng(seed), []
    while (left := int(rest.sum())) > 0:
        now, count = min(slots, left), np.zeros_like(rest)
        while (open_slots := now - int(count.sum())) > 0:
            chance = (rest - count) / (rest - count).sum()
            count = np.minimum(count + rng.multinomial(open_slots, chance), rest)
        shards.append(count)
        rest -= count
    return np.array(shards, np.int64).reshape(len(shards), len(rest))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block numbers of the slots of (shard, source) rows."""
    for batch in batches:
        for no, first, count, blocks, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for start in range(first, first + count, 65_536):
                k = np.arange(start, min(start + 65_536, first + count), dtype=np.int64)
                keys = _scramble(np.full(len(k), key & 0xFFFFFFFFFFFFFFFF, np.uint64) + (k // blocks).astype(np.uint64))
                at = permuted(k % blocks, np.full(len(k), blocks), keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), no, np.int32)), pa.array(at)], ["_no", "_block"])


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``_start``, where each row's words begin in its source's stream.

    The stream's order is by a hash bucket of the id and then by id, so a source with a third of all rows is
    summed bucket by bucket; the buckets' sums are summed per source over as many rows as there are buckets.
    """
    n = rows.count()
    buckets = max(16, int(n**0.5))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_sig"), F.lit(buckets)))
    inside = Window.partitionBy("_no", "_bucket").orderBy("_id", "_sig").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_no", "_bucket").agg(F.sum("size").alias("_sum")).select("_no", "_bucket", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_ahead"))
    counted = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return counted.join(ahead, ["_no", "_bucket"]).withColumn("_start", F.col("_ahead") + F.col("_in")).drop("_bucket", "_in", "_ahead")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    most: int = 3, block: int = 64, shard_slots: int = 65_536, seed: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Draws the mix. Returns (rows, pieces).

    ``rows``: one per row of ``docs``: ``_id, _sig, _source, _start, _no, size, source_size, target, taken``. ``pieces``: for the
    parts of a row that one block holds, ``_no, _start``, the first and past-the-last word in the row and
    ``uses``, how often the block was drawn. Null ids and null sources are values like any other; rows without words take
    part with size 0. The same input gives the same mix, however it is partitioned. An empty table gives empty frames.
    Sources' targets (one row per source) and shard counts are what the driver sees.
    """
    spark = docs.sparkSession
    sized = saved(sizes(docs, doc_id, text, source))
    targets = saved(source_targets(sized, weights, most))
    plan = targets.select("_no", "source_size", "target", F.xxhash64(F.lit(seed), "_source").alias("_key")).toPandas().sort_values("_no")
    blocks = np.maximum(-(-plan["source_size"].to_numpy(np.int64) // block), 1)
    mean = plan["source_size"].to_numpy(float) / blocks
    wanted = np.where(mean > 0, np.minimum(np.rint(plan["target"].to_numpy(float) / np.where(mean > 0, mean, 1)), most * blocks), 0).astype(np.int64)
    counts = draw(wanted, shard_slots, seed)
    firsts = np.cumsum(counts, axis=0) - counts
    shard, at = np.nonzero(counts)
    table = pd.DataFrame({"_no": plan["_no"].to_numpy(np.int32)[at], "_first": firsts[shard, at], "_count": counts[shard, at], "_blocks": blocks[at], "_key": plan["_key"].to_numpy(np.int64)[at]})
    shards = spark.createDataFrame(table, "_no int, _first long, _count long, _blocks long, _key long")
    used = shards.repartition(max(1, min(len(table), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_slots, "_no int, _block long").groupBy("_no", "_block").agg(F.count(F.lit(1)).alias("uses"))

    same = sized["_source"].eqNullSafe(targets["_source"])
    rows = saved(_placed(sized.join(targets, same).select("_id", "_sig", sized["_source"], "size", "_no", "source_size", "target")))
    held = rows.where(F.col("size") > 0).select("_no", "_start", "size", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))).alias("_block"))
    parts = held.join(used, ["_no", "_block"])
    pieces = parts.select(
        "_no", "_start", F.greatest(F.col("_block") * block - F.col("_start"), F.lit(0)).alias("_from"),
        F.least((F.col("_block") + 1) * block - F.col("_start"), F.col("size")).alias("_to"), "uses",
    )
    pieces = saved(pieces)
    taken = pieces.groupBy("_no", "_start").agg(F.sum((F.col("_to") - F.col("_from")) * F.col("uses")).alias("_taken")).withColumn("_some", F.lit(True))
    full = rows.withColumn("_some", F.col("size") > 0).join(taken, ["_no", "_start", "_some"], "left")
    return full.select("_id", "_sig", "_source", "_start", "_no", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")), pieces


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, the text holding the words that the mix takes.

    A document taken twice in full and once in part holds its text twice and then the drawn parts,
    each on lines of its own. Rows of which nothing is taken are not in the mix. Rows that repeat a whole
    row share what is taken of them. Columns of ``docs`` pass whatever they are called. Whole texts are shuffled once, by document.
    """
    rows, pieces = mix(docs, doc_id, text, source, **options)
    spans = pieces.groupBy("_no", "_start").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "uses"))).alias("_spans"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    copy = F.row_number().over(Window.partitionBy("_id", "_sig", "_source").orderBy("_start"))
    taken = rows.where("taken > 0").join(spans, ["_no", "_start"])
    keyed = taken.withColumn("_copy", copy).where("_copy = 1").select(F.col("_id").alias("_i"), F.col("_sig").alias("_s"), F.col("_source").alias("_c"), "_spans")
    # The row travels packed, so no column of it can be taken for one of these.
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    texts = docs.select(packed, F.col(f"`{doc_id}`").alias("_i0"), F.xxhash64(whole).alias("_s0"), F.col(f"`{source}`").cast("string").alias("_c0"))
    found = texts.join(keyed, F.col("_i0").eqNullSafe(F.col("_i")) & (F.col("_s0") == F.col("_s")) & F.col("_c0").eqNullSafe(F.col("_c")))

    @F.pandas_udf("string")
    def assemble(values: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([taken_text(v, [(s["_from"], s["_to"], s["uses"]) for s in ss]) for v, ss in zip(values, spans, strict=True)])

    made = found.select("_row", assemble(F.col("_row").getField(text), F.col("_spans")).alias("_new"))
    return made.select(*[F.col("_new").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def taken_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text of the words in ``spans`` (from, to, uses): round by round, neighbours in one piece."""
    at = [m.span() for m in re.finditer(_WORD, text)]
    lines = []
    whole = min((u for _, _, u in spans), default=0) if sum(t - f for f, t, _ in spans) == len(at) else 0
    lines += [text] * whole
    for turn in range(whole + 1, max((u for _, _, u in spans), default=0) + 1):
        runs: list[list[int]] = []
        for first, last, uses in sorted(spans):
            if uses >= turn:
                if runs and runs[-1][1] == first:
                    runs[-1][1] = last
                else:
                    runs.append([first, last])
        lines += [text[at[a][0] : at[b - 1][1]] for a, b in runs]
    return "\n".join(lines)
