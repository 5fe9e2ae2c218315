"""Filter interaction audit: what each filter removes, depending on the filters applied before it.

Every filter is a stored relation of failing ids, so filters can be judged by different jobs at
different times. Documents and failing ids are written once, dealt out and sorted by the same key;
all later joins are merge joins of matching partitions without any shuffle. What survives a prefix
of an order depends on the set of its filters only, so the 2^n sets stand for all n! orders: one
left-anti join per filter walks from each set to the set with that filter, one left-semi join per
filter finds what it would remove from each set. Documents that no filter fails survive every
prefix; left-anti joins set them apart and they are only counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import partitions, saved

KEY = ["_k1", "_k2"]
#: Maximal runs between blanks are words.
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that name a row by its id and text; rows that repeat both share them, a null id has some too."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.struct(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), whole)
    return [F.xxhash64(named).alias(KEY[0]), F.xxhash64(F.lit("second"), named).alias(KEY[1])]


def placed(ids: DataFrame) -> DataFrame:
    """A stored relation, dealt out and sorted by its key: it meets others like it without a shuffle.

    An adaptive plan doesn't tell what it was dealt out by, so the write itself is planned without.
    """
    conf = ids.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return saved(ids.repartition(partitions(ids.sparkSession), *KEY).sortWithinPartitions(*KEY))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def marked(rows: DataFrame, ids: DataFrame, name: str, on: str = "_id") -> DataFrame:
    """The rows with a boolean: left-semi for those whose id ``ids`` holds, left-anti for the others."""
    return rows.join(ids, on, "left_semi").withColumn(name, F.lit(True)).unionByName(rows.join(ids, on, "left_anti").withColumn(name, F.lit(False)))


def text_filters(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source",
    min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, marks: str = "[#$%&*|]",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows ``(_k1, _k2, _id, _part)`` of ``docs`` and the failing keys of five filters over whole texts.

    A: fewer than ``min_words`` words. B: distinct words below ``distinct_percent`` of all words. C: capitals
    A-Z above ``capital_percent`` of the code points. D: holds one of ``marks``. E: the text of a row with a
    smaller id. Null text counts as empty, a null part as the empty string. A null id is neither smaller
    nor larger than another, so it takes no part in E. Texts are read once; from there on rows are narrow.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(whole, BLANK_RUN), lambda w: w != "")
    facts = docs.select(
        *row_key(doc_id, text),
        F.col(f"`{doc_id}`").alias("_id"),
        F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("_part"),
        F.unhex(F.sha2(whole, 256)).alias("_sha"),
        F.length(whole).cast("long").alias("_chars"),
        F.regexp_count(whole, F.lit("[A-Z]")).cast("long").alias("_capitals"),
        whole.rlike(marks).alias("_marked"),
        words.alias("_words"),
    )
    n = F.size("_words").cast("long")
    rows = saved(
        facts.select(
            *KEY, "_id", "_part", "_sha",
            (n < min_words).alias("A"),
            (F.size(F.array_distinct("_words")).cast("long") * 100 < n * distinct_percent).alias("B"),
            (F.col("_capitals") * 100 > F.col("_chars") * capital_percent).alias("C"),
            F.col("_marked").alias("D"),
        )
    )
    failing = {name: placed(rows.where(F.col(name)).select(*KEY)) for name in "ABCD"}
    # One row per text after map-side sums; only texts under several ids go on, and adaptive execution splits a hot one.
    first = rows.where(F.col("_id").isNotNull()).groupBy("_sha").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where(F.col("_first") < F.col("_last"))
    failing["E"] = placed(rows.join(first, "_sha").where(F.col("_id") > F.col("_first")).select(*KEY))
    return rows.select(*KEY, "_id", "_part"), failing


def _without(left: DataFrame, ids: DataFrame, how: str, only: Column | None = None) -> DataFrame:
    right = ids.select(*[F.col(k).alias(f"_r{k}") for k in KEY])
    match = reduce(lambda a, b: a & b, [left[k] == right[f"_r{k}"] for k in KEY])
    return left.join(right, match if only is None else match & only, how)


def filter_audit(rows: DataFrame, failing: Mapping[str, DataFrame], losses: Mapping[str, DataFrame], orders: Sequence[str] | None = None) -> DataFrame:
    """One row per part, filter order and step, zeros included.

    ``rows``: ``(_k1, _k2, _id, _part)``; ``failing``: per filter, named by one letter, a stored relation of
    keys (``placed``); ``losses``: per output column a relation of ids ``(_id)`` whose removal is
    counted, null and repeated ids allowed; ``orders``: strings of filter names, all permutations by default.
    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails``, the losses and
    ``shapley``, the filter's removals summed over all steps of all ``orders``. Rows that repeat a
    key each count. An empty table gives no rows; a part that nothing fails gives zeros.
    """
    names = list(failing)
    orders = list(orders) if orders is not None else ["".join(o) for o in permutations(names)]
    for name, ids in losses.items():
        rows = marked(rows, ids.select("_id").where(F.col("_id").isNotNull()).distinct(), name)
    rows = placed(rows.drop("_id"))

    clean = reduce(lambda left, name: _without(left, failing[name], "left_anti"), names, rows)
    parts = rows.groupBy("_part").agg(F.lit(0).alias("_any")).select("_part")
    spared = clean.groupBy("_part").agg(F.count(F.lit(1)).alias("_spared"))

    # Survivors of every set of filters, the set as bits: each row goes on with and without the next filter.
    alive = _without(rows, clean, "left_anti").withColumn("_set", F.lit(0))
    for bit, name in enumerate(names):
        alive = alive.withColumn("_use", F.explode(F.array(F.lit(False), F.lit(True))))
        alive = _without(alive, failing[name], "left_anti", F.col("_use"))
        alive = alive.withColumn("_set", F.col("_set").bitwiseOR(F.when(F.col("_use"), F.lit(1 << bit)).otherwise(F.lit(0)))).drop("_use")
    alive = saved(alive)

    survivors = alive.groupBy("_part", "_set").agg(F.count(F.lit(1)).alias("_alive"))
    counted = [F.count(F.lit(1)).alias("removed"), *[F.sum(F.col(name).cast("long")).alias(name) for name in losses]]
    gone = [
        _without(alive.where(F.col("_set").bitwiseAND(1 << bit) == 0), failing[name], "left_semi")
        .groupBy("_part", "_set").agg(*counted).withColumn("_bit", F.lit(1 << bit))
        for bit, name in enumerate(names)
    ]
    removals = saved(reduce(DataFrame.unionByName, gone))
    everything = (1 << len(names)) - 1
    alone = removals.groupBy("_part", "_bit").agg(
        F.sum(F.when(F.col("_set") == 0, F.col("removed"))).alias("_fails"),
        F.sum(F.when(F.col("_set") == F.lit(everything) - F.col("_bit"), F.col("removed"))).alias("unique_fails"),
    )

    bits = F.create_map(*[F.lit(x) for bit, name in enumerate(names) for x in (name, 1 << bit)])
    order, step = F.col("filter_order"), F.col("step")
    before = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.when(i < step - 1, bits[order.substr(i + 1, F.lit(1))]).otherwise(F.lit(0))), F.lit(0), lambda a, b: a + b)
    steps = (
        parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
        .withColumn("_set", before)
        .withColumn("_bit", bits[order.substr(step, F.lit(1))])
        .withColumn("_after", F.col("_set") + F.col("_bit"))
    )
    told = (
        steps.join(removals, ["_part", "_set", "_bit"], "left")
        .join(alone, ["_part", "_bit"], "left")
        .join(survivors.withColumnRenamed("_set", "_after"), ["_part", "_after"], "left")
        .join(spared, "_part", "left")
        .na.fill(0)
    )
    told = saved(told)
    shapley = told.groupBy("_part", "_bit").agg(F.sum("removed").alias("shapley"))
    return told.join(shapley, ["_part", "_bit"]).select(
        F.col("_part").alias("part"), "filter_order", "step", (F.col("_alive") + F.col("_spared")).alias("kept"), "removed",
        (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", *losses, "shapley",
    )
