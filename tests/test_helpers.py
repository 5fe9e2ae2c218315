"""Segmented windows, salting and rule lengths against their plain forms."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions.joins import lengths, salted_join
from postlens.functions.segments import neighbour, running


def _events(spark):
    random.seed(7)
    # One key holds most rows; another has gaps between segments.
    data = [("hot" if random.random() < 0.7 else random.choice(["a", "b"]), random.randrange(0, 1000), i, random.random() < 0.3) for i in range(600)]
    return spark.createDataFrame(data, "k string, t int, id int, ok boolean").withColumn("seg", F.floor(F.col("t") / 50))


def test_neighbour_equals_plain_window(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    value = F.when(F.col("ok"), F.col("id"))
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    want = {r.id: (r.b, r.a) for r in df.select("id", back.alias("b"), ahead.alias("a")).collect()}
    got = neighbour(df, ["k"], "seg", ["t", "id"], F.col("id"), "b", only=F.col("ok"))
    got = neighbour(got, ["k"], "seg", ["t", "id"], F.col("id"), "a", ahead=True, only=F.col("ok"))
    assert {r.id: (r.b, r.a) for r in got.collect()} == want


def test_running_equals_plain_window(spark):
    df = _events(spark)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in df.select("id", F.sum("t").over(w).alias("s")).collect()}
    got = running(df, ["k"], "seg", ["t", "id"], F.col("t"), "s")
    assert {r.id: r.s for r in got.collect()} == want


def test_salted_join_is_exact(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("none", 3)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert salted_join(left, right, ["k"], how, salts=4).count() == left.join(right, "k", how).count()


def test_rule_length(spark):
    rules = spark.createDataFrame([("one",), ("natural language processing pipelines",)], "term string")
    one = spark.range(1)
    assert one.select(lengths(rules, "term", " ").alias("n")).first().n == [1, 4]
    assert one.select(lengths(rules.where("false"), "term", " ").alias("n")).first().n == []
