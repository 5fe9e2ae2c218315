"""Join helpers: rule lengths, a sieve for scans against rules, and salting for keys that may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lengths(rules: DataFrame, column: str, split: str) -> Column:
    """The numbers of words that rules have, ascending: which spans of a text can meet a rule.

    A scalar subquery: it is part of the plan that uses it, and no job runs before that.
    """
    return rules.agg(F.array_sort(F.collect_set(F.size(F.split(column, split))))).scalar()


#: Bits of a sieve: 128 kB, whatever the number of rules.
SIEVE_BITS = 20


def sieve(rules: DataFrame, on: Sequence[str]) -> Column:
    """Whether a row's key can be among the rules: a bitmap of key hashes, built by a scalar subquery.

    No key of the rules is ever refused. With up to some hundred thousand rules nearly all other
    keys are, so a scan's hits are all that a join behind it has to move; with many more it lets
    everything pass, and the join does the work alone.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << SIEVE_BITS))
    words = rules.select(F.shiftright(place, 6).alias("_w"), F.expr("1L").alias("_one"), (place % 64).cast("int").alias("_b"))
    words = words.select("_w", F.expr("shiftleft(_one, _b)").alias("_bits"))
    dense = words.unionByName(rules.sparkSession.range(1 << (SIEVE_BITS - 6)).select(F.col("id").alias("_w"), F.lit(0).cast("long").alias("_bits")))
    dense = dense.groupBy("_w").agg(F.bit_or("_bits").alias("_bits"))
    packed = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_bits"))), lambda s: s["_bits"])).scalar()
    return F.getbit(F.element_at(packed, (F.shiftright(place, 6) + 1).cast("int")), (place % 64).cast("int")) == 1


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join that splits every left key over ``salts`` partitions.

    Left rows get a salt from a hash of the whole row, right rows are repeated once per salt,
    so a key holding a third of the left side is spread over ``salts`` tasks. Exact for
    inner, left, left semi and left anti joins.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("salting keeps every left row in one salt: inner and left joins only")
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
