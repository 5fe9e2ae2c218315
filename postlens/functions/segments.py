"""Ordered per-key functions that survive a key holding a third of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. These helpers cut each key
into segments (normally a time bucket), run the window inside ``(key, segment)`` and stitch the
segments together over a table with one row per ``(key, segment)``. Results equal the plain
window; the largest task is one segment of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stitch(df: DataFrame, keys: Sequence[str], seg: str, carry: DataFrame) -> DataFrame:
    """Null-safe left join on (keys, segment)."""
    right = carry
    cond = None
    for name in [*keys, seg]:
        right = right.withColumnRenamed(name, f"_r_{name}")
        part = F.col(name).eqNullSafe(F.col(f"_r_{name}"))
        cond = part if cond is None else cond & part
    return df.join(right, cond, "left").drop(*[f"_r_{n}" for n in [*keys, seg]])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    seg: str,
    order: Sequence[str],
    value: Column,
    out: str,
    ahead: bool = False,
    only: Column | None = None,
) -> DataFrame:
    """The closest earlier (or later, ``ahead``) non-NULL ``value`` of the same key.

    ``only`` restricts which rows may supply the value. ``order`` must be total within a key.
    """
    supplied = value if only is None else F.when(only, value)
    work = df.withColumn("_v", supplied)
    inner = Window.partitionBy(*keys, seg).orderBy(*order)
    if ahead:
        frame = inner.rowsBetween(1, Window.unboundedFollowing)
        work = work.withColumn("_in", F.first("_v", ignorenulls=True).over(frame))
        pick = F.min_by
    else:
        frame = inner.rowsBetween(Window.unboundedPreceding, -1)
        work = work.withColumn("_in", F.last("_v", ignorenulls=True).over(frame))
        pick = F.max_by
    edge = (
        df.withColumn("_v", supplied)
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, seg)
        .agg(pick(F.col("_v"), F.struct(*order)).alias("_edge"))
    )
    segs = df.select(*keys, seg).distinct()
    across = Window.partitionBy(*keys).orderBy(seg)
    if ahead:
        carry = F.first("_edge", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    else:
        carry = F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = _stitch(segs, keys, seg, edge).withColumn("_carry", carry).drop("_edge")
    return (
        _stitch(work, keys, seg, carried)
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_v", "_in", "_carry")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    seg: str,
    order: Sequence[str],
    value: Column,
    out: str,
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Running sum or max of ``value`` over a key, up to (and with, if ``inclusive``) each row."""
    agg = {"sum": F.sum, "max": F.max}[how]
    inner = Window.partitionBy(*keys, seg).orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    work = df.withColumn("_x", value)
    totals = work.groupBy(*keys, seg).agg(agg("_x").alias("_tot"))
    across = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", agg("_tot").over(across)).drop("_tot")
    joined = _stitch(work.withColumn("_in", agg("_x").over(frame)), keys, seg, before)
    if how == "sum":
        merged = F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))
    else:
        merged = F.greatest("_in", "_before")
    return joined.withColumn(out, merged).drop("_x", "_in", "_before")
