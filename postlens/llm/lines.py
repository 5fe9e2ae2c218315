"""Line dedup: lines that many documents share are dropped from all but one of them.

Plan: each document is exploded into lines, each line reduced to a 128-bit hash of its normalised
form, and documents are counted per hash with map-side aggregation, so a line that stands in a
third of all documents costs one row per task and hash. Only the hashes above the threshold are
joined back to the (document, position) rows; the join is a plain shuffle join of two exchanges,
which adaptive execution splits where one line is hot. Texts meet their dropped positions by
document and are reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import BLANKS, ascii_lower, saved


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops repeated lines; returns the columns of ``docs`` with ``kept_text``, ``n_lines``, ``n_dropped``.

    A line's key is the line with blanks stripped at both ends and A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` different documents lose all their
    lines except in the largest ``doc_id`` that holds them (there all of them stay).

    Null or empty text: one empty line, kept as the empty text. Null id: the row passes unchanged and
    does not count. Rows that repeat an id count as one document. A column of ``docs`` named as
    one of the three new columns is replaced; others pass whatever they are called. An empty table
    gives an empty table.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(whole).alias("_sig"), F.split(whole, "\n").alias("_lines"))
    lines = (
        source.where(F.col("_id").isNotNull())
        .select("_id", "_sig", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_sig", "_pos", F.btrim("_line", F.lit(BLANKS)).alias("_line"))
        .where(F.length("_line") >= min_chars)
        .select("_id", "_sig", "_pos", ascii_lower(F.col("_line")).alias("_key"))
        .select("_id", "_sig", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))
    )
    common = saved(
        lines.groupBy("_h1", "_h2")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_last"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2", "_last")
    )
    dropped = (
        lines.join(common, ["_h1", "_h2"])
        .where(F.col("_id") < F.col("_last"))
        .groupBy("_id", "_sig")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    new = ["kept_text", "n_lines", "n_dropped"]
    passing = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(whole).alias("_sig"), F.split(whole, "\n").alias("_lines"))
    merged = passing.join(dropped, ["_id", "_sig"], "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.array_join(F.transform(places, lambda i: F.element_at("_lines", i + 1)), "\n")
    return merged.select("_row.*", kept.alias("kept_text"), F.size("_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
