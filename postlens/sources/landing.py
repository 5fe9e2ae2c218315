"""Sources and sinks: queues, url lists, reference tables, API payloads, history and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.text import big, literal_map, squeeze
from postlens.operators.postings import tags_to_text
from postlens.rules import postings as R

# Accented letters and their plain forms, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžłśźżćńęąőű"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyszlszzcneaou"


def fold_accents(col):
    return F.translate(col, ACCENTED, PLAIN)


def queue_columns(names: Sequence[str]) -> dict[str, str]:
    """Header → canonical queue column, by the first fragment the lower-cased header contains."""
    out = {}
    for name in names:
        for canonical, fragments in R.QUEUE_HEADERS:
            if any(f in name.lower() for f in fragments):
                out[name] = canonical
                break
    return out


def as_queue(rows: DataFrame, id_column: str | None = None) -> DataFrame:
    """Queue rows from a table whose headers merely resemble the canonical ones.

    ``id`` follows the input order: the given column, or Spark's per-partition increasing id.
    No global row_number is taken, since that would pull the queue through one task.
    """
    mapping = queue_columns([n for n in rows.columns if n != id_column])
    ids = F.col(id_column) if id_column else F.monotonically_increasing_id()
    picked = {}
    for header, canonical in mapping.items():  # a later header of the same kind wins
        picked[canonical] = F.nullif(F.trim(F.col(f"`{header}`")), F.lit(""))
    null = F.lit(None).cast("string")
    return rows.select(
        big(ids).alias("id"),
        picked.get("job_url", null).alias("job_url"),
        F.coalesce(picked.get("candidate_name", null), F.lit("")).alias("candidate_name"),
        F.coalesce(picked.get("email", null), F.lit("")).alias("email"),
        F.coalesce(picked.get("phone", null), F.lit("")).alias("phone"),
        F.coalesce(F.lower(picked.get("priority", null)), F.lit("medium")).alias("priority"),
        F.coalesce(picked.get("notes", null), F.lit("")).alias("notes"),
        F.lit("pending").alias("status"),
        F.lit(True).alias("selected"),
    ).where(F.col("job_url").isNotNull())


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return as_queue(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path))


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed http(s) urls, one per line."""
    url = squeeze(column)
    return lines.select(url.alias("job_url")).where(F.col("job_url").rlike(r"(?i)^https?://"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_list(spark.read.text(path))


def append_urls(queue: DataFrame, urls: DataFrame) -> DataFrame:
    """Urls behind an existing queue, with the queue's defaults filled in."""
    base = as_queue(urls.select("job_url"))
    last = queue.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    moved = base.withColumn("id", F.col("id") + last + 1)
    return queue.unionByName(moved)


def load_cities(rows: DataFrame) -> DataFrame:
    """(city_key, country_iso2): lower-cased name and its unaccented form; the best-ranked country keeps a shared key."""
    ranks = {code: i for i, code in enumerate(R.COUNTRY_PRIORITY)}
    name, country = F.lower(F.trim("name")), F.upper(F.trim("country"))
    keyed = (
        rows.select(name.alias("_n"), country.alias("country_iso2"))
        .where((F.col("_n") != "") & (F.col("country_iso2") != ""))
        .select(F.explode(F.array_distinct(F.array("_n", fold_accents(F.col("_n"))))).alias("city_key"), "country_iso2")
    )
    rank = F.coalesce(F.try_element_at(literal_map(ranks), F.col("country_iso2")), F.lit(999))
    return keyed.groupBy("city_key").agg(F.min_by("country_iso2", F.struct(rank, "country_iso2")).alias("country_iso2"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return load_cities(spark.read.json(path))


def country_key(col):
    """Lookup form of a country name: unaccented, lower case, letters, digits and single blanks."""
    return squeeze(F.regexp_replace(fold_accents(F.lower(col)), r"[^a-z0-9 ]+", " "))


def load_countries(rows: DataFrame) -> DataFrame:
    """(key, iso2, name, capital): one row per code, name and alias; the lowest code keeps a shared key."""
    keys = F.array_distinct(F.transform(
        F.concat(F.array("iso2", "name"), F.coalesce("aliases", F.array().cast("array<string>"))), country_key))
    flat = rows.select(F.explode(keys).alias("key"), "iso2", "name", "capital").where(F.col("key") != "")
    best = F.struct("iso2", "name", "capital")
    return flat.groupBy("key").agg(F.min(best).alias("_b")).select("key", "_b.*")


def posting_from_api(payloads: DataFrame, paths: Mapping[str, Mapping[str, str]] = R.API_PATHS,
                     min_chars: int = 80) -> DataFrame:
    """Posting fields out of landed JSON by per-platform paths; ``found`` is false for thin answers."""
    node = F.try_parse_json("payload")
    work = payloads.withColumn("_v", node)

    def field(name):
        out = F.lit(None).cast("string")
        for platform, fields in paths.items():
            if name in fields:
                out = F.when(F.col("platform") == platform, F.try_variant_get("_v", fields[name], "string")).otherwise(out)
        return out

    work = work.withColumn("description", tags_to_text(F.coalesce(field("description"), F.lit(""))))
    found = F.length("description") >= min_chars

    def kept(name):
        return F.when(F.col("found"), F.coalesce(F.trim(field(name)), F.lit(""))).otherwise("")

    work = work.withColumn("found", found)
    return work.withColumns({n: kept(n) for n in ("title", "company", "location", "job_id")}).withColumn(
        "description", F.when(F.col("found"), F.col("description")).otherwise("")).drop("_v")


def append_history(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a date-partitioned history; retention is applied on read (see history.keep_last)."""
    df.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def stream_history(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """The same sink for a stream; exactly-once through the file sink's log."""
    return (stream.withColumn("dt", F.to_date(ts)).writeStream.format("parquet").partitionBy("dt")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


def export_report(df: DataFrame, path: str, by: Sequence[str] = ("event_type",)) -> None:
    """Rows as JSON lines below ``rows`` and counts per group below ``summary``."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.groupBy(*by).agg(big(F.count("*")).alias("n")).write.mode("overwrite").json(f"{path}/summary")
