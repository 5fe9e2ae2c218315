"""Latest-state, time-to-live and lookup operators over posting histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.joins import lengths, sieve
from postlens.functions.segments import neighbour
from postlens.functions.text import big, c, let, literal_map, percent, plain_words, squeeze

# Seconds an entry of each kind stays valid.
TTL_SECONDS = {
    "posting": 12 * 3600, "keyword": 3600, "pipeline": 1800, "profile": 300,
    "contact_hit": 7 * 86400, "contact_miss": 2 * 3600, "person": 90 * 86400,
}
LINEAGE_SECONDS = 45 * 60


def richness(description: str | Column, title=None, company=None, location=None, emails=None, keywords=None) -> Column:
    """How much a capture is worth: text length capped at 6000 over 100, plus 5, 5, 2, 8 and 4 for filled fields."""
    score = F.least(F.length(F.coalesce(c(description), F.lit(""))), F.lit(6000)) / 100
    for col, points in ((title, 5), (company, 5), (location, 2)):
        if col is not None:
            score = score + F.when(F.coalesce(c(col), F.lit("")) != "", points).otherwise(0)
    for col, points in ((emails, 8), (keywords, 4)):
        if col is not None:
            score = score + F.when(F.coalesce(F.size(c(col)), F.lit(0)) > 0, points).otherwise(0)
    return score


def upsert_richest(captures: DataFrame, key: str, capture_id: str, at: str, worth: Column, tab: str | None = None) -> DataFrame:
    """One capture per key: the richest, the later on ties; ``last_at`` and ``last_tab`` follow every capture.

    Only narrow columns are aggregated. The winning rows are fetched by id afterwards; a sieve of the
    winners' ids drops nearly all losers before that join, as long as winners are not many millions.
    """
    narrow = captures.select(key, capture_id, at, worth.alias("richness"), *([tab] if tab else []))
    extra = [F.max_by(tab, F.struct(at, capture_id)).alias("last_tab")] if tab else []
    best = narrow.groupBy(key).agg(
        F.max_by(capture_id, F.struct("richness", at, capture_id)).alias(capture_id),
        F.max("richness").alias("richness"), F.max(at).alias("last_at"), big(F.count("*")).alias("captures"), *extra)
    return captures.where(sieve(best.select(capture_id), [capture_id])).join(best.drop(key), capture_id)


def _as_of(visits: DataFrame, captures: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Per visit row the newest capture of the same keys at or before it (struct ``hit`` of at, capture_id)."""
    both = visits.select("visit_id", *keys, "at", F.lit(None).cast("long").alias("capture_id"), F.lit(1).alias("_s")).unionByName(
        captures.select(F.lit(None).cast("long").alias("visit_id"), *keys, "at", "capture_id", F.lit(0).alias("_s")))
    both = both.withColumn("_seg", F.date_trunc(bucket, "at")).withColumn("_id", F.coalesce("visit_id", "capture_id"))
    out = neighbour(both, keys, "_seg", ["at", "_s", "_id"], F.struct("at", "capture_id"), "hit", only=F.col("capture_id").isNotNull())
    return out.where(F.col("visit_id").isNotNull() & F.col("hit").isNotNull()).select("visit_id", "at", "hit")


def path_prefixes(path: Column) -> Column:
    """Non-root prefixes of a path that end on a segment boundary, itself included."""
    none = F.array().cast("array<string>")
    return let(F.filter(F.split(path, "/"), lambda s: s != ""), lambda segments: F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(none))


def recall(visits: DataFrame, captures: DataFrame, lineage_seconds: int = LINEAGE_SECONDS, bucket: str = "hour") -> DataFrame:
    """(visit_id, capture_id, via): the capture behind each visit.

    Tiers: the same key; else the same tab within ``lineage_seconds``, for application pages
    only; else the same domain and a captured path that is a segment prefix, newest wins.
    ``visits``: visit_id, key, tab_id, domain, path, at, is_application. ``captures``:
    capture_id, key, tab_id, domain, path, at. Each tier is an as-of pass over the union of
    both sides, linear in their size even when one key or tab is hot.
    """
    by_key = _as_of(visits, captures, ["key"], bucket).select("visit_id", F.struct(
        F.lit(1).alias("tier"), F.lit(0).cast("double").alias("age"), F.col("hit.capture_id").alias("capture_id")).alias("o"))
    tabs = _as_of(visits.where("is_application and tab_id is not null"), captures.where("tab_id is not null"), ["tab_id"], bucket)
    age = F.col("at").cast("double") - F.col("hit.at").cast("double")
    by_tab = tabs.where(age < lineage_seconds).select("visit_id", F.struct(
        F.lit(2).alias("tier"), age.alias("age"), F.col("hit.capture_id").alias("capture_id")).alias("o"))
    spread = visits.withColumn("prefix", F.explode(path_prefixes(F.lower("path"))))
    owned = captures.withColumn("_p", path_prefixes(F.lower("path"))).where(F.size("_p") > 0).withColumn(
        "prefix", F.element_at("_p", -1)).drop("_p")
    by_path = _as_of(spread, owned, ["domain", "prefix"], bucket).select("visit_id", F.struct(
        F.lit(3).alias("tier"), age.alias("age"), F.col("hit.capture_id").alias("capture_id")).alias("o"))
    best = by_key.unionByName(by_tab).unionByName(by_path).groupBy("visit_id").agg(F.min("o").alias("o"))
    names = F.array(F.lit("key"), F.lit("tab"), F.lit("path"))
    return best.select("visit_id", "o.capture_id", F.element_at(names, F.col("o.tier")).alias("via"))


def ttl_view(df: DataFrame, as_of: Column, kind: str, ts: str = "ts", ttl: Mapping[str, int] = TTL_SECONDS) -> DataFrame:
    """Rows still valid at ``as_of``; kinds without a ttl are not cached and drop out.

    The ttl table is a literal map in the filter. The loosest bound is also stated on the bare
    timestamp, so the scan can skip row groups and date partitions.
    """
    loosest = as_of - F.expr(f"INTERVAL '{max(ttl.values())}' SECOND")
    seconds = F.try_element_at(literal_map(dict(ttl)), F.col(kind))
    age = as_of.cast("double") - F.col(ts).cast("timestamp").cast("double")
    return df.where((F.col(ts) > loosest) & (age < seconds))


def label_hits(requests: DataFrame, url: str, fp: str, request_id: str, ts: str = "ts",
               ttl_seconds: int = TTL_SECONDS["posting"], bucket: str = "hour") -> DataFrame:
    """``layer`` url, hash or miss: an earlier request with the same url, else the same fingerprint, inside the ttl."""
    at = F.col(ts).cast("double")
    work = requests.withColumn("_seg", F.date_trunc(bucket, ts))
    # A missing url or fingerprint (a short text has none) equals no other.
    work = neighbour(work, [url], "_seg", [ts, request_id], F.col(ts), "_prev_url", only=F.col(url).isNotNull())
    work = neighbour(work, [fp], "_seg", [ts, request_id], F.col(ts), "_prev_fp", only=F.col(fp).isNotNull())
    return work.withColumn("layer", F.when(at - F.col("_prev_url").cast("double") < ttl_seconds, "url")
                           .when(at - F.col("_prev_fp").cast("double") < ttl_seconds, "hash")
                           .otherwise("miss")).drop("_seg", "_prev_url", "_prev_fp")


def hit_rates(labelled: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, layer, n, pct)."""
    counts = labelled.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), "layer").agg(big(F.count("*")).alias("n"))
    total = F.sum("n").over(Window.partitionBy("day"))
    return counts.withColumn("pct", percent(F.col("n"), total))


def keep_last(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    Spark limits each task to ``n`` rows per key before the shuffle (window group limit), so a hot
    key reaches its reducer as at most ``n`` rows per task. ``n`` is the operator's definition.
    """
    out = rank or "_rn"
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)
    return ranked.withColumn(out, big(out)) if rank else ranked.drop(out)


def job_history(df: DataFrame, user: str, url: str, ts: str, row_id: str, cap: int = 20) -> DataFrame:
    """Newest entry per (user, url), newest first, at most ``cap`` per user, with ``pos``."""
    latest = df.groupBy(user, url).agg(F.max(F.struct(ts, row_id)).alias("_l")).select(
        user, url, F.col(f"_l.{ts}").alias(ts), F.col(f"_l.{row_id}").alias(row_id))
    return keep_last(latest, [user], cap, [F.desc(ts), F.desc(row_id)], "pos")


def coalesce_profile(visits: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key: each field's newest non-empty value."""
    when = F.struct(*order)
    picks = []
    for field in fields:
        filled = F.trim(F.coalesce(F.col(field), F.lit(""))) != ""
        picks.append(F.max_by(field, F.when(filled, when)).alias(field))
    return visits.groupBy(key).agg(*picks, big(F.count("*")).alias("visits"))


def phrase_key(col: str | Column) -> Column:
    return F.array_join(plain_words(col), " ")


def word_ngrams(words: Column, sizes: Column | Sequence[int]) -> Column:
    """Distinct n-grams of an array of words, joined by a blank, for the listed numbers of words."""
    none = F.array().cast("array<string>")
    wanted = sizes if isinstance(sizes, Column) else F.array(*[F.lit(n) for n in sizes]).cast("array<int>")

    def build(ws: Column) -> Column:
        def of_length(n):
            return F.when(F.size(ws) >= n, F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(none)
        return F.array_distinct(F.flatten(F.transform(wanted, of_length)))

    return let(words, build)


def affinity(headline: Column, seen_at: Column, as_of: Column) -> Column:
    """Recruiting +30, people +15, lead +5, sales −25, and 10 minus the age in whole weeks while positive."""
    h = F.lower(headline)

    def points(pattern, n):
        return F.when(h.rlike(pattern), n).otherwise(0)

    weeks = F.floor((as_of.cast("double") - seen_at.cast("double")) / (7 * 86400))
    return big(points("recruit|talent acquisition|talent partner", 30)
               + points("people|hr(?:[^a-z0-9_]|$)|human resources", 15)
               + points("head|lead|manager|director", 5)
               + points("sales|business development|account executive", -25)
               + F.greatest(F.lit(0), 10 - weeks))


def rank_profiles(profiles: DataFrame, companies: DataFrame, as_of: Column, k: int = 3,
                  ttl_seconds: int = TTL_SECONDS["person"]) -> DataFrame:
    """(company, handle, score, rank): remembered people whose headline names the company.

    ``profiles``: handle, headline, seen_at. ``companies``: company. Matching is an equi-join of
    headline n-grams with the company's words, not a scan of every pair. N-grams have as many
    words as company names have.
    """
    names = companies.select("company", phrase_key("company").alias("_gram")).where("_gram <> ''").distinct()
    fresh = profiles.where(as_of.cast("double") - F.col("seen_at").cast("double") < ttl_seconds)
    fresh = fresh.withColumn("_sizes", lengths(names, "_gram", " "))
    grams = fresh.select("handle", affinity(F.col("headline"), F.col("seen_at"), as_of).alias("score"),
                         F.explode(word_ngrams(plain_words("headline"), F.col("_sizes"))).alias("_gram"))
    joined = grams.join(names, "_gram").drop("_gram")
    return keep_last(joined, ["company"], k, [F.desc("score"), F.col("handle")], "rank")


def unprocessed(queue: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Queue rows whose key was never handled."""
    return queue.join(done.select(*on), list(on), "left_anti")


def first_seen(stream: DataFrame, on: Sequence[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Streaming form: the first row of each key; repeats within ``late`` of it are dropped, and so is what comes later than that.

    State holds the keys of the last ``late`` of event time only.
    """
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(on))
