"""Queries over histories: events play captures, visits, requests and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.operators import history as H
from postlens.sources.tables import events, table
from postlens.streaming.replay import run_append, stream_table

AS_OF = "2024-01-31 00:00:00"
EVENT_TTL = {"click": 3600 * 24, "view": 3600 * 24 * 7, "purchase": 3600 * 24 * 30, "error": 3600}
FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def k_of():
    return F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")


SQL_K = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)"


def c01(spark, folder):
    docs = table(spark, folder, "documents")
    caps = docs.select("doc_id", "source", "text", "lang", F.timestamp_seconds(F.col("doc_id") * 60).alias("at"))
    out = H.upsert_richest(caps, "source", "doc_id", "at", H.richness("text", title="lang"), tab="lang")
    return out.select("source", "doc_id", F.round("richness", 4).alias("richness"), big(F.unix_timestamp("last_at")).alias("last_at"),
                      "captures", "last_tab", F.md5("text").alias("text_md5"))


def visits_and_captures(spark, folder):
    ev = events(spark, folder).withColumn("k", k_of())
    base = ev.select("event_id", "event_type", F.col("ts").alias("at"), F.concat_ws("-", "user_id", "k").alias("key"),
                     F.col("user_id").alias("tab_id"), F.concat(F.lit("d"), "k").alias("domain"),
                     F.concat(F.lit("/u/"), "user_id", F.lit("/"), "event_type").alias("path"), "value")
    visits = base.where("event_type in ('click', 'signup')").withColumnRenamed("event_id", "visit_id").withColumn(
        "is_application", F.col("value") > 10).withColumn("path", F.concat(F.lit("/u/"), "tab_id", F.lit("/view/apply")))
    captures = base.where("event_type = 'view'").withColumnRenamed("event_id", "capture_id")
    return visits, captures


def c02(spark, folder):
    return H.recall(*visits_and_captures(spark, folder))


def c03(spark, folder):
    return H.ttl_view(events(spark, folder), as_of(), "event_type", ttl=EVENT_TTL).select("event_id", "event_type")


def c04(spark, folder):
    ev = events(spark, folder).select("event_id", "ts", "user_id", F.floor("value").alias("fp"))
    return H.hit_rates(H.label_hits(ev, "user_id", "fp", "event_id", ttl_seconds=3600 * 4))


def c05(spark, folder):
    return H.keep_last(events(spark, folder).select("event_id", "user_id", "ts"), ["user_id"], 40,
                       [F.desc("ts"), F.desc("event_id")], "pos").select("event_id", "user_id", "pos")


def c06(spark, folder):
    ev = events(spark, folder).withColumn("url", F.concat(F.lit("https://example.com/"), k_of()))
    return H.job_history(ev, "user_id", "url", "ts", "event_id").withColumn("ts", F.date_format("ts", FMT))


def c07(spark, folder):
    conv = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text", F.regexp_extract("text", "([A-Z][a-z]+) et ", 1).alias("headline"))
    return H.coalesce_profile(conv, "role", ["conv_id", "turn"], ["text", "headline"])


def c08(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    lead = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Talent Acquisition Lead").when(F.col("c_mktsegment") == "MACHINERY", "Sales Manager") \
        .when(F.col("c_mktsegment") == "FURNITURE", "People Partner").otherwise("Engineer")
    profiles = customer.select(F.col("c_name").alias("handle"), F.concat(lead, F.lit(" at Nation-"), "c_nationkey", F.lit(", hiring")).alias("headline"),
                               (as_of() - F.make_dt_interval(F.floor(F.abs("c_acctbal") / 100).cast("int"))).alias("seen_at"))
    companies = nation.select(F.concat(F.lit("nation "), "n_nationkey").alias("company"))
    return H.rank_profiles(profiles, companies, as_of())


def c09(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    done = table(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("key"))
    return H.unprocessed(orders, done, ["key"])


def c09b(spark, folder):
    """One queue entry per user, type and hour out of the event stream."""
    log = stream_table(spark, folder, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    out = run_append(H.first_seen(log, ["user_id", "event_type", "hour"]), "queue")
    return out.select("user_id", "event_type", F.date_format("hour", FMT).alias("hour"))


QUERIES = {"c1_upsert_richest": c01, "c2_recall": c02, "c3_ttl_view": c03, "c4_label_hits": c04, "c5_keep_last": c05,
           "c6_job_history": c06, "c7_coalesce_profile": c07, "c8_rank_profiles": c08, "c9_unprocessed": c09, "c9_first_seen": c09b}

ORACLES = {
    "c1_upsert_richest": """
        WITH r AS (SELECT *, least(len(text), 6000) / 100.0 + 5 AS rich FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rich DESC, doc_id DESC) AS rn, max(doc_id) OVER (PARTITION BY source) AS mx,
              count(*) OVER (PARTITION BY source) AS cnt, first_value(lang) OVER (PARTITION BY source ORDER BY doc_id DESC) AS tab FROM r)
        SELECT source, doc_id, round(CAST(rich AS DOUBLE), 4) AS richness, CAST(mx * 60 AS BIGINT) AS last_at, cnt AS captures, tab AS last_tab, md5(text) AS text_md5
        FROM n WHERE rn = 1""",
    "c2_recall": f"""
        WITH b AS (SELECT event_id, event_type, ts, user_id || '-' || {SQL_K} AS key, user_id AS tab, {SQL_K} AS k, value FROM events),
        v AS (SELECT * FROM b WHERE event_type IN ('click', 'signup')), c AS (SELECT * FROM b WHERE event_type = 'view'),
        t AS (SELECT v.event_id AS visit_id, c.event_id AS capture_id, 1 AS tier, c.ts FROM v JOIN c ON v.key = c.key AND c.ts <= v.ts
              UNION ALL SELECT v.event_id, c.event_id, 2, c.ts FROM v JOIN c ON v.tab = c.tab AND c.ts <= v.ts AND v.value > 10
                AND epoch(v.ts) - epoch(c.ts) < 2700
              UNION ALL SELECT v.event_id, c.event_id, 3, c.ts FROM v JOIN c ON v.k = c.k AND v.tab = c.tab AND c.ts <= v.ts),
        r AS (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY tier, ts DESC, capture_id DESC) AS rn FROM t)
        SELECT visit_id, capture_id, CASE tier WHEN 1 THEN 'key' WHEN 2 THEN 'tab' ELSE 'path' END AS via FROM r WHERE rn = 1""",
    "c3_ttl_view": f"""
        SELECT event_id, event_type FROM events WHERE epoch(TIMESTAMP '{AS_OF}') - epoch(ts) <
          CASE event_type WHEN 'click' THEN 86400 WHEN 'view' THEN 604800 WHEN 'purchase' THEN 2592000 WHEN 'error' THEN 3600 END""",
    "c4_label_hits": """
        WITH l AS (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pu,
                   lag(ts) OVER (PARTITION BY floor(value) ORDER BY ts, event_id) AS pf FROM events),
        x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN epoch(ts) - epoch(pu) < 14400 THEN 'url'
              WHEN epoch(ts) - epoch(pf) < 14400 THEN 'hash' ELSE 'miss' END AS layer FROM l),
        g AS (SELECT day, layer, count(*) AS n FROM x GROUP BY ALL)
        SELECT day, layer, n, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY day)) AS BIGINT) AS pct FROM g""",
    "c5_keep_last": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events QUALIFY pos <= 40",
    "c6_job_history": f"""
        WITH l AS (SELECT user_id, 'https://example.com/' || {SQL_K} AS url, ts, event_id,
          row_number() OVER (PARTITION BY user_id, {SQL_K} ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        SELECT user_id, url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY l.ts DESC, event_id DESC) AS pos
        FROM l WHERE rn = 1 QUALIFY pos <= 20""",
    "c7_coalesce_profile": """
        WITH c AS (SELECT *, regexp_extract(text, '([A-Z][a-z]+) et ', 1) AS headline FROM conversations)
        SELECT role, arg_max(text, conv_id * 100000 + turn) FILTER (WHERE trim(text) <> '') AS text,
          arg_max(headline, conv_id * 100000 + turn) FILTER (WHERE trim(headline) <> '') AS headline, count(*) AS visits FROM c GROUP BY role""",
    "c8_rank_profiles": """
        WITH p AS (SELECT c_name AS handle, 'nation ' || c_nationkey AS company, floor(floor(abs(c_acctbal) / 100) / 7) AS weeks, floor(abs(c_acctbal) / 100) AS days,
          CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 35 WHEN 'MACHINERY' THEN -20 WHEN 'FURNITURE' THEN 15 ELSE 0 END AS pts FROM customer),
        s AS (SELECT company, handle, CAST(pts + greatest(0, 10 - weeks) AS BIGINT) AS score FROM p WHERE days < 90)
        SELECT company, handle, score, row_number() OVER (PARTITION BY company ORDER BY score DESC, handle) AS rank FROM s QUALIFY rank <= 3""",
    "c9_first_seen": "SELECT DISTINCT user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour FROM events",
    "c9_unprocessed": "SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
}
