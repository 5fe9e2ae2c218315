"""Queries over the event log: batch runs of the stream jobs, and replays for the stateful ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from postlens.functions.text import big
from postlens.plans.history import FMT, SQL_K, k_of
from postlens.plans.people import send_tables
from postlens.sources.tables import events, table
from postlens.streaming import activity as J
from postlens.streaming.replay import run_append, run_update, stream_table

MIN = 60


def stamp(df, *names):
    return df.withColumns({n: F.date_format(n, FMT) for n in names})


def j01(spark, folder):
    # An event is a few bytes until its payload is made, so events are dealt over all cores first: a file has few row groups.
    ev = events(spark, folder).select("event_id", "user_id", "props")
    ev = ev.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "event_id")
    nested = F.struct(k_of().alias("k"), F.concat(F.lit("eyJ"), F.repeat(F.lit("a"), 12)).alias("jwt"), F.lit("s3").alias("api_key"), F.repeat(F.lit("x"), (F.col("user_id") * 5).cast("int")).alias("note"),
                      F.sequence(F.lit(1), (F.col("user_id") % 12 + 1).cast("int")).alias("list"), F.struct(F.struct(F.struct(F.lit(1).alias("d")).alias("c")).alias("b")).alias("a"))
    return J.ingest_trace(ev.select("event_id", F.to_variant_object(nested).alias("props")))


def j02(spark, folder):
    return stamp(J.activity(events(spark, folder), "1 hour", success=("purchase", "signup")), "start", "end")


def j02b(spark, folder):
    return stamp(J.activity(events(spark, folder), "2 hours", "1 hour", success=("purchase", "signup")), "start", "end").select("start", "kind", "n")


def j02c(spark, folder):
    return J.success_rate(events(spark, folder), ["user_id"], "event_type", ["purchase"], ["error"])


def j03(spark, folder):
    ev = events(spark, folder).select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("event"), "user_id")
    logs = [("a", ev.where("event in ('click', 'view', 'signup')")), ("b", ev.where("event in ('click', 'error')").drop("user_id")), ("c", ev.where("event = 'purchase'").withColumn("id", F.lit(None).cast("long")))]
    out = J.merged_logs(logs)
    return out.select("event", "source", "dedupe_key", J.normal_level(F.lit("?"), "event").alias("level")).groupBy("event", "level", "source").agg(big(F.count("*")).alias("n"))


def j04(spark, folder):
    return stamp(J.sessions_batch(events(spark, folder), 6 * 3600), "start", "last")


def j04b(spark, folder):
    return stamp(J.sessions(events(spark, folder), "6 hours"), "start", "last")


def j04c(spark, folder):
    return stamp(J.session_stages(events(spark, folder), 6 * 3600), "session_start", "start")


def j05(spark, folder):
    return J.debounce(events(spark, folder), 30 * MIN).select("event_id", "user_id")


def _captures(rows):
    return rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("capture_id"), F.col("value").alias("richness"), F.col("ts").alias("at"))


def j06(spark, folder):
    from postlens.streaming.state import latest_state, use_rocksdb

    use_rocksdb(spark)
    return run_update(latest_state(_captures(stream_table(spark, folder, "events"))), "latest", "key")


def j07(spark, folder):
    from postlens.streaming.state import limit_stream, use_rocksdb

    use_rocksdb(spark)
    ev = stream_table(spark, folder, "events").where("event_type in ('purchase', 'signup')")
    rows = ev.select(F.col("user_id").alias("company"), F.when(F.col("event_type") == "purchase", 0).otherwise(2).alias("kind"), F.col("event_id").alias("request_id"),
                     F.concat_ws("-", "user_id", k_of()).alias("job_key"), F.unix_micros("ts").alias("at_us"))
    return run_append(limit_stream(rows), "limits").withColumn("allowed", F.col("allowed").cast("string"))


def j08(spark, folder):
    orders = table(spark, folder, "orders")
    status = orders.select(F.col("o_orderpriority").alias("queue"), F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return J.progress(status, "queue", "item", "status", ["at", "id"])


def j09(spark, folder):
    ev = stream_table(spark, folder, "events")
    visits = ev.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("event_id").alias("visit_id"), F.col("ts").alias("at"))
    caps = stream_table(spark, folder, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("capture_id"), F.col("ts").alias("captured_at"))
    out = run_append(J.stream_recall(visits, caps), "recall")
    # Visits younger than the watermark are still open when the replay ends: they are reported without a capture.
    clicks = events(spark, folder).where("event_type = 'click'").select(F.col("event_id").alias("visit_id"), F.col("user_id").alias("key"))
    waiting = clicks.join(out.select("visit_id"), "visit_id", "left_anti").withColumn("capture_id", F.lit(-1).cast("long"))
    return out.select("visit_id", "key", F.coalesce("capture_id", F.lit(-1).cast("long")).alias("capture_id")).unionByName(waiting)


def j10(spark, folder):
    ev = events(spark, folder).withColumn("code", (F.col("value") * 20).cast("int"))
    out = J.pair_spans(ev, F.col("event_type") == "signup", F.col("event_type") == "purchase", status="code")
    return out.select("user_id", "start_id", F.coalesce("end_id", F.lit(-1).cast("bigint")).alias("end_id"), F.coalesce("duration_ms", F.lit(-1).cast("bigint")).alias("duration_ms"), "status")


def j11(spark, folder):
    return J.duration_stats(events(spark, folder))


def j11b(spark, folder):
    kinds = ["click", "error", "purchase", "signup", "view"]
    facts = J.event_facts(events(spark, folder), {kind: {"k": ("$.k", "long")} for kind in kinds})
    tables = [facts[kind].select("event_id", "event_type", "k") for kind in kinds]
    return reduce(lambda a, b: a.unionByName(b), tables)


QUERIES = {"j1_ingest_trace": j01, "j2_activity": j02, "j2_activity_sliding": j02b, "j2_success_rate": j02c, "j3_merged_logs": j03, "j4_sessions_batch": j04, "j4_sessions": j04b, "j4_session_stages": j04c, "j5_debounce": j05,
           "j6_latest_state": j06, "j7_limit_stream": j07, "j8_progress": j08, "j9_stream_recall": j09, "j10_pair_spans": j10, "j11_duration_stats": j11, "j11_event_facts": j11b}

_ACT = """count(*) AS n"""
_SESS = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM s GROUP BY user_id, sid"""
from postlens.plans.people import ORACLES as _PEOPLE  # noqa: E402

ORACLES = {
    "j1_ingest_trace": f"""SELECT event_id, '{{"a":{{"b":{{"c":"[…]"}}}},"api_key":"[redacted]","jwt":"[redacted]","k":' || {SQL_K} || ',"list":[' || array_to_string(range(1, least(user_id % 12 + 1, 8) + 1), ',')
        || CASE WHEN user_id % 12 + 1 > 8 THEN ',"…+' || (user_id % 12 - 7) || '"' ELSE '' END || '],"note":"' || CASE WHEN user_id * 5 > 300 THEN repeat('x', 300) || '…(' || (user_id * 5) || ')' ELSE repeat('x', CAST(user_id * 5 AS INT)) END || '"}}' AS props FROM events""",
    "j2_activity": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS end, event_type AS kind, count(*) AS n,
        count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS success, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value) FILTER (WHERE value > 0), 4) AS avg_duration FROM events GROUP BY date_trunc('hour', ts), event_type""",
    "j2_activity_sliding": """WITH w AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, event_type FROM events)
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type AS kind, count(*) AS n FROM w GROUP BY ALL""",
    "j2_success_rate": """SELECT user_id, CAST(coalesce(round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0)), 100) AS BIGINT) AS rate FROM events GROUP BY user_id""",
    "j3_merged_logs": "SELECT event_type AS event, CASE event_type WHEN 'error' THEN 'error' ELSE '?' END AS level, CASE event_type WHEN 'error' THEN 'b' WHEN 'purchase' THEN 'c' ELSE 'a' END AS source, count(*) AS n FROM events GROUP BY event_type",
    "j4_sessions_batch": _SESS,
    "j4_sessions": _SESS,
    "j4_session_stages": _SESS.split("\n")[0] + """, g AS (SELECT user_id, sid, event_type AS stage, min(ts) AS b, max(ts) AS e, count(*) AS n FROM s GROUP BY ALL),
        w AS (SELECT *, min(b) OVER (PARTITION BY user_id, sid) AS ss, max(e) OVER (PARTITION BY user_id, sid) AS se, lead(b) OVER (PARTITION BY user_id, sid ORDER BY b, stage) AS nb, row_number() OVER (PARTITION BY user_id, sid ORDER BY b, stage) AS ord FROM g)
        SELECT user_id, strftime(ss, '%Y-%m-%d %H:%M:%S.%f') AS session_start, ord, stage, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS start, (epoch_us(coalesce(nb, se)) - epoch_us(b)) / 1000000 AS seconds, n FROM w""",
    "j5_debounce": "SELECT event_id, user_id FROM events QUALIFY lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) > 1800000000",
    "j6_latest_state": "SELECT user_id AS key, arg_max(event_id, CAST(value AS DECIMAL(18,6)) * 1000000000000 + epoch_us(ts) / 1000000) AS capture_id, max(value) AS richness, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id",
    "j7_limit_stream": "SELECT request_id, allowed, reason FROM (" + _PEOPLE["i10_send_policy"] + ")",
    "j8_progress": """WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), g AS (SELECT o_orderpriority AS queue, o_orderstatus AS status, count(*) AS n FROM l GROUP BY ALL)
        SELECT queue, status, n, CAST(sum(n) OVER (PARTITION BY queue) AS BIGINT) AS total, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY queue)) AS BIGINT) AS pct FROM g""",
    "j9_stream_recall": "SELECT v.event_id AS visit_id, v.user_id AS key, coalesce(c.event_id, -1) AS capture_id FROM events v LEFT JOIN events c ON v.user_id = c.user_id AND c.event_type = 'view' AND c.ts <= v.ts AND c.ts > v.ts - INTERVAL 45 MINUTE WHERE v.event_type = 'click'",
    "j10_pair_spans": """WITH s AS (SELECT * FROM events WHERE event_type = 'signup'), e AS (SELECT * FROM events WHERE event_type = 'purchase'),
        j AS (SELECT s.user_id, s.event_id AS start_id, s.ts AS st, e.event_id AS end_id, e.ts AS et, e.value AS v, row_number() OVER (PARTITION BY s.event_id ORDER BY e.ts, e.event_id) AS rn FROM s LEFT JOIN e ON s.user_id = e.user_id AND (e.ts > s.ts OR (e.ts = s.ts AND e.event_id > s.event_id)))
        SELECT user_id, start_id, coalesce(end_id, -1) AS end_id, CAST(coalesce(floor((epoch_us(et) - epoch_us(st)) / 1000), -1) AS BIGINT) AS duration_ms, CASE WHEN end_id IS NULL THEN 'open' WHEN trunc(v * 20) >= 400 THEN 'error' ELSE 'ok' END AS status FROM j WHERE rn = 1""",
    "j11_duration_stats": "SELECT event_type AS kind, count(*) AS n, round(avg(value), 4) AS avg, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1",
    "j11_event_facts": f"SELECT event_id, event_type, {SQL_K} AS k FROM events",
}
