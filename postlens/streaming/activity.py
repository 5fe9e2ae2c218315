"""Event-stream jobs. Each works on a stream and, unchanged, on a batch of the same events.

Late rows are dropped by the watermark, which every job takes as a parameter. State is kept per
key and bounded by it. Where the batch form of a per-key job would gather a hot key into one
task, a segmented batch twin is given next to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from postlens.functions.segments import neighbour, running
from postlens.functions.text import big, c, let, percent

# What must never reach a trace.
SECRET_KEY = r"(?i)pass(?:word)?|token|api_?key|secret|authorization|auth|credential|bearer|refresh"
SECRET_VALUE = r"^(?:Bearer[ ]+|ya29\.|eyJ[A-Za-z0-9_\-]{10,})"
#: A secret value shows in its first characters, so no more of a long string is searched.
SECRET_START = 64
LEVELS = ["debug", "info", "success", "warn", "error"]


def _quoted(text: Column) -> Column:
    """A JSON string: to_json of a one-element array quotes and escapes it."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _redact(node: Column, depth: int, chars: int, items: int, keys: int) -> Column:
    """A variant as redacted JSON text: secrets masked, strings, arrays, keys and depth bounded, each cut marked.

    A node's kind, text, entries and elements are bound once: inside a lambda each mention would be computed anew,
    on every level below again, and a long string would be copied for each.
    """
    def string(text: Column) -> Column:
        secret = F.substring(text, 1, SECRET_START).rlike(SECRET_VALUE)
        return _quoted(F.when(secret, "[redacted]").otherwise(let(F.length(text), lambda n: F.when(
            n > chars, F.concat(F.substring(text, 1, chars), F.lit("…("), n.cast("string"), F.lit(")"))).otherwise(text))))

    def obj(entries: Column) -> Column:
        shown = F.transform(F.slice(entries, 1, keys), lambda e: F.concat(
            _quoted(e["key"]), F.lit(":"), F.when(e["key"].rlike(SECRET_KEY), '"[redacted]"').otherwise(_redact(e["value"], depth - 1, chars, items, keys))))
        return F.concat(F.lit("{"), F.array_join(shown, ","), F.when(F.size(entries) > keys, F.concat(F.lit(',"…":"+'), (F.size(entries) - keys).cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))

    def arr(elements: Column) -> Column:
        shown = F.transform(F.slice(elements, 1, items), lambda x: _redact(x, depth - 1, chars, items, keys))
        return F.concat(F.lit("["), F.array_join(shown, ","), F.when(F.size(elements) > items, F.concat(F.lit(',"…+'), (F.size(elements) - items).cast("string"), F.lit('"'))).otherwise(""), F.lit("]"))

    def by_kind(kind: Column) -> Column:
        is_obj, is_arr = kind.startswith("OBJECT"), kind.startswith("ARRAY")
        if depth < 0:
            out = F.when(is_obj | is_arr, F.lit('"[…]"'))
        else:
            out = F.when(is_obj, let(F.map_entries(node.try_cast("map<string,variant>")), obj)).when(is_arr, let(node.try_cast("array<variant>"), arr))
        return out.when(kind == "STRING", let(node.try_cast("string"), string)).otherwise(F.coalesce(node.try_cast("string"), F.lit("null")))

    return let(F.schema_of_variant(node), by_kind)


def ingest_trace(log: DataFrame, data: str = "props", depth: int = 2, chars: int = 300, items: int = 8, keys: int = 21) -> DataFrame:
    """Stateless: the open payload of each event redacted. Longer strings and arrays, further keys and deeper levels leave a mark.

    ``data``: JSON text, or a variant, which is read as it is.
    """
    node = c(data) if isinstance(log.schema[data].dataType, VariantType) else F.try_parse_json(c(data))
    return log.withColumn(data, let(node, lambda v: _redact(v, depth, chars, items, keys)))


def activity(log: DataFrame, size: str = "1 hour", slide: str | None = None, ts: str = "ts", kind: str = "event_type", duration: str = "value",
             success: Sequence[str] = ("success",), error: Sequence[str] = ("error",), late: str = "1 hour") -> DataFrame:
    """(start, end, kind, n, success, failed, avg_duration) per tumbling or sliding window; append mode on a stream."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = log.withWatermark(ts, late).groupBy(win.alias("w"), F.col(kind).alias("kind")).agg(
        big(F.count("*")).alias("n"), big(F.count_if(F.col(kind).isin(list(success)))).alias("success"), big(F.count_if(F.col(kind).isin(list(error)))).alias("failed"),
        F.avg(F.when(F.col(duration) > 0, F.col(duration))).alias("avg_duration"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "success", "failed", F.round("avg_duration", 4).alias("avg_duration"))


def success_rate(log: DataFrame, by: Sequence[str], kind: str, success: Sequence[str], error: Sequence[str]) -> DataFrame:
    """(by, rate): whole per cent of successes among finished operations; 100 when none finished."""
    ok, bad = F.count_if(F.col(kind).isin(list(success))), F.count_if(F.col(kind).isin(list(error)))
    return log.groupBy(*by).agg(F.when(ok + bad > 0, percent(ok, ok + bad)).otherwise(F.lit(100).cast("bigint")).alias("rate"))


def normal_level(level: str | Column, event: str | Column) -> Column:
    e = c(event)
    inferred = F.when(e.rlike("error|fail"), "error").when(e.rlike("success|complete"), "success").when(e.contains("warn"), "warn")
    return F.when(c(level).isin(LEVELS), c(level)).otherwise(F.coalesce(inferred, c(level), F.lit("info")))


def merged_logs(logs: Sequence[tuple[str, DataFrame]], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Several logs with a source name, one row per id, or per timestamp and event where no id exists.

    Of a batch's equal rows the earliest stays, then that of the first source by name; a stream keeps the first to arrive.
    """
    out = None
    for source, df in logs:
        rows = df.withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    key = F.coalesce(F.col("id").cast("string"), F.concat_ws("-", F.col(ts).cast("string"), "event"))
    out = out.withColumn("dedupe_key", key)
    if out.isStreaming:
        return out.withWatermark(ts, late).dropDuplicatesWithinWatermark(["dedupe_key"])
    names = [n for n in out.columns if n != "dedupe_key"]
    first = F.min_by(F.struct(*names), F.struct(ts, "source", "event"))
    return out.groupBy("dedupe_key").agg(first.alias("_row")).select("_row.*", "dedupe_key")


def sessions(log: DataFrame, gap: str = "30 minutes", user: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): runs of events without a pause of ``gap``."""
    rows = log.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(big(F.count("*")).alias("n"), F.max(ts).alias("last"))
    return rows.select(user, F.col("w.start").alias("start"), "last", "n")


def _numbered_sessions(log: DataFrame, gap_seconds: int, user: str, ts: str, event_id: str, bucket: str) -> DataFrame:
    """Events with ``_session``, counted up by segmented windows: a user with a third of all events is spread over time."""
    rows = neighbour(log.withColumn("_seg", F.date_trunc(bucket, ts)), [user], "_seg", [ts, event_id], F.col(ts), "_prev")
    opens = F.col("_prev").isNull() | (F.unix_micros(ts) - F.unix_micros("_prev") >= gap_seconds * 1_000_000)
    return running(rows, [user], "_seg", [ts, event_id], opens.cast("int"), "_session")


def sessions_batch(log: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts", event_id: str = "event_id", bucket: str = "day") -> DataFrame:
    """(user, start, last, n): the same sessions from history."""
    rows = _numbered_sessions(log, gap_seconds, user, ts, event_id, bucket)
    return rows.groupBy(user, "_session").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), big(F.count("*")).alias("n")).drop("_session")


def session_stages(log: DataFrame, gap_seconds: int, stage: str = "event_type", user: str = "user_id", ts: str = "ts", event_id: str = "event_id", bucket: str = "day") -> DataFrame:
    """(user, session_start, ord, stage, start, seconds, n): the stages of each session in the order in which they began.

    A stage lasts until the next one begins, the last one until the session's last event. Stages that
    begin together are ordered by name. Events are counted per stage first, so windows see one row per
    session and stage.
    """
    rows = _numbered_sessions(log, gap_seconds, user, ts, event_id, bucket)
    each = rows.groupBy(user, "_session", stage).agg(F.min(ts).alias("start"), F.max(ts).alias("_last"), big(F.count("*")).alias("n"))
    whole = Window.partitionBy(user, "_session")
    order = whole.orderBy("start", stage)
    until = F.coalesce(F.lead("start").over(order), F.max("_last").over(whole))
    return each.withColumns({"session_start": F.min("start").over(whole), "ord": big(F.row_number().over(order)), "_until": until}).select(
        user, "session_start", "ord", F.col(stage).alias("stage"), "start", ((F.unix_micros("_until") - F.unix_micros("start")) / 1_000_000).alias("seconds"), "n")


def debounce(log: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", bucket: str = "day") -> DataFrame:
    """Events with no successor of the same key within ``gap_seconds``."""
    rows = neighbour(log.withColumn("_seg", F.date_trunc(bucket, ts)), [key], "_seg", [ts, event_id], F.col(ts), "_next", ahead=True)
    return rows.where(F.col("_next").isNull() | (F.unix_micros("_next") - F.unix_micros(ts) > gap_seconds * 1_000_000)).drop("_seg", "_next")


def debounce_stream(log: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The last event of each burst, emitted once the pause has passed."""
    rows = log.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.max_by(event_id, F.struct(ts, event_id)).alias(event_id), F.max(ts).alias(ts))
    return rows.select(key, event_id, ts)


def progress(status: DataFrame, queue: str, item: str, state: str, at: Sequence[str]) -> DataFrame:
    """(queue, state, n, total, pct): items by their latest state."""
    latest = status.groupBy(queue, item).agg(F.max_by(state, F.struct(*at)).alias(state))
    counts = latest.groupBy(queue, state).agg(big(F.count("*")).alias("n"))
    total = counts.groupBy(queue).agg(F.sum("n").alias("total"))
    return counts.join(total, queue).withColumn("pct", percent(F.col("n"), F.col("total")))


def progress_stream(status: DataFrame, queue: str, item: str, state: str, at: Sequence[str]) -> DataFrame:
    """Latest state per item, complete or update mode; counts follow in ``foreachBatch`` with ``progress``."""
    return status.groupBy(queue, item).agg(F.max_by(state, F.struct(*at)).alias(state), F.max(F.struct(*at)).alias("at"))


def stream_recall(visits: DataFrame, captures: DataFrame, minutes: int = 45, late: str = "1 hour") -> DataFrame:
    """Stream-stream left outer join: captures of a visit's key in the ``minutes`` before it. ``visits``: key, visit_id, at; ``captures``: key, capture_id, captured_at."""
    v = visits.withWatermark("at", late)
    k = captures.withColumnRenamed("key", "_key").withWatermark("captured_at", late)
    on = (F.col("key") == F.col("_key")) & (F.col("captured_at") <= F.col("at")) & (F.col("captured_at") > F.col("at") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return v.join(k, on, "leftOuter").select("visit_id", "key", "at", "capture_id", "captured_at")


def pair_spans(log: DataFrame, start: Column, end: Column, label: str = "user_id", ts: str = "ts", event_id: str = "event_id", status: str | None = None, bucket: str = "day") -> DataFrame:
    """(label, start_id, end_id, started, duration_ms, status): every start with the next end of its label; unmatched starts keep NULLs."""
    rows = log.withColumn("_seg", F.date_trunc(bucket, ts)).withColumn("_is_end", end).withColumn("_is_start", start)
    value = F.struct(F.col(ts).alias("t"), F.col(event_id).alias("id"), (F.col(status) if status else F.lit(None).cast("int")).alias("s"))
    rows = neighbour(rows, [label], "_seg", [ts, event_id], value, "_e", ahead=True, only=F.col("_is_end"))
    code = F.col("_e.s")
    verdict = F.when(F.col("_e.id").isNull(), "open").when(code >= 400, "error").otherwise("ok")
    return rows.where("_is_start").select(label, F.col(event_id).alias("start_id"), F.col("_e.id").alias("end_id"), F.col(ts).alias("started"),
                                          F.floor((F.unix_micros("_e.t") - F.unix_micros(ts)) / 1000).alias("duration_ms"), verdict.alias("status"))


def pair_spans_stream(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stream-stream left outer interval join of starts (label, start_id, started) and ends (label, end_id, ended)."""
    s, e = starts.withWatermark("started", late), ends.withColumnRenamed("label", "_label").withWatermark("ended", late)
    on = (F.col("label") == F.col("_label")) & (F.col("ended") > F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    return s.join(e, on, "leftOuter").select("label", "start_id", "started", "end_id", "ended")


def event_facts(log: DataFrame, fields: dict[str, dict[str, tuple[str, str]]], kind: str = "event_type", data: str = "props") -> dict[str, DataFrame]:
    """One typed table per event type out of an open log: ``fields[type][column] = (json path, type)``."""
    work = log.withColumn("_v", F.try_parse_json(c(data)))
    return {name: work.where(F.col(kind) == name).select("*", *[F.try_variant_get("_v", path, t).alias(col) for col, (path, t) in cols.items()]).drop("_v", data) for name, cols in fields.items()}


def duration_stats(log: DataFrame, kind: str = "event_type", duration: str = "value", width: float = 1.0) -> DataFrame:
    """(kind, n, avg, p50, p95): exact interpolated percentiles.

    A type may hold most of the log, so its values are never gathered: they are counted, cumulated
    by value segments of ``width``, and each percentile is the smallest value whose running count
    passes its position.
    """
    counts = log.where(F.col(duration).isNotNull()).groupBy(F.col(kind).alias("kind"), F.col(duration).alias("v")).agg(F.count("*").alias("_n"))
    rows = running(counts.withColumn("_seg", F.floor(F.col("v") / width)), ["kind"], "_seg", ["v"], F.col("_n"), "_cum")
    totals = counts.groupBy("kind").agg(big(F.sum("_n")).alias("n"), F.round(F.sum(F.col("v") * F.col("_n")) / F.sum("_n"), 4).alias("avg"))
    rows = rows.join(totals, "kind")

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_cum") > index, F.col("v")))

    def percentile(p: float, name: str) -> list[Column]:
        place = (F.col("n") - 1) * F.lit(p)
        return [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]

    picked = rows.groupBy("kind", "n", "avg").agg(*percentile(0.5, "p50"), *percentile(0.95, "p95"))

    def between(p: float, name: str) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        return F.round(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place - F.floor(place)), 4).alias(name)

    return picked.select("kind", "n", "avg", between(0.5, "p50"), between(0.95, "p95"))
