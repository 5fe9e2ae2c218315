"""Keyed state that built-in aggregations cannot express: richest capture with expiry, and the send limiter.

State is exchanged with Python in Arrow batches and kept in the state store's checkpointed files,
so executors may come and go. ``use_rocksdb`` keeps large state off the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlens.rules import records as R

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def latest_state(captures: DataFrame, ttl_seconds: int = 12 * 3600, late: str = "1 hour") -> DataFrame:
    """(key, capture_id, richness, last_us) in update mode: the richest capture of a key, the later on ties.

    ``captures``: key, capture_id, richness, at (timestamp). A thinner capture only refreshes
    ``last_us``; a key without captures for ``ttl_seconds`` of event time is forgotten.
    """
    def keep_richest(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, last = None, None
        if state.exists:
            capture_id, richness, at_us, last = state.get
            best = (richness, at_us, capture_id)
        for frame in frames:  # a fold over batches: a key's rows are never held together
            top = frame.sort_values(["richness", "at_us", "capture_id"]).iloc[-1]
            found = (float(top["richness"]), int(top["at_us"]), int(top["capture_id"]))
            best = found if best is None or found > best else best
            newest = int(frame["at_us"].max())
            last = newest if last is None or newest > last else last
        state.update((best[2], best[0], best[1], last))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "capture_id": [best[2]], "richness": [best[0]], "last_us": [last]})

    rows = captures.withWatermark("at", late).select("key", "capture_id", "richness", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("key").applyInPandasWithState(
        keep_richest, "key long, capture_id long, richness double, last_us long",
        "capture_id long, richness double, at_us long, last_us long", "update", GroupStateTimeout.EventTimeTimeout)


def limit_stream(stream: DataFrame) -> DataFrame:
    """(request_id, allowed, reason). ``stream``: company, kind (0 sent, 2 request), request_id, job_key, at_us.

    The send policy in event order. State per company: count, last send, the sends inside the
    window, and a hash per posting written to.
    """
    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Event order matters, so one company's share of one micro-batch is sorted here; the
        # source's rate limit bounds it.
        frame = pd.concat(list(frames)).sort_values(["at_us", "kind", "request_id"])
        total, last, recent, jobs = state.get if state.exists else (0, 0, [], [])
        recent, jobs, out, span = list(recent), set(jobs), [], R.SEND_WINDOW_DAYS * DAY_US
        for at, kind, request_id, job in zip(frame["at_us"], frame["kind"], frame["request_id"], frame["job"]):
            recent = [t for t in recent if t > at - span]
            if kind == 0:
                total, last = total + 1, int(at)
                recent.append(int(at))
                jobs.add(int(job))
                continue
            if int(job) in jobs:
                reason = "same_posting"
            elif len(recent) >= R.SEND_WINDOW_MAX:
                reason = "window"
            elif total >= R.SEND_BURST and (at - last) // DAY_US < R.SEND_GAP_DAYS:
                reason = "gap"
            else:
                reason = "ok"
            out.append((int(request_id), reason == "ok", reason))
        state.update((int(total), int(last), recent, sorted(jobs)))
        if out:
            yield pd.DataFrame(out, columns=["request_id", "allowed", "reason"])

    rows = stream.select("company", "kind", "request_id", F.xxhash64("job_key").alias("job"), "at_us")
    return rows.groupBy("company").applyInPandasWithState(
        decide, "request_id long, allowed boolean, reason string", "total long, last long, recent array<long>, jobs array<long>",
        "append", GroupStateTimeout.NoTimeout)
