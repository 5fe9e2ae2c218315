"""Stream replays equal their batch forms."""

from pyspark.sql import functions as F

from postlens.operators import people as I
from postlens.plans import streams as plans
from postlens.plans.people import send_tables
from postlens.sources.tables import events
from postlens.streaming import activity as J
from postlens.streaming.replay import run_append, stream_table


def test_sessions_stream_prefix_of_batch(spark, sf):
    batch = {tuple(r) for r in J.sessions(events(spark, sf), "6 hours").collect()}
    stream = {tuple(r) for r in run_append(J.sessions(stream_table(spark, sf, "events"), "6 hours"), "t").collect()}
    assert stream <= batch and len(stream) > 0.8 * len(batch)


def test_windows_stream_prefix_of_batch(spark, sf):
    batch = {tuple(r) for r in J.activity(events(spark, sf)).collect()}
    stream = {tuple(r) for r in run_append(J.activity(stream_table(spark, sf, "events")), "t").collect()}
    assert stream <= batch and len(stream) > 0.8 * len(batch)


def test_limiter_equals_batch_policy(spark, sf):
    batch = {(r.request_id, r.reason) for r in I.send_policy(*send_tables(spark, sf)).collect()}
    assert {(r.request_id, r.reason) for r in plans.j07(spark, sf).collect()} == batch


def test_redaction_is_stateless(spark, sf):
    log = stream_table(spark, sf, "events").select("event_id", "props")
    got = run_append(J.ingest_trace(log), "t")
    assert got.count() == events(spark, sf).count() and got.where(F.col("props").contains(" ")).count() == 0
