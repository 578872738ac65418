"""Streams in several batches: sessions, repeats, interval joins, replays."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.streaming import streams

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture
def source(spark, tmp_path):
    """A stream that reads one batch of events per trigger, in order."""
    def make(*batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame([(n, at(m), u, t, 1.0) for n, m, u, t in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")

    return make


def test_sessions_span_batches_and_close_with_the_watermark(source):
    df = source([(1, 0, 1, "a"), (2, 20, 1, "a"), (3, 0, 2, "a")], [(4, 40, 1, "a"), (5, 200, 9, "a")], [(7, 300, 9, "a")], [(6, 45, 1, "a"), (8, 310, 9, "a")])
    got = {(r.user_id, r.start, r.end): r.n for r in streams.gathered(streams.sessions(df, ["user_id"], "30 minutes", "10 minutes")).collect()}
    # event 6 comes after its session was closed; user 9's last one is still open
    assert got == {(1, at(0), at(70)): 3, (2, at(0), at(30)): 1, (9, at(200), at(230)): 1}


def test_batches_give_all_sessions(spark):
    df = spark.createDataFrame([(i, at(m), 1, "a", 2.0) for i, m in enumerate([0, 29, 59, 90, 200])], EVENTS)
    assert sorted((r.n, r.total) for r in streams.sessions(df, ["user_id"], "30 minutes").collect()) == [(1, 2.0), (1, 2.0), (3, 6.0)]


def test_repeats_within_the_watermark_go(source):
    df = source([(1, 0, 1, "a"), (1, 1, 1, "a"), (2, 2, 1, "a")], [(2, 2, 1, "a"), (3, 5, 1, "a")], [(3, 5, 1, "a"), (4, 6, 1, "a")])
    assert sorted(r.event_id for r in streams.gathered(streams.without_repeats(df, ["event_id"])).collect()) == [1, 2, 3, 4]


def test_pairs_are_found_over_batches(source, spark, tmp_path):
    batches = [[(1, 0, 1, "click"), (2, 5, 2, "click")], [(3, 50, 1, "purchase"), (4, 66, 2, "purchase"), (5, 50, 3, "purchase")], [(6, 59, 1, "purchase"), (7, 60, 1, "click"), (8, 61, 1, "purchase")]]
    df = source(*batches)
    pairs = streams.gathered(streams.followed_by(df.where("event_type = 'click'"), df.where("event_type = 'purchase'"), "user_id", "60 minutes"))
    assert sorted((r.first_id, r.then_id) for r in pairs.collect()) == [(1, 3), (1, 6), (7, 8)]


def test_a_replayed_batch_overwrites_itself(spark, source, tmp_path):
    df = source([(1, 0, 1, "a")], [(2, 1, 1, "b")])
    decide = lambda batch: batch.select("event_id", F.upper("event_type").alias("t"))
    for state in ("one", "two"):  # the second run starts without the first one's state: every batch is delivered again
        streams.decide_stream(df, decide, f"{tmp_path}/sink", f"{tmp_path}/{state}").awaitTermination()
    assert sorted((r.event_id, r.t) for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [(1, "A"), (2, "B")]


def test_windowed_counts_leave_late_events_out(source):
    df = source([(1, 0, 1, "a"), (2, 10, 1, "a")], [(3, 200, 1, "a")], [(6, 210, 1, "b")], [(4, 20, 1, "a"), (5, 400, 1, "a")])
    got = {(r.window.start, r.event_type): r.n for r in streams.gathered(streams.windowed_counts(df)).collect()}
    assert got == {(at(0), "a"): 2, (at(180), "a"): 1, (at(180), "b"): 1}
