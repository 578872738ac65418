"""Queries that read the events as streams, each equal to a batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .queries import query

_GAP, _LATE, _NEXT = 1800, 600, 3600


def _read(spark, sf_dir):
    return streams.read(spark, f"{sf_dir}/events.parquet")


@query(f"""WITH marked AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL {_GAP} SECOND, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
found AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, sum(value) AS total FROM numbered GROUP BY user_id, island)
SELECT user_id, epoch_us(first) AS first_us, epoch_us(last) AS last_us, n, round(total, 4) AS total FROM found
WHERE last + INTERVAL {_GAP} SECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL {_LATE} SECOND""")
def session_windows(spark, sf_dir):
    """Sessions of each user that the watermark has closed when the stream ends."""
    found = streams.gathered(streams.sessions(_read(spark, sf_dir), ["user_id"], f"{_GAP} seconds", f"{_LATE} seconds"))
    micros = lambda c: F.unix_micros(F.col(c))
    return found.select("user_id", micros("start").alias("first_us"), (micros("end") - _GAP * 1_000_000).alias("last_us"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def replayed_events(spark, sf_dir):
    """A source that delivers every event twice, counted once."""
    twice = _read(spark, sf_dir).unionByName(_read(spark, sf_dir))
    once = streams.gathered(streams.without_repeats(twice, ["event_id"]))
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query(f"""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {_NEXT} SECOND
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def clicks_then_purchases(spark, sf_dir):
    """Purchases within an hour of a click of the same user: a join of two streams with bounded states."""
    events = _read(spark, sf_dir)
    pairs = streams.gathered(streams.followed_by(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", f"{_NEXT} seconds", f"{_LATE} seconds"))
    return pairs.select(F.col("first_key").alias("user_id"), "first_id", "then_id")


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    """Events per type and hour: the windows of a stream, over all that is there."""
    counted = streams.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return counted.select("event_type", F.unix_micros("window.start").alias("hour_us"), "n")
