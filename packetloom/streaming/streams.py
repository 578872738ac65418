"""Streams: packets decided as they arrive, and totals of a bounded stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _state_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one. Only where the session names none and is local (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="packetloom-")
    return f"{base.rstrip('/')}/packetloom-stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder, or a single file, as a stream with the schema of what is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # streams read folders: of a single file's folder, only that file
    return source.parquet(path) if folder else source.option("pathGlobFilter", where.getName()).parquet(str(where.getParent().toString()))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts and sums per event type of all that is there now, by a stream that ends when it has read it."""
    out = _state_dir(spark)
    agg = read(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")

    agg.writeStream.outputMode("complete").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").start().awaitTermination()
    result = spark.read.parquet(f"{out}/result")
    last = result.agg(F.max("batch").alias("last"))
    return result.join(F.broadcast(last), F.col("batch") == F.col("last")).select("event_type", "n", F.round("total", 4).alias("total"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per type and tumbling window; events later than the watermark are left out, so state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Per key the sessions of events at most gap apart: start, end (of the last event plus gap), n, total.

    Streams: a session is given once the watermark has passed its end, and then forgotten; later events of it are left
    out. Batches: all sessions.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = timed.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def without_repeats(events: DataFrame, keys: list[str], late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """The first event of each key; keys are remembered for as long as a repeat may arrive late, no longer."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def followed_by(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of events (event_id, key, ts) of one key, the second at most `within` after the first; both sides' states end with their watermarks."""
    side = lambda df, name: df.select(F.col("event_id").alias(f"{name}_id"), F.col(key).alias(f"{name}_key"), F.col("ts").cast("timestamp").alias(f"{name}_ts")).withWatermark(f"{name}_ts", late)
    a, b = side(first, "first"), side(then, "then")
    near = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("first_key") == F.col("then_key")) & near)


def gathered(df: DataFrame) -> DataFrame:
    """Run a stream until it has read all there is, and return its rows; batches that are replayed overwrite their own folder."""
    spark, out = df.sparkSession, _state_dir(df.sparkSession)
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")

    df.writeStream.outputMode("append").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").start().awaitTermination()
    return spark.read.option("basePath", f"{out}/result").schema(schema).parquet(f"{out}/result")


def decide_stream(evidence: DataFrame, decide, sink: str, state: str, once: bool = True):
    """Run decide(batch) on each micro-batch and append to sink; a batch that is replayed after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = evidence.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()
