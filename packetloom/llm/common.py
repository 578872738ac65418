"""Helpers that the operators share: tables in the shared folder, connected components, Arrow glue."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this package: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting that drops a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and is local (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="packetloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd", batch_rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, a lost executor recomputes nothing before it.

    Shuffle files of the query that fills the table go when it ends: nothing reads them again. batch_rows: of an Arrow
    batch in this query, where rows are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packetloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    mine = {CLEANUP: "true"} | ({} if batch_rows is None else {ARROW_ROWS: str(batch_rows)})
    before = {name: spark.conf.get(name, None) for name in mine}
    for name, value in mine.items():
        spark.conf.set(name, value)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)
        _written.remove((table.sparkSession, table.written_to))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete the tables that materialize() wrote; runs by itself when Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone: nothing can be deleted any more
            return


atexit.register(release)


def give_back() -> None:
    """At the end of a task that held much: return freed memory to the system. Python workers live on, beside those of the next stages."""
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory to the system, without a search for cycles: within a task, where blocks of all sizes come and go."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a GNU system
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds over the edge table; each round ends in the shared folder. A node's
    neighbours are never gathered: the minimum is a partial aggregate, joined back to the edges. Null and self edges
    are ignored; no edges give no rows.
    """
    cur = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name,
    )
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        cur = materialize(nxt, name)
        # Sums over all edges tell whether the last round changed anything.
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
