"""Packet files, tables of truth, manifests, learned artefacts, the stream cache and the prediction sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import structure_hits

#: Structural labels that make a native text complete enough to need no further reading.
ENOUGH_HITS = 5


def scan_packets(spark: SparkSession, folder: str, pattern: str = "*.pdf", stream: bool = False) -> DataFrame:
    """(case_id, path, content, content_sha) of packet files; the id is the file's stem. Files are read by Spark: any store will do."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(stem.alias("case_id"), "path", "content", F.sha2("content", 256).alias("content_sha"))


def acquire(packets: DataFrame, engine: Callable[[bytes], dict[str, str]] | None, trust: dict[str, int]) -> DataFrame:
    """(case_id, stream, trust, text, error): the texts that an engine reads from each packet.

    engine maps a file's bytes to {stream: text}; it is made by the caller and runs in the Python workers. A packet that it
    fails on gives one row with the error and no text; no failure ends the batch. engine=None: no rows.
    """
    out = "case_id string, stream string, trust int, text string, error string"
    if engine is None:
        return packets.sparkSession.createDataFrame([], out)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for case, content in zip(b["case_id"], b["content"]):
                try:
                    rows += [(case, s, trust.get(s, len(trust)), t, None) for s, t in engine(bytes(content)).items()]
                except Exception as e:  # one bad packet is its own row's problem
                    rows.append((case, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["case_id", "stream", "trust", "text", "error"])

    return packets.select("case_id", "content").mapInPandas(read, out)


def plain_text_engine(content: bytes) -> dict[str, str]:
    """The engine for packets that are text already."""
    return {"native": content.decode("utf-8")}


def pdf_text_engine(content: bytes) -> dict[str, str]:
    """Native text by an optional PDF library; raises where none is installed."""
    import io

    from pypdf import PdfReader

    return {"native": "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)}


def needs_reading(streams: DataFrame) -> DataFrame:
    """case_ids whose native text is too thin: fewer than ENOUGH_HITS structural labels, or no fee or visa label. Only these go to costlier engines."""
    text = F.lower("text")
    return streams.where("stream = 'native'").where((structure_hits(F.col("text")) < ENOUGH_HITS) | ~(text.contains("fee status") & text.contains("visa class"))).select("case_id")


def cache_key(version: str) -> Column:
    """Key of a cached reading: what was read and by which code."""
    return F.substring(F.sha1(F.concat_ws(":", F.lit(version), F.col("content_sha"))), 1, 16)


def read_through(packets: DataFrame, cache: DataFrame | None, version: str, engine: Callable[[bytes], dict[str, str]], trust: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(all readings, new readings): cached ones by key, the others read now. Append the new ones to the cache; readings carry cache_key."""
    keyed = packets.withColumn("cache_key", cache_key(version))
    misses = keyed if cache is None else keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    new = acquire(misses, engine, trust).join(misses.select("case_id", "cache_key"), "case_id")
    if cache is None:
        return new, new
    hits = cache.join(keyed.select("cache_key", F.col("case_id").alias("_c")), "cache_key").withColumn("case_id", F.col("_c")).drop("_c")
    return hits.unionByName(new), new


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows with their declared schema."""
    return spark.read.option("header", True).schema(schema.TRUTH).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One case id per line; blank lines and repeats don't count."""
    return spark.read.text(path).select(F.trim("value").alias("case_id")).where("case_id <> ''").distinct()


def write_predictions(df: DataFrame, path: str) -> None:
    """One JSON object per line, keys in alphabetical order, lines in order of case_id; Spark sorts by range, in parallel."""
    df.select(*sorted(schema.PREDICTION.names)).orderBy("case_id").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PREDICTION).json(path)


def read_sponsor_policy(spark: SparkSession, path: str) -> list[str]:
    """Sponsors of a learned policy artefact (a few names); artefacts that hold case ids, file names or document hashes are refused."""
    row = spark.read.option("multiLine", True).json(path)
    guard = row.select("anti_leakage.*").first().asDict()
    if any(guard.get(k) for k in ("contains_case_ids", "contains_document_hashes", "contains_filenames")):
        raise ValueError("the artefact identifies documents")
    required = row.select("criteria.single_exception_required_leave_one_fold_selections").first()[0]
    counts = row.select("crossfit_selection_counts.*").first().asDict()
    return sorted(s for s, n in counts.items() if n >= required)
