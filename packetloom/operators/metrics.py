"""Scores: classification points, weighted extraction, calibration, reliability, folds, joins of truth and prediction."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.similarity import EditDistances
from ..functions.text import squeeze


def points(truth: Column, action: Column) -> Column:
    """8 for a hit, -4 for approving a denied case, 2 for a review that wasn't needed, 1 for missing one."""
    return F.when(truth == action, 8).when((truth == "DENIED") & (action == "APPROVED"), -4).when(action == "NEEDS_REVIEW", 2).when(truth == "NEEDS_REVIEW", 1).otherwise(0)


def points_by(df: DataFrame, truth: str, action: str, columns: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """Rows, points and false approvals for each of several sets of columns, in one aggregate; level has a bit for each column that isn't part of a row's set.

    A null in a column and a column left out are told apart by level.
    """
    t, a = F.col(truth), F.col(action)
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns))
    scored = grouped.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum(points(t, a)).alias("points"), F.count_if((t == "DENIED") & (a == "APPROVED")).alias("false_approvals"))
    return scored.select(*columns, "level", "n", "points", "false_approvals")


def normal_value(value: Column) -> Column:
    return F.lower(squeeze(F.coalesce(value, F.lit(""))))


def normal_flags(value: Column) -> Column:
    atoms = F.filter(F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce(F.lower(value), F.lit("")), r"\|"), F.trim))), lambda x: ~x.isin("", "none", "unknown", "null", "n/a"))
    return F.when(F.size(atoms) == 0, "none").otherwise(F.array_join(atoms, "|"))


def classification(df: DataFrame, truth: str, action: str) -> DataFrame:
    """One row: n, points, accuracy, approvals of denied cases, and the score out of 80."""
    p = points(F.col(truth), F.col(action))
    return df.agg(
        F.count("*").alias("n"), F.sum(p).alias("points"), F.avg((F.col(truth) == F.col(action)).cast("double")).alias("accuracy"),
        F.sum(((F.col(truth) == "DENIED") & (F.col(action) == "APPROVED")).cast("long")).alias("false_approvals"), (F.sum(p) * 80.0 / (F.count("*") * 8)).alias("score"),
    )


def extraction(df: DataFrame, truth_prefix: str = "t_", prediction_prefix: str = "p_") -> DataFrame:
    """One row: the weighted share of matching fields out of 50 and the misses per field."""
    hit = {f: ((normal_flags if f == "risk_flags" else normal_value)(F.col(truth_prefix + f)) == (normal_flags if f == "risk_flags" else normal_value)(F.col(prediction_prefix + f))) for f in V.FIELD_WEIGHTS}
    weighted = reduce(lambda a, b: a + b, [hit[f].cast("long") * w for f, w in V.FIELD_WEIGHTS.items()])
    return df.agg((F.sum(weighted) * 50.0 / (F.count("*") * sum(V.FIELD_WEIGHTS.values()))).alias("score"), *[F.sum((~hit[f]).cast("long")).alias(f"missed_{f}") for f in V.FIELD_WEIGHTS])


def brier(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """One row: the Brier score and 20 * max(0, 1 - 2 * Brier)."""
    b = F.avg(F.pow(F.col(confidence) - F.col(correct).cast("double"), 2))
    return df.agg(b.alias("brier"), (20 * F.greatest(F.lit(0.0), 1 - 2 * b)).alias("score"))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per equal-width bin (the last one closed): n, mean confidence, accuracy."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def class_precision(df: DataFrame, truth: str, action: str, least: int = 20) -> DataFrame:
    """Precision of each action; 1 below `least` rows."""
    return df.groupBy(action).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.avg((F.col(truth) == F.col(action)).cast("double"))).otherwise(1.0).alias("precision"))


def change_matrix(df: DataFrame, before: str, after: str, truth: str) -> DataFrame:
    return df.where(F.col(before) != F.col(after)).groupBy(before, after, truth).agg(F.count("*").alias("n"), F.sum(points(F.col(truth), F.col(after)) - points(F.col(truth), F.col(before))).alias("gain"))


def by_fold(df: DataFrame, fold: str, value: str) -> DataFrame:
    """Mean, population deviation, least and most of the folds' means."""
    per = df.groupBy(fold).agg(F.avg(value).alias("m"))
    return per.agg(F.count("*").alias("folds"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.min("m").alias("least"), F.max("m").alias("most"))


def assign_folds(df: DataFrame, key: str, folds: int = 6, seed: int = 0) -> DataFrame:
    """fold by a hash of the key: the same for reruns and for any partitioning, no global order."""
    return df.withColumn("fold", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def coverage(truth: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: ids missing from the predictions, extra ids, repeated ids."""
    missing = truth.join(predictions, key, "left_anti").agg(F.count("*").alias("missing"))
    extra = predictions.join(truth, key, "left_anti").agg(F.count("*").alias("extra"))
    repeated = predictions.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    return missing.crossJoin(extra).crossJoin(repeated)  # three single rows


def threshold_grid(spark) -> DataFrame:
    """The grid of decision thresholds, without those whose approval ceiling reaches the denial threshold."""
    axes = {  # fixed values: the thresholds that are tried
        "dq_deny": (0.35, 0.5, 0.65, 0.8), "dq_ceiling": (0.2, 0.35, 0.5), "approve": (0.5, 0.58, 0.7, 0.82),
        "deny": (0.42, 0.52, 0.65, 0.8), "review": (0.45, 0.6, 0.72, 0.84),
    }
    grid = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(n) for n, values in axes.items()])
    for name in axes:
        grid = grid.withColumn(name, F.explode(name))
    return grid.where("dq_ceiling < dq_deny")


def select_config(scored: DataFrame) -> DataFrame:
    """The configuration with fewest false approvals, then most points, most hits, highest approval and lowest review threshold."""
    best = F.min(F.struct(F.col("false_approvals"), (-F.col("points")).alias("p"), (-F.col("correct")).alias("c"), (-F.col("approve")).alias("a"), F.col("review"), F.col("deny"), F.col("dq_deny"), F.col("dq_ceiling")))
    x = scored.agg(best.alias("x"))
    return x.select("x.false_approvals", (-F.col("x.p")).alias("points"), (-F.col("x.c")).alias("correct"), (-F.col("x.a")).alias("approve"), "x.review", "x.deny", "x.dq_deny", "x.dq_ceiling")


def page_error_rates(items: DataFrame, texts: DataFrame, block: int = 256, part: int = 4096) -> DataFrame:
    """item_id, n, cer: the mean error rate of each of items (item_id, expected) over all of texts (observed), whole and in any letters.

    Repeated and blank rows of either count. A text at least twice as long as the item is as many edits away as the item
    has letters, so its rate is 1 and needs no alignment; the other pairs are aligned in full, equal texts once, blocks of
    items of like length against parts of the texts.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("expected", F.lit("")).alias("expected")).groupBy("item_id", "expected").agg(F.count("*").alias("times")).withColumn("size", F.length("expected"))
    longest, many = items.agg(F.max("size"), F.count("*")).first()
    length, near = F.length("observed"), (F.length("observed") < 2 * (longest or 0)) & (F.trim("observed") != "")
    n, close = texts.agg(F.count("*"), F.count_if(near)).first()
    blocks, parts = math.ceil(many / block), max(1, math.ceil(close / part))
    some = items.where(F.trim("expected") != "").withColumn("block", F.floor(F.col("size") / 64) * blocks + F.pmod(F.xxhash64("item_id", "expected"), F.lit(blocks or 1)))
    reach = some.groupBy("block").agg(F.max("size").alias("reach")).withColumnRenamed("block", "at")
    distinct = texts.where(near).groupBy("observed").agg(F.count("*").alias("copies")).withColumn("part", F.pmod(F.xxhash64("observed"), F.lit(parts)))
    dealt = distinct.join(reach, length < 2 * F.col("reach")).select("at", "part", "observed", "copies")
    known = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("block", F.col("part").cast("long").alias("part"), "item_id", "expected", "times", "size")
    schema = pa.schema([("item_id", pa.int64()), ("expected", pa.string()), ("saved", pa.int64())])

    def aligned(left: pa.Table, right: pa.Table) -> pa.Table:
        """Edits that each item is spared against a rate of 1."""
        expected = right.column("expected").to_pylist()
        sizes, spared, distances = [len(e) for e in expected], [0] * len(expected), EditDistances(expected)
        for observed, copies in zip(left.column("observed").to_pylist(), left.column("copies").to_pylist()):
            for i, d in enumerate(distances(observed)):
                if d < sizes[i]:
                    spared[i] += copies * (sizes[i] - d)
        return pa.table([right.column("item_id"), pa.array(expected, pa.string()), pa.array(spared, pa.int64())], schema=schema)

    saved = dealt.toDF("block", "part", "observed", "copies").groupBy("block", "part").cogroup(known.groupBy("block", "part")).applyInArrow(aligned, "item_id long, expected string, saved long")
    every = items.select("item_id", "expected", "times", "size", F.lit(0).cast("long").alias("saved")).unionByName(saved.select("item_id", "expected", F.lit(0).cast("long").alias("times"), F.lit(0).alias("size"), "saved"))
    each = every.groupBy("item_id", "expected").agg(F.sum("times").alias("times"), F.max("size").alias("size"), F.sum("saved").alias("saved")).where(F.lit(n > 0))
    rate = F.when(F.col("saved") > 0, 1 - F.col("saved") / F.col("size") / n).otherwise(F.lit(1.0))
    return each.groupBy("item_id").agg((F.sum("times") * n).alias("n"), (F.sum(F.col("times") * rate) / F.sum("times")).alias("cer"))
