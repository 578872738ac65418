"""Joins of places that lie near each other, by cells as wide as the reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S


def words(docs: DataFrame, key: str, text: str, pattern: str = r"[^\x20\x09-\x0D]+") -> DataFrame:
    """(key, start, end, text): the words of whole texts with their places."""
    found = docs.select(key, F.explode(S.spans_of(F.col(text), {"word": pattern})["word"]).alias("_w"))
    return found.select(key, F.col("_w.start").cast("long").alias("start"), F.col("_w.end").cast("long").alias("end"), F.col("_w.text").alias("text"))


def _cells(left: DataFrame, right: DataFrame, place: str, reach: int) -> tuple[DataFrame, DataFrame, Column]:
    own = F.floor(F.col(place) / reach)
    left = left.withColumn("_cell", own)
    right = right.withColumn("_at", F.col(place)).drop(place).withColumn("_cell", F.explode(F.array(*[F.floor(F.col("_at") / reach) + i for i in (-1, 0, 1)])))
    return left, right, F.abs(F.col(place) - F.col("_at")) <= reach


def pairs_within(left: DataFrame, right: DataFrame, keys: list[str], place: str, reach: int) -> DataFrame:
    """Rows of left with those rows of right of the same keys whose place is at most reach away; right's place is right_<place>.

    Every row of left has one cell, every row of right its own and both neighbours: two rows within reach meet in exactly
    one cell. The join's key holds the cell, so a long document is spread over many tasks. Other columns of right must
    not be named like left's. Rows with a null key or place have no neighbours.
    """
    left, right, near = _cells(left, right, place, reach)
    return left.join(right, [*keys, "_cell"]).where(near).drop("_cell").withColumnRenamed("_at", f"right_{place}")


def with_neighbour(left: DataFrame, right: DataFrame, keys: list[str], place: str, reach: int) -> DataFrame:
    """Rows of left that have a row of right with the same keys at most reach away, each once."""
    left, right, near = _cells(left, right.select(*keys, place), place, reach)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_cell").alias("_r_cell"), "_at")
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    met = F.col("_cell") == F.col("_r_cell")
    for c in same:
        met = met & c
    return left.join(r, met & near, "left_semi").drop("_cell")
