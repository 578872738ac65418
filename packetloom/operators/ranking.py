"""Ranking: the best row per key, accepted only with a margin; votes; set algebra on flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze


def top1_with_margin(df: DataFrame, keys: list[str], score: str, tie: list[str], margin: float, descending: bool = True) -> DataFrame:
    """The best row of each key, if the next score is at least margin worse (or there is none). tie makes the order total."""
    first = F.col(score).desc() if descending else F.col(score).asc()
    order = Window.partitionBy(*keys).orderBy(first, *tie)
    ranked = df.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order)).where("_rank = 1")
    gap = (F.col(score) - F.col("_next")) if descending else (F.col("_next") - F.col(score))
    return ranked.withColumn("lead_over_next", gap).where(F.col("_next").isNull() | (gap >= margin)).drop("_rank", "_next")


def best_of(df: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """The value with the highest score per key, ties to the smaller value: a partial aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))).alias("_x")).select(*keys, F.col("_x.v").alias(value), (-F.col("_x.s")).alias(score))


def majority(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Per key: the value that more than half of its rows hold, else the first by pos; and whether there were several."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    votes = F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col(value).alias("v")))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_values"), votes.alias("top"),
        F.min(F.struct("first", F.col(value).alias("v"))).alias("head"),
    ).select(*keys, F.when(-2 * F.col("top.n") > F.col("total"), F.col("top.v")).otherwise(F.col("head.v")).alias(value), (F.col("distinct_values") > 1).alias("conflict"))


def consensus(df: DataFrame, keys: list[str], value: str, voter: str, least: int = 2) -> DataFrame:
    """Per key the value with most distinct voters, if at least `least` and no other has as many."""
    votes = df.groupBy(*keys, value).agg(F.countDistinct(voter).alias("votes"))
    return top1_with_margin(votes.where(F.col("votes") >= least), keys, "votes", [value], 1).drop("lead_over_next")


def nearest_in_vocabulary(df: DataFrame, key: str, raw: str, values: tuple[str, ...], limit: int, margin: int = 1) -> DataFrame:
    """key, raw, value, distance: the vocabulary value nearest to raw (edit distance, any case), within limit and unique by margin.

    The vocabulary travels as an array in each row: no join, no shuffle.
    """
    norm = F.lower(squeeze(F.col(raw)))
    scored = [F.struct(F.levenshtein(norm, F.lit(v.lower())).alias("d"), F.lit(v).alias("v")) for v in sorted(values)]
    ranked = df.select(key, raw, F.array_sort(F.array(*scored)).alias("_r"))
    best, second = F.col("_r")[0], F.get("_r", F.lit(1))
    keep = (best["d"] <= limit) & (second.isNull() | (second["d"] - best["d"] >= margin))
    return ranked.where(keep).select(key, raw, best["v"].alias("value"), best["d"].alias("distance"))


def union_except(base: Column, more: Column, without: Column) -> Column:
    """Sorted distinct values of base and more, without those of the third."""
    return F.array_sort(F.array_except(F.array_union(base, more), without))


def agreed_by_all(df: DataFrame, keys: list[str], value: str, voter: str) -> DataFrame:
    """Values that every voter of a key holds."""
    voters = df.groupBy(*keys).agg(F.countDistinct(voter).alias("voters"))
    held = df.groupBy(*keys, value).agg(F.countDistinct(voter).alias("holders"))
    return held.join(voters, keys).where("holders = voters").select(*keys, value)


def first_decisive(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The non-null value of the row that comes first."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def latest_open(df: DataFrame, keys: list[str], value: str, order: str, crossed: str) -> DataFrame:
    """Per key the latest value that isn't crossed out, else the latest: partial aggregates, ties to the greater value. Null crossed counts as not."""
    last = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    found = df.groupBy(*keys).agg(F.max(F.when(~F.coalesce(F.col(crossed), F.lit(False)), last)).alias("open"), F.max(last).alias("any"))
    return found.select(*keys, F.coalesce("open", "any")["v"].alias(value))


def top(df: DataFrame, score: str, tie: str, n: int = 15) -> DataFrame:
    """The n rows with the highest score, ties by the smaller tie: each task keeps n."""
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(n)


def ordered_distinct(*lists: Column) -> Column:
    """The values of lists in the order in which they first stand."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def unique_value(values: Column) -> Column:
    """The only value of a list, repeats aside; null if there are several or none."""
    held = F.array_distinct(F.array_compact(values))
    return F.when(F.size(held) == 1, held[0])


def rows_where(df: DataFrame, condition: Column, *columns: Column) -> DataFrame:
    """df.where(condition).select(columns), for conditions nested so deep that inferring further filters from them takes minutes: a row is exploded or isn't."""
    return df.select(F.explode(F.when(condition, F.array(F.struct(*columns)))).alias("_x")).select("_x.*")
