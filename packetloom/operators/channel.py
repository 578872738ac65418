"""The noisy channel: confusion counts, candidate scores, and corrections by provenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.similarity import alignment_udf, channel_log_probability
from ..functions.text import missing_for_channel
from .fusion import protected
from .ranking import top1_with_margin

# Margins of the two methods, relative edit limit, and when a filled value also settles a conflict.
MARGIN = {"levenshtein": 1.0, "weighted_confusion": 1.5, "conf_aware": 1.5}
RELATIVE_EDIT, HIGH_MARGIN, HIGH_POSTERIOR = 0.45, 3.0, 0.95


def confusion_counts(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Operation counts of (true, observed) pairs, over all rows; pairs more than four edits and 60 % apart don't count. Each distinct pair is aligned once."""
    keys = keys or []
    pairs = pairs.groupBy(*keys, "true", "observed").agg(F.count("*").alias("_rows"))
    d = F.levenshtein("true", "observed")
    fit = pairs.where(~((d > 4) & (d / F.greatest(F.length("true"), F.length("observed"), F.lit(1)) > 0.6)))
    ops = fit.select(*keys, "_rows", F.explode(alignment_udf("true", "observed")).alias("x")).select(*keys, "_rows", "x.*")
    return ops.groupBy(*keys, "op", "true_ch", "obs_ch").agg(F.sum("_rows").alias("n"))


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("op", "true_ch", "obs_ch").agg(F.sum("n").alias("n"))


def leave_group_out(counts: DataFrame, group: str, keys: list[str], n: str = "n") -> DataFrame:
    """For each group and key, the counts of all other groups: total minus own."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = counts.alias("c").join(total.alias("t"), same)
    return joined.select(f"c.{group}", *[f"c.{k}" for k in keys], (F.col("_total") - F.col(f"c.{n}")).alias(n))


def edit_score(raw: Column, candidate: Column) -> Column:
    """Score of the edit method: prefixes near 10, contained values near 5, else minus the distance; null if too far."""
    a, b = F.replace(F.lower(raw), F.lit(" "), F.lit("")), F.replace(F.lower(candidate), F.lit(" "), F.lit(""))
    d, longest = F.levenshtein(a, b), F.greatest(F.length(a), F.length(b), F.lit(1))
    prefix, inside = b.startswith(a) | a.startswith(b), b.contains(a) | a.contains(b)
    score = F.when(prefix, 10.0 - F.abs(F.length(b) - F.length(a)) / longest).when(inside, 5.0 - d / longest).otherwise(-d.cast("double"))
    return F.when((d / longest <= RELATIVE_EDIT) | (d <= 3) | inside, score)


def rank_candidates(tokens: DataFrame, field: str, raw: str = "raw") -> DataFrame:
    """tokens x the field's vocabulary with scores of the edit method; the vocabulary (at most 13 values) is exploded in the row."""
    values = F.array(*[F.lit(v) for v in V.vocabulary(field)])
    scored = tokens.withColumn("candidate", F.explode(values)).withColumn("score", edit_score(F.col(raw), F.col("candidate")))
    return scored.where("score is not null")


def correct(tokens: DataFrame, field: str, keys: list[str], raw: str = "raw") -> DataFrame:
    """The best candidate per key and token, if it leads by the method's margin."""
    return top1_with_margin(rank_candidates(tokens, field, raw), [*keys, raw], "score", ["candidate"], MARGIN["levenshtein"] - 1e-9)


def channel_scores(counts: dict | None = None):
    """An Arrow function (observed, candidate) -> log probability; counts is a small confusion table (letters squared)."""
    known = dict(counts or {})

    @F.pandas_udf("double")
    def score(observed: pd.Series, candidate: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or c is None else channel_log_probability(o, c, known) for o, c in zip(observed, candidate)])

    return score


def settles_conflict(mode: Column, streams: Column, margin: Column, posterior: Column, policy: str = "C") -> Column:
    """Whether a repair takes its field out of the untrusted conflicts: policy C never, A repairs of wrong values by two streams, B also strong fills."""
    if policy == "C":
        return F.lit(False)
    wrong = (mode == "wrong_nonempty") & (streams >= 2)
    return wrong | ((mode == "fill_missing") & (streams >= 2) & (margin >= HIGH_MARGIN) & (posterior >= HIGH_POSTERIOR)) if policy == "B" else wrong


def may_correct(value: Column, source: Column, field: str, streams: Column) -> Column:
    """fill_missing or wrong_nonempty where a correction may be made, else null."""
    off_list = ~value.isin(*V.vocabulary(field))
    return F.when(protected(source), None).when(missing_for_channel(value), "fill_missing").when(off_list & (streams >= 2), "wrong_nonempty")
