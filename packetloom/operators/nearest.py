"""Nearest known strings by an index of deletions, and the noisy channel fitted to them without labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import channel

#: Two strings d edits apart become equal by at most d deletions from each: rings of this many deletions are tried in turn.
RINGS = (1, 2, 4)


def deletions(text: Column, most: int) -> Column:
    """The distinct strings that a string becomes by up to `most` deletions, itself included."""
    def one_less(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))

    found = level = F.array(text)
    for _ in range(most):
        # a list of one list, so that the level below is computed once
        level = F.flatten(F.transform(F.array(level), lambda x: F.array_distinct(F.flatten(F.transform(x, one_less)))))
        found = F.concat(found, level)
    return F.array_distinct(found)


def similar_strings(observed: DataFrame, known: DataFrame, keys: list[str], edits: int) -> DataFrame:
    """(keys, raw, truth, d): distinct strings of observed (keys, raw) and known (keys, truth) at most `edits` edits apart, any case.

    Both sides are indexed by the hashes of their deletions: only strings that share one meet, and the join's key holds
    the hash, so a frequent key value is spread. The distance itself is computed for each pair once.
    """
    def index(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, name).where(F.col(name).isNotNull()).distinct().withColumn("_v", F.explode(F.transform(deletions(F.lower(name), edits), lambda v: F.xxhash64(v))))

    pairs = index(observed, "raw").join(index(known, "truth"), [*keys, "_v"]).select(*keys, "raw", "truth").distinct()
    return pairs.withColumn("d", F.levenshtein(F.lower("raw"), F.lower("truth"))).where(F.col("d") <= edits)


def candidates(observed: DataFrame, known: DataFrame, group: list[str], keys: list[str], edits: int) -> DataFrame:
    """observed (group, keys, raw) with every truth of its own group (known: group, keys, truth) within `edits` edits, and d.

    Strings repeat over groups: similarity is found for distinct strings of a key, then held against the groups. No group
    is paired with itself.
    """
    pairs = similar_strings(observed, known, keys, edits)
    return observed.join(pairs, [*keys, "raw"]).join(known.select(*group, *keys, "truth").distinct(), [*group, *keys, "truth"])


def best(found: DataFrame, rows: list[str], score: str = "d") -> DataFrame:
    """Per row the truth with the smallest score, ties by distance, then by the truth itself."""
    return found.groupBy(*rows).agg(F.min(F.struct(F.col(score).alias("s"), "d", "truth")).alias("_x")).select(*rows, "_x.truth", "_x.d")


def nearest_truth(observed: DataFrame, known: DataFrame, group: list[str], keys: list[str], rings: tuple[int, ...] = RINGS) -> DataFrame:
    """Distinct (group, keys, raw) of observed with the nearest truth of their group and its distance d; those without one within the last ring are left out.

    Each ring is searched for the rows that the one before left open: a truth found within a ring is nearest of all.
    Null strings match nothing; null groups and keys don't either.
    """
    rows = [*group, *keys, "raw"]
    left, out = observed.select(*rows).where("raw is not null").distinct(), None
    for ring in rings:
        found = best(candidates(left, known, group, keys, ring), rows)
        left = left.join(found, rows, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def fit_channel(observed: DataFrame, known: DataFrame, group: list[str], keys: list[str], edits: int = 2, rounds: int = 20) -> tuple[DataFrame, dict, int]:
    """(assignment, counts, rounds taken): the noisy channel and the truths of damaged strings, fitted to each other without labels.

    The first assignment is the nearest truth; then, by turns, edit operations are counted over all assigned rows and
    every row takes the candidate that the channel gives the highest probability, until the counts stand still. Scores
    are computed for distinct pairs of strings; counts, the letters squared at most, are all that the driver sees. The
    candidates are kept between rounds, so lineage doesn't grow.
    """
    rows = [*group, *keys, "raw"]
    found = candidates(observed.select(*rows).where("raw is not null").distinct(), known, group, keys, edits).persist()
    pairs = found.select("raw", "truth").distinct().persist()
    assigned, before = best(found, rows), None
    for turn in range(1, rounds + 1):
        counted = channel.confusion_counts(assigned.select(F.col("truth").alias("true"), F.col("raw").alias("observed")))
        counts = {(r.op, r.true_ch, r.obs_ch): r.n for r in counted.collect()}
        if counts == before:
            break
        before = counts
        scored = pairs.withColumn("score", -F.round(channel.channel_scores(counts)("raw", "truth"), 9))
        assigned = best(found.join(scored, ["raw", "truth"]), rows, "score")
    return assigned, before or {}, turn
