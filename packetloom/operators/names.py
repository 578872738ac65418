"""Names of two tokens: repair against the lexicon, and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V

# How far each kind of document is trusted for a name.
TIERS = ("manual", "intake", "biometric", "sponsor", "registry")


def token_glyphs(token: Column) -> Column:
    """A leading l, 1, bar or exclamation mark was an I."""
    return F.regexp_replace(token, r"^[l1|!](?=[A-Za-z])", "I")


def repair_token(token: Column, lexicon: tuple[str, ...] = V.NAME_TOKENS) -> Column:
    """struct(value, cost): exact (any case) 0; rn read as m or the reverse 1; else the only token one edit away 1; else null."""
    known, norm = F.array(*[F.lit(t) for t in lexicon]), F.lower(token_glyphs(token))
    same = lambda x: F.get(F.filter(known, lambda v: F.lower(v) == x), F.lit(0))
    exact, swapped = same(norm), F.coalesce(same(F.replace(norm, F.lit("rn"), F.lit("m"))), same(F.replace(norm, F.lit("m"), F.lit("rn"))))
    near = F.filter(known, lambda v: F.levenshtein(F.lower(v), norm, 1) == 1)
    only = F.when(F.size(near) == 1, near[0])
    value = F.coalesce(exact, swapped, only)
    return F.struct(value.alias("value"), F.when(exact.isNotNull(), 0).when(value.isNotNull(), 1).alias("cost"))


def repair_token_far(token: Column, lexicon: tuple[str, ...] = V.NAME_TOKENS) -> Column:
    """struct(value, cost 2): for tokens of six letters or more, the nearest two edits away if the next is four away."""
    norm = F.lower(token_glyphs(token))
    scored = F.array_sort(F.transform(F.array(*[F.lit(t) for t in lexicon]), lambda v: F.struct(F.levenshtein(F.lower(v), norm).alias("d"), v.alias("v"))))
    ok = (F.length(token) >= 6) & (scored[0]["d"] == 2) & (scored[1]["d"] >= 4)
    return F.struct(F.when(ok, scored[0]["v"]).alias("value"), F.when(ok, 2).alias("cost"))


def repair_name(raw: Column, lexicon: tuple[str, ...] = V.NAME_TOKENS) -> Column:
    """struct(value, cost) of a two-token name; null value if either token has none."""
    words = F.filter(F.split(F.trim(raw), r"\s+"), lambda w: w != "")
    first, last = repair_token(words[0], lexicon), repair_token(F.get(words, F.lit(1)), lexicon)
    ok = (F.size(words) == 2) & first["value"].isNotNull() & last["value"].isNotNull()
    return F.struct(F.when(ok, F.concat_ws(" ", first["value"], last["value"])).alias("value"), F.when(ok, first["cost"] + last["cost"]).alias("cost"))


def merge_candidates(candidates: DataFrame, case: str = "case_id") -> DataFrame:
    """One row per (case, tier, name): case_match if any, mismatch if all, least cost, all streams, the most trusted one."""
    return candidates.groupBy(case, "tier", F.lower("name").alias("key")).agg(
        F.min("name").alias("name"), F.bool_or("case_match").alias("case_match"), F.bool_and("case_mismatch").alias("case_mismatch"),
        F.min("edit_cost").alias("edit_cost"), F.array_sort(F.collect_set("stream")).alias("sources"), F.min_by("stream", F.struct("trust", "stream")).alias("stream"),
    )


def select_candidate(merged: DataFrame, case: str = "case_id") -> DataFrame:
    """The best name per case; mismatched cases are out. Registry before sponsor before the rest, then more support, less repair, name."""
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    support = F.size("sources")
    order = Window.partitionBy(case).orderBy(F.col("case_match").desc(), tier.desc(), support.desc(), "edit_cost", "name")
    ranked = merged.where(~F.col("case_mismatch")).withColumn("_r", F.row_number().over(order))
    return ranked.where("_r = 1").drop("_r", "key")


def token_lexicon(names: DataFrame, column: str = "applicant_name") -> DataFrame:
    """(token, n_first, n_last, n) over names of exactly two tokens."""
    words = names.select(F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda w: w != "").alias("w")).where("size(w) = 2")
    tokens = words.select(F.explode(F.array(F.struct(F.col("w")[0].alias("token"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("w")[1].alias("token"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("x")).select("x.*")
    return tokens.groupBy("token").agg(F.sum("f").alias("n_first"), F.sum("l").alias("n_last"), F.count("*").alias("n"))
