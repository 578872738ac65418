"""Calibration of confidences and the expected-utility arbiter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from .rules import some


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibration_features(decision: str = "rule_decision", raw: str = "raw_confidence") -> dict[str, Column]:
    """The calibrator's features by name, from decided evidence rows."""
    one = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    is_ = {d: one(F.col(decision) == d) for d in V.LABELS}
    r, lg = F.col(raw), logit(F.col(raw))
    seen = {s: one(F.array_contains("sources_seen", s)) for s in ("intake", "fee", "registry", "biometric", "adjudicator")}
    observed = one(F.col("observed_flags_seen"))
    reasons = F.col("reasons")
    size = lambda name: F.size(name).cast("double")
    return {
        "raw_confidence": r, "logit_raw": lg, **{f"dec_{d}": is_[d] for d in V.LABELS},
        "logit_x_APPROVED": lg * is_["APPROVED"], "logit_x_DENIED": lg * is_["DENIED"], "logit_x_REVIEW": lg * is_["NEEDS_REVIEW"],
        "raw_x_APPROVED": r * is_["APPROVED"], "raw_x_DENIED": r * is_["DENIED"], "raw_x_REVIEW": r * is_["NEEDS_REVIEW"],
        "n_missing": size("missing"), "observed_flags_seen": observed, "n_flags": F.size(F.array_distinct("risk_flags")).cast("double"),
        "has_dq_flag": one(some(F.col("risk_flags"), V.DISQUALIFYING)), "has_review_flag": one(some(F.col("risk_flags"), V.REVIEW_ONLY)),
        "n_conflicts": size("conflicts"), "has_untrusted_conflicts": one(F.size("untrusted_conflicts") > 0),
        **{f"src_{s}": x for s, x in seen.items()}, "src_complete": seen["intake"] * seen["fee"] * observed,
        "hard_policy": one(some(reasons, V.HARD_REASONS)), "policy_review": one(some(reasons, V.POLICY_REVIEW_REASONS)),
        "meta_approve": one(some(reasons, V.META_APPROVE_REASONS)), "clean_reason": one(some(reasons, V.CLEAN_REASONS)),
        "meta_review": one(some(reasons, ("meta_review",))), "evidence_gap": one(some(reasons, V.GAP_REASONS)), "n_reasons": size("reasons"),
    }


def calibrated(features: dict[str, Column], weights: dict[str, float] | None = None, intercept: float = V.CALIBRATOR_INTERCEPT) -> Column:
    """Logistic score of features in [0, 1]; weights=None leaves the calibrator out: the raw confidence."""
    if weights is None:
        return features["raw_confidence"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sigmoid(reduce(lambda a, b: a + b, [features[n] * F.lit(w) for n, w in weights.items()], F.lit(intercept)))))


def reason_group(reasons: Column) -> Column:
    return (
        F.when(some(reasons, V.HARD_REASONS), "hard").when(some(reasons, V.POLICY_REVIEW_REASONS), "policy_review")
        .when(some(reasons, V.META_APPROVE_REASONS + V.CLEAN_REASONS), "approve_path").when(some(reasons, ("meta_review",)), "meta_review")
        .when(some(reasons, V.GAP_REASONS), "evidence_gap").otherwise("other")
    )


def confidence_bucket(decision: Column, raw: Column) -> Column:
    return (
        F.when(decision == "NEEDS_REVIEW", F.when(raw < 0.35, "r_lo").when(raw < 0.55, "r_mid").when(raw < 0.75, "r_hi").otherwise("r_vhi"))
        .when(decision == "DENIED", F.when(raw < 0.6, "d_lo").when(raw < 0.8, "d_mid").otherwise("d_hi"))
        .otherwise(F.when(raw < 0.7, "a_lo").when(raw < 0.85, "a_mid").otherwise("a_hi"))
    )


def bin_key(decision: Column, raw: Column, reasons: Column) -> Column:
    return F.concat_ws("|", decision, confidence_bucket(decision, raw), reason_group(reasons))


def fit_bins(df: DataFrame, correct: str = "correct") -> DataFrame:
    """(decision, bin, p) by rollup: bins, decisions, and all in one row with nulls."""
    return df.rollup("decision", "bin").agg(F.avg(F.col(correct).cast("double")).alias("p"), F.count("*").alias("n"))


def apply_bins(df: DataFrame, bins: DataFrame) -> DataFrame:
    """p of each row's bin, else of its decision, else of all. The table has one row per bin that the code can name."""
    fine = bins.where("bin is not null").select("decision", "bin", F.col("p").alias("p_bin"))
    coarse = bins.where("bin is null and decision is not null").select("decision", F.col("p").alias("p_dec"))
    total = bins.where("decision is null").select(F.col("p").alias("p_all"))
    out = df.join(F.broadcast(fine), ["decision", "bin"], "left").join(F.broadcast(coarse), ["decision"], "left").join(F.broadcast(total), F.lit(True), "left")
    return out.withColumn("p", F.coalesce("p_bin", "p_dec", "p_all")).drop("p_bin", "p_dec", "p_all")


def expected_utilities(proba: Column, utility: dict = V.UTILITY) -> dict[str, Column]:
    """Expected utility of each action; proba is an array in the order of the labels."""
    return {a: reduce(lambda x, y: x + y, [F.lit(float(u)) * proba[k] for k, u in enumerate(row)]) for a, row in utility.items()}


def best_action(proba: Column, utility: dict = V.UTILITY) -> Column:
    """The action of highest expected utility, ties in label order."""
    scored = [F.struct((-e).alias("e"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, (a, e) in enumerate(expected_utilities(proba, utility).items())]
    return F.array_min(F.array(*scored))["a"]


def locked(finding: Column, hard: Column) -> Column:
    return F.when(finding.isin(*V.LABELS), finding).when(hard == "DENIED", F.lit("DENIED"))


def majority_action(finding: Column, hard: Column, votes: list[Column]) -> Column:
    """A lock, else what two of three votes say (the first vote if none), labels in order."""
    count = lambda a: sum((F.coalesce(v == a, F.lit(False)).cast("int") for v in votes[1:]), F.coalesce(votes[0] == a, F.lit(False)).cast("int"))
    agreed = F.coalesce(*[F.when(count(a) >= 2, F.lit(a)) for a in V.LABELS])
    return F.coalesce(locked(finding, hard), agreed, votes[0])


def clip(p: Column) -> Column:
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)), 4)


def arbitrate(df: DataFrame, mode: str | None, margin: float = 2.0, precision: float = 1.0) -> DataFrame:
    """The arbiter's verdict on rows (decision, confidence, finding, hard, proba, rule_decision, meta_label).

    mode None: no arbiter, rows as they are. replace: a lock or the action of highest utility. promote: only a review whose
    approval is worth more than margin becomes an approval. runtime, runtime_majority: no utilities. exact_confidence, if
    there is such a column, replaces the confidence where it isn't null.
    """
    if mode is None:
        return df
    c = F.col
    of = lambda label: F.element_at("proba", F.coalesce(F.array_position(F.array(*[F.lit(x) for x in V.LABELS]), label), F.lit(1)).cast("int"))
    exact = c("exact_confidence") if "exact_confidence" in df.columns else F.lit(None).cast("double")
    if mode in ("runtime", "runtime_majority"):
        chosen = majority_action(c("finding"), c("hard"), [c("decision"), c("rule_decision"), c("meta_label")]) if mode == "runtime_majority" else c("decision")
        return df.withColumns({"confidence": F.coalesce(clip(exact), c("confidence")), "decision": chosen})
    if mode == "replace":
        chosen = F.coalesce(locked(c("finding"), c("hard")), best_action(c("proba")))
        df = df.withColumn("_chosen", chosen)
        p = F.when(c("_chosen") != c("decision"), F.least(of(c("_chosen")), F.lit(precision))).otherwise(of(c("_chosen")))
        return df.withColumn("confidence", clip(F.coalesce(exact, p))).withColumn("decision", c("_chosen")).drop("_chosen")
    eu = expected_utilities(c("proba"))
    up = (c("decision") == "NEEDS_REVIEW") & ~c("finding").eqNullSafe("NEEDS_REVIEW") & (eu["APPROVED"] - eu["NEEDS_REVIEW"] > margin)
    blend = 0.5 * of(c("decision")) + 0.5 * F.coalesce("confidence", F.lit(0.0))
    return df.withColumn("confidence", F.when(up, clip(F.least(c("proba")[0], F.lit(precision)))).otherwise(clip(blend))).withColumn("decision", F.when(up, "APPROVED").otherwise(c("decision")))


def positive_evidence() -> Column:
    """Whether a row holds what an approval needs: nothing missing, a known fee, some source, no denial."""
    known = F.array(*[F.lit(s) for s in ("intake", "fee", "registry", "biometric", "adjudicator")])
    return (
        (F.size("missing") == 0) & F.col("fee_status").isin("paid", "waived", "unpaid") & F.arrays_overlap("sources_seen", known)
        & ~some(F.col("risk_flags"), V.DISQUALIFYING) & ~F.coalesce(F.col("hard") == "DENIED", F.lit(False))
    )


def path_key() -> Column:
    """The decision's path in eleven parts, without anything that names the packet."""
    c = F.col
    label = lambda x: F.when(x.isin(*V.LABELS), x).otherwise("none")
    flags = F.when(some(c("risk_flags"), V.DISQUALIFYING), "dq").when(some(c("risk_flags"), V.REVIEW_ONLY), "rev").otherwise("clean")
    fee = F.when(c("fee_status").isin(*V.FEES), c("fee_status")).otherwise("other")
    return F.concat_ws(
        "|", label(c("rule_decision")), F.when(c("hard") == "DENIED", "hard").otherwise("nohard"), F.concat(F.lit("find_"), label(c("finding"))),
        F.concat(F.lit("meta_"), label(c("meta_label"))), F.when(F.coalesce("dq_prob", F.lit(0.0)) >= 0.5, "dqhi").otherwise("dqlo"),
        F.when(F.size("missing") > 0, "miss").otherwise("full"), F.when(F.size("conflicts") > 0, "conf").otherwise("noconf"),
        F.when(F.size("untrusted_conflicts") > 0, "ut").otherwise("nout"), flags, F.concat(F.lit("fee_"), fee), F.when(positive_evidence(), "pos").otherwise("weak"),
    )


def path_table(df: DataFrame, label: str, m: float = 8.0, key: str = "path") -> DataFrame:
    """Per path (and, with a null path, over all): rows by label and their smoothed shares (n_label + m/3) / (n + m)."""
    counts = [F.sum((F.col(label) == x).cast("long")).alias(f"n_{x}") for x in V.LABELS]
    table = df.where(F.col(label).isin(*V.LABELS)).rollup(key).agg(F.count("*").alias("n"), *counts)
    return table.select(key, "n", *[f"n_{x}" for x in V.LABELS], *[((F.col(f"n_{x}") + m / 3) / (F.col("n") + m)).alias(f"p_{x}") for x in V.LABELS])


def decide_by_path(df: DataFrame, table: DataFrame, key: str = "path") -> DataFrame:
    """A lock, or the action of highest utility under the path's shares (those over all for unseen paths); approvals need positive evidence."""
    p = [f"p_{x}" for x in V.LABELS]
    of_path = table.where(F.col(key).isNotNull()).select(key, *p)
    total = table.where(F.col(key).isNull()).select(*[F.col(x).alias(f"all_{x}") for x in p])
    joined = df.join(of_path, key, "left").join(F.broadcast(total), F.lit(True), "left")
    joined = joined.withColumn("proba", F.array(*[F.coalesce(x, f"all_{x}") for x in p])).drop(*p, *[f"all_{x}" for x in p])
    chosen = best_action(F.col("proba"))
    gated = F.when((chosen == "APPROVED") & ~positive_evidence(), "NEEDS_REVIEW").otherwise(chosen)
    return joined.withColumn("decision", F.coalesce(locked(F.col("finding"), F.col("hard")), gated))
