"""The policy decision list, its guards and its raw confidence, as column expressions over evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import missing_by_policy, valid_date

DEFAULT = V.Policy()


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def some(flags: Column, values) -> Column:
    """Whether an array holds any of the values; false for null."""
    return F.coalesce(F.arrays_overlap(flags, _array(values)), F.lit(False))


def with_defaults(df: DataFrame, policy: V.Policy = DEFAULT) -> DataFrame:
    """Fields that weren't found hold their defaults; lists are never null."""
    lists = ["risk_flags", "conflicts", "untrusted_conflicts", "sources_seen"]
    fill = {f: F.coalesce(f, F.lit(d)) for f, d in policy.defaults.items()}
    fill |= {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists}
    return df.withColumns(fill)


def missing_critical() -> Column:
    """Names of the fields that hold their default, in fixed order."""
    return F.array_compact(F.array(*[F.when(missing_by_policy(f, F.col(f)), F.lit(f)) for f in V.DEFAULTS]))


def is_stale(policy: V.Policy = DEFAULT) -> Column:
    """The arrival lies more than stale_days before the receipt; never for DIP-1, a default or an impossible date."""
    date = F.col("arrival_date")
    age = F.datediff(F.lit(policy.receipt_date).cast("date"), F.try_to_date(date, "yyyy-MM-dd"))
    return (F.col("visa_class") != "DIP-1") & (date != V.DEFAULTS["arrival_date"]) & valid_date(date) & F.coalesce(age > policy.stale_days, F.lit(False))


def decide(df: DataFrame, policy: V.Policy = DEFAULT) -> DataFrame:
    """Adds missing, stale, hard, rule_decision and reasons to evidence rows (defaults filled in).

    The first that holds decides: a signed finding; a disqualifying flag; a transit visa; a stale arrival; an unpaid fee;
    a revoked sponsor. Transit and stale denials wait while their evidence is unresolved. Otherwise review reasons are
    collected in order, and without any a complete clean packet is approved.
    """
    df = with_defaults(df, policy)
    df = df.withColumns({"missing": missing_critical(), "stale": is_stale(policy)})
    c, native = F.col, lambda name: F.coalesce(F.col(name).startswith("native"), F.lit(False))
    n_missing = F.size("missing")
    review = F.array_intersect("risk_flags", _array(policy.review_only))
    dq = some(c("risk_flags"), policy.disqualifying)
    signed = c("finding").isin(*V.LABELS)
    stale_open = c("stale") & (n_missing > 0) & ~native("visa_source") & ~native("arrival_source")
    rescinded = (F.size(review) == 1) & F.array_contains(review, "rescinded_denial")
    transit_open = (c("visa_class") == "TRANSIT-7") & (n_missing >= 2) & (F.size("untrusted_conflicts") >= 2) & ~native("visa_source")
    transit = (c("visa_class") == "TRANSIT-7") & ~(rescinded | transit_open)
    revoked = c("sponsor_id").isin(*policy.revoked) & ~c("visa_class").isin("DIP-1", "unknown")
    df = df.withColumns({"_dq": dq, "_transit": transit, "_stale_open": stale_open, "_rescinded": rescinded, "_transit_open": transit_open, "_review": F.size(review) > 0})
    free = ~c("_dq") & ~c("_transit")
    df = df.withColumns({
        "_stale_denied": free & c("stale") & ~c("_stale_open"),
        "_unpaid": free & ~c("stale") & (c("fee_status") == "unpaid"),
        "_revoked": free & ~c("stale") & (c("fee_status") != "unpaid") & revoked,
        "_signed": F.coalesce(signed, F.lit(False)),
    })
    hard = c("_dq") | c("_transit") | c("_stale_denied") | c("_unpaid") | c("_revoked")
    waived = c("fee_status") == "waived"
    authorised = waived & F.coalesce(c("positive_waiver_seen"), F.lit(False))
    not_dip = c("visa_class") != "DIP-1"
    suspicious = c("sponsor_id").isin(*policy.suspicious)
    path = [  # reasons that may stand beside a hard denial
        (c("_dq"), "disqualifying_flags"), (c("_transit") & ~c("_dq"), "transit_visa"),
        (~c("_dq") & ~c("_transit") & c("_rescinded"), "rescinded_transit"),
        (~c("_dq") & ~c("_transit") & ~c("_rescinded") & c("_transit_open"), "unresolved_transit_evidence"),
        (c("_stale_denied"), "stale_arrival"), (free & c("_stale_open"), "unresolved_stale_evidence"),
        (c("_unpaid"), "unpaid_fee"), (c("_revoked"), "revoked_sponsor"),
    ]
    soft = [
        (F.coalesce(c("injection_heavy"), F.lit(False)) & (F.coalesce(c("trusted_text_chars"), F.lit(0)) < 120), "injection_only"),
        (n_missing > 0, "missing_fields"), (c("_review"), "review_flags"), (c("fee_status") == "unknown", "unknown_fee"),
        (F.size("conflicts") > 0, "conflicts"), (F.array_contains("conflicts", "arrival_date_unreadable"), "unreadable_arrival"),
        (waived & not_dip & ~authorised, "waived_non_dip"), (not_dip & (c("sponsor_id") == V.DEFAULTS["sponsor_id"]), "missing_sponsor"),
        (suspicious, "suspicious_sponsor"),
    ]
    listed = lambda pairs: F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in pairs]))
    fee_ok = (c("fee_status") == "paid") | (waived & ~not_dip) | authorised
    clean = (
        (n_missing == 0) & (F.size("risk_flags") == 0) & (F.size("conflicts") == 0) & (F.size("untrusted_conflicts") == 0) & fee_ok
        & F.array_contains("sources_seen", "intake") & F.array_contains("sources_seen", "fee") & F.coalesce(c("observed_flags_seen"), F.lit(False)) & ~suspicious
    )
    df = df.withColumns({"_hard": hard & ~c("_signed"), "_path": listed(path), "_soft": listed(soft), "_clean": clean})
    note = F.when(c("finding") == "DENIED", "adjudicator_note_denied").when(c("finding") == "NEEDS_REVIEW", "adjudicator_note_review").otherwise("adjudicator_finding_approved")
    last = F.when(F.size("_soft") > 0, c("_soft")).when(c("_clean"), _array(["clean_packet"])).otherwise(_array(["insufficient_evidence"]))
    df = df.withColumns({
        "hard": F.when(c("_hard") | (c("finding") == "DENIED"), F.lit("DENIED")),
        "rule_decision": F.when(c("_signed"), c("finding")).when(c("_hard"), "DENIED").when((F.size("_soft") == 0) & c("_clean"), "APPROVED").otherwise("NEEDS_REVIEW"),
        "reasons": F.when(c("_signed"), F.array(note)).when(c("_hard"), c("_path")).otherwise(F.concat("_path", last)),
    })
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def raw_confidence(decision: str = "rule_decision") -> Column:
    """The confidence that a decision's reasons carry before calibration."""
    d, r = F.col(decision), F.col("reasons")
    has = lambda *names: some(r, names)
    full = F.size("missing") == 0
    policy = has("review_flags", "adjudicator_note_review", "unreadable_arrival")
    review = (
        F.when(has("xw2_medical_no_biometric") & full, 0.72).when(policy & (F.size("missing") <= 1), 0.85).when(policy, 0.7)
        .when(has("suspicious_sponsor") & full, 0.55).otherwise(0.28)
    )
    denied = (
        F.when(has("disqualifying_flags", "transit_visa"), F.when(full, 0.9).otherwise(0.55))
        .when(has("stale_arrival", "unpaid_fee"), F.when(full, 0.88).otherwise(0.55))
        .when(has("revoked_sponsor", "meta_deny"), F.when(full, 0.8).otherwise(0.5))
        .when(has("adjudicator_note_denied"), 0.88).otherwise(0.55)
    )
    approved = (
        F.when(has("adjudicator_finding_approved"), 0.88).when(F.coalesce(F.col("observed_flags_seen"), F.lit(False)) & full, 0.84)
        .when(full & F.array_contains("sources_seen", "intake"), 0.76).otherwise(0.45)
    )
    return F.when(has("injection_only"), 0.15).when(d == "NEEDS_REVIEW", review).when(d == "DENIED", denied).otherwise(approved)


def adjudicate(df: DataFrame, policy: V.Policy = DEFAULT, thresholds: dict | None = None) -> DataFrame:
    """The whole decision: rules, model stages, guards. Adds decision, raw_confidence and the final reasons.

    Models come as columns: dq_prob, meta_label, meta_conf, and counterfactual_denial (the models' verdict without the
    review-only flags). Where a column is absent or null, that model says nothing. fee_imputed and observed_none mark an
    imputed fee and an explicit "none" for flags.
    """
    t = V.THRESHOLDS | (thresholds or {})
    absent = {"dq_prob": F.lit(None).cast("double"), "meta_label": F.lit(None).cast("string"), "meta_conf": F.lit(None).cast("double"), "counterfactual_denial": F.lit(None).cast("double"), "fee_imputed": F.lit(False), "observed_none": F.lit(False), "biometric_seen": F.lit(False)}
    df = decide(df, policy)
    df = df.withColumns({k: v for k, v in absent.items() if k not in df.columns})
    c = F.col
    add = lambda when, name: F.when(when, F.concat("reasons", _array([name]))).otherwise(c("reasons"))
    df = df.withColumns({"decision": c("rule_decision"), "raw_confidence": raw_confidence()})
    open_ = ~F.coalesce(c("finding").isin("APPROVED", "NEEDS_REVIEW"), F.lit(False)) & c("hard").isNull()
    seen = F.coalesce(c("observed_flags_seen"), F.lit(False))
    dq = F.when(~seen & (F.size("risk_flags") == 0), F.coalesce("dq_prob", F.lit(0.0))).otherwise(0.0)
    df = df.withColumns({"_open": open_, "_dq": dq}).withColumn("_dq_denied", c("_open") & (c("_dq") >= t["dq_deny"]))
    complete = (F.size("missing") == 0) & (F.size("risk_flags") == 0) & (F.size("conflicts") == 0) & (F.size("untrusted_conflicts") == 0)
    meta = c("_open") & ~c("_dq_denied") & c("meta_label").isNotNull()
    up = meta & (c("meta_label") == "APPROVED")
    with_flags = up & seen & complete & (c("meta_conf") >= t["observed_approve"])
    without = up & ~with_flags & ~seen & complete & (c("meta_conf") >= t["approve"]) & F.array_contains("sources_seen", "fee") & (c("_dq") < t["dq_ceiling"])
    agreed = up & ~with_flags & ~without & (c("rule_decision") == "APPROVED")
    down = meta & (c("meta_label") == "DENIED") & (c("meta_conf") >= t["deny"])
    doubt = meta & (c("meta_label") == "NEEDS_REVIEW") & ((c("rule_decision") != "APPROVED") | (c("meta_conf") >= t["review"]))
    df = df.withColumns({"_with": with_flags, "_without": without, "_agreed": agreed, "_down": down, "_doubt": doubt})
    names = [("_dq_denied", "meta_has_dq"), ("_with", "meta_approve_with_flags"), ("_without", "meta_approve_complete"), ("_down", "meta_deny"), ("_doubt", "meta_review")]
    off = F.lit(False)
    df = df.withColumns({k: F.coalesce(c(k), off) for k in ("_with", "_without", "_agreed", "_down", "_doubt", "_dq_denied")})
    df = df.withColumns({
        "decision": F.when(c("_dq_denied") | c("_down"), "DENIED").when(c("_with") | c("_without") | c("_agreed"), "APPROVED").when(c("_doubt"), "NEEDS_REVIEW").otherwise(c("decision")),
        "raw_confidence": F.when(c("_dq_denied"), F.greatest(F.lit(0.65), c("_dq"))).when(c("_with"), F.greatest(c("meta_conf"), F.lit(0.75))).when(c("_without") | c("_down"), c("meta_conf"))
        .when(c("_agreed"), F.greatest("raw_confidence", "meta_conf")).when(c("_doubt"), F.greatest(F.lit(0.4), F.least(F.lit(0.88), c("meta_conf")))).otherwise(c("raw_confidence")),
        "reasons": F.concat("reasons", F.array_compact(F.array(*[F.when(c(k), F.lit(n)) for k, n in names]))),
        "risk_flags": F.when(c("_dq_denied"), _array(["biohazard_red"])).otherwise(c("risk_flags")),
    })
    df = df.withColumn("_guarded", c("_open") & ~c("_dq_denied"))
    # guards, in this order; each sees what the ones before it left
    biometric = F.coalesce(c("biometric_seen"), off) | F.array_contains("sources_seen", "biometric") | seen
    guards = [
        ((c("decision") == "APPROVED") & c("finding").isNull() & (c("visa_class") == "XW-2") & (c("declared_purpose") == "medical consult") & ~biometric, "xw2_medical_no_biometric"),
        ((c("decision") == "APPROVED") & (c("fee_status") == "waived") & (c("visa_class") != "DIP-1") & ~F.coalesce(c("positive_waiver_seen"), off), "waived_non_dip"),
        ((c("decision") == "APPROVED") & F.coalesce(c("fee_imputed"), off), "fee_absent_imputed"),
    ]
    for when, name in guards:
        df = df.withColumn("_hit", c("_guarded") & F.coalesce(when, off))
        df = df.withColumn("reasons", add(c("_hit") & ~F.array_contains("reasons", name), name)).withColumn("decision", F.when(c("_hit"), "NEEDS_REVIEW").otherwise(c("decision")))
        df = df.withColumn("raw_confidence", F.when(c("_hit"), raw_confidence("decision")).otherwise(c("raw_confidence")))
    fee_ok = (c("fee_status") == "paid") | ((c("fee_status") == "waived") & (c("visa_class") == "DIP-1"))
    lift = (c("decision") == "NEEDS_REVIEW") & F.coalesce(c("observed_none"), off) & (F.size("risk_flags") == 0) & fee_ok & ~F.coalesce(c("fee_imputed"), off) & ((F.size("untrusted_conflicts") == 0) | (c("visa_class") == "DIP-1"))
    df = df.withColumn("_hit", c("_guarded") & lift)
    df = df.withColumns({"reasons": add(c("_hit"), "explicit_clean_risk_and_fee"), "decision": F.when(c("_hit"), "APPROVED").otherwise(c("decision")), "raw_confidence": F.when(c("_hit"), 0.72).otherwise(c("raw_confidence"))})
    fall = (c("decision") == "NEEDS_REVIEW") & c("finding").isNull() & (c("counterfactual_denial") >= t["deny"])
    df = df.withColumn("_hit", c("_guarded") & F.coalesce(fall, off))
    df = df.withColumns({"reasons": add(c("_hit"), "review_monotonic_meta_deny"), "decision": F.when(c("_hit"), "DENIED").otherwise(c("decision")), "raw_confidence": F.when(c("_hit"), c("counterfactual_denial")).otherwise(c("raw_confidence"))})
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def reconcile_late_flags(df: DataFrame, policy: V.Policy = DEFAULT) -> DataFrame:
    """Decisions after flags that came late: a packet that isn't denied and now has a disqualifying flag goes through the rules again, without models."""
    again = decide(df.withColumn("before_late", F.col("decision")), policy)
    late = (F.col("before_late") != "DENIED") & some(F.col("risk_flags"), policy.disqualifying)
    return again.withColumn("decision", F.when(late, F.col("rule_decision")).otherwise(F.col("before_late"))).drop("before_late")


def fee_ledger(status: Column, cents: Column, code: Column, visa: Column) -> Column:
    """What a receipt's status, amount and waiver code say together; null if they say nothing."""
    zero = cents == 0
    return (
        F.when((code == "DIP-WAIVER") & zero, "waived").when((code == "N/A") & (cents == V.STANDARD_FEE_CENTS), "paid")
        .when((code == "N/A") & zero & (status == "unknown"), "unknown").when((code == "N/A") & zero & (status == "waived") & (visa != "DIP-1"), "unknown")
    )


def absent_fee(status: Column, any_fee_text: Column) -> Column:
    """A fee that no stream mentions counts as paid."""
    return F.when((F.coalesce(status, F.lit("unknown")) == "unknown") & ~any_fee_text, "paid").otherwise(status)


def fallback_prediction() -> dict[str, Column]:
    """The row of a packet that couldn't be read."""
    fields = {f: F.lit(d) for f, d in V.DEFAULTS.items()} | {"arrival_date": F.lit("1970-01-01"), "applicant_name": F.lit("UNREADABLE")}
    return fields | {"risk_flags": F.lit("none"), "adjudication": F.lit("NEEDS_REVIEW"), "confidence": F.lit(0.01)}
