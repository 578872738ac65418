"""Feature rows of the learned stages: names and Columns, so that a row is one projection.

Columns read: the eight fields (null: not found), risk_flags, conflicts, untrusted_conflicts, sources_seen,
observed_flags_seen, positive_waiver_seen, injection_heavy, trusted_text_chars, finding, rule_decision and
field_sources (a map from field to the stream that gave it). Null counts as absent; every feature is a double, never null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .confidence import best_action, expected_utilities, locked, logit

# The fields in the order of the rows, and the streams that count as standard ones.
FIELDS = ("applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "fee_status")
STANDARD_STREAMS = ("native", "page_ocr", "embedded_ocr", "ppocr_ocr", "oriented_ocr")
# Source roles, and marks that a packet's sources may hold.
ROLES = ("intake", "fee", "registry", "biometric", "adjudicator")
MARKS = (
    "_observed_none_any", "_complete_no_b13_layout", "_review_flag_asserted", "_printed_fee_unknown_votes", "_adjudicator_finding",
    "_damage_implies_illegible", "_missing_biometric_roles_layout", "_manual_identity_conflict", "_redacted_identity_damage",
    "_occluded_biohazard_visual", "biometric_flags", "risk_flags_embargo_home",
)
# Reasons that the arbiter's row may show.
REASONS = (
    "insufficient_evidence", "missing_fields", "review_flags", "conflicts", "unknown_fee", "waived_non_dip", "missing_sponsor",
    "suspicious_sponsor", "clean_packet", "injection_only", "unreadable_arrival", "fee_absent_imputed", "explicit_clean_risk_and_fee",
    "meta_approve_complete", "meta_approve_with_flags", "meta_review", "meta_deny", "meta_has_dq", "adjudicator_finding_approved",
    "adjudicator_note_review", "adjudicator_note_denied", "xw2_medical_no_biometric", "disqualifying_flags", "transit_visa",
    "stale_arrival", "unpaid_fee", "revoked_sponsor", "rescinded_transit", "unresolved_transit_evidence",
    "unresolved_stale_evidence", "review_monotonic_meta_deny",
)
_SHORT = {"APPROVED": "approved", "DENIED": "denied", "NEEDS_REVIEW": "review"}
Row = dict[str, Column]


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def number(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def size(values: str) -> Column:
    return number(F.size(F.coalesce(F.col(values), F.array().cast("array<string>"))))


def is_one_of(prefix: str, value: Column, values: Iterable[str], name: Callable[[str], str] = str) -> Row:
    return {f"{prefix}_{name(v)}": yes(value == v) for v in values}


def holds(prefix: str, values: str, which: Iterable[str]) -> Row:
    return {f"{prefix}_{v}": yes(F.array_contains(values, v)) for v in which}


def _source(field: str) -> Column:
    return F.coalesce(F.col("field_sources")[field], F.lit(""))


def _verdicts(prefix: str, label: Column) -> Row:
    return {f"{prefix}_{short}": yes(label == v) for v, short in _SHORT.items()}


def _any_of(values: str, which: tuple[str, ...]) -> Column:
    return yes(F.arrays_overlap(values, F.array(*map(F.lit, which))))


def evidence_row() -> Row:
    """The 91 features of the evidence models. Reads also pages, pdf_bytes, explicit_risk_flags and repaired_fields."""
    c, fee, sponsor = F.col, F.coalesce("fee_status", F.lit("unknown")), F.coalesce("sponsor_id", F.lit("SPN-0000"))
    sources = {f: _source(f) for f in FIELDS}
    special = {f: (s != "") & ~s.isin(*STANDARD_STREAMS) for f, s in sources.items()}
    total = lambda flags: sum((yes(x) for x in flags), F.lit(0.0))
    row = {
        "pages": number(c("pages")), "pdf_bytes": number(c("pdf_bytes")), "trusted_chars": number(c("trusted_text_chars")),
        "injection_heavy": yes(c("injection_heavy")), "observed_flags_seen": yes(c("observed_flags_seen")), "n_flags": size("risk_flags"),
        "has_dq": _any_of("risk_flags", V.DISQUALIFYING), "has_review_flag": _any_of("risk_flags", V.REVIEW_ONLY),
        # learned sponsors act through the rules only: the models know the public ones
        "revoked_sponsor": yes(sponsor.isin(*V.PUBLIC_REVOKED)), "suspicious_sponsor": yes(sponsor.isin(*V.PUBLIC_REVOKED)),
    }
    row |= is_one_of("fee", fee, V.FEES) | holds("src", "sources_seen", ROLES) | {"n_conflicts": size("conflicts")}
    row |= _verdicts("finding", c("finding")) | _verdicts("rule", c("rule_decision"))
    short = {"applicant_name": "name", "species_code": "species", "home_world": "world", "visa_class": "visa", "sponsor_id": "sponsor", "arrival_date": "date", "declared_purpose": "purpose", "fee_status": "fee"}
    row |= {f"missing_{short[f]}": yes(c(f).isNull()) for f in FIELDS} | {"n_missing": total(c(f).isNull() for f in FIELDS)}
    row |= is_one_of("visa", c("visa_class"), V.VISAS) | holds("flag", "risk_flags", V.FLAGS)
    row |= {
        "n_field_sources": total(s != "" for s in sources.values()), "n_fields_from_native": total(s == "native" for s in sources.values()),
        "n_fields_from_standard_ocr": total(s.isin(*STANDARD_STREAMS) & (s != "native") for s in sources.values()),
        "n_fields_from_specialized_ocr": total(special.values()), "n_untrusted_conflicts": size("untrusted_conflicts"),
        "n_explicit_risk_flags": size("explicit_risk_flags"), "n_r35_repairs": size("repaired_fields"), "positive_waiver_seen": yes(c("positive_waiver_seen")),
    }
    row |= {f"trusted_chars_ge_{n}": yes(c("trusted_text_chars") >= n) for n in (120, 400, 1000)}
    for f, s in sources.items():
        row |= {f"field_ocr_{f}": yes((s != "") & (s != "native")), f"field_specialized_{f}": yes(special[f]), f"untrusted_conflict_{f}": yes(F.array_contains("untrusted_conflicts", f)), f"r35_repair_{f}": yes(F.array_contains("repaired_fields", f))}
    return row


def days_before_receipt(date: Column, receipt: str = V.RECEIPT_DATE) -> Column:
    """Days from an ISO date to the receipt date; -1 if it isn't one."""
    day = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(F.datediff(F.lit(receipt).cast("date"), day).cast("double"), F.lit(-1.0))


def arbiter_row(replace: bool = False) -> Row:
    """The arbiter's 151 features; replace leaves out the engine's own verdicts and reasons (112).

    Reads also missing, meta_label, meta_conf, dq_prob, decision (the final one), hard, raw_confidence and reasons; absent
    fields hold their defaults.
    """
    c = F.col
    field = lambda f: F.coalesce(c(f), F.lit(V.DEFAULTS[f]))
    chars, sponsor = number(c("trusted_text_chars")), field("sponsor_id")
    row = {
        "n_missing": size("missing"), "n_conflicts": size("conflicts"), "n_untrusted_conflicts": size("untrusted_conflicts"), "n_flags": size("risk_flags"),
        "has_dq_flag": _any_of("risk_flags", V.DISQUALIFYING), "has_review_flag": _any_of("risk_flags", V.REVIEW_ONLY), "observed_flags_seen": yes(c("observed_flags_seen")),
        "positive_waiver_seen": yes(c("positive_waiver_seen")), "injection_heavy": yes(c("injection_heavy")), "trusted_chars": chars, "meta_conf": number(c("meta_conf")), "dq_prob": number(c("dq_prob")),
    }
    row |= _verdicts("meta", c("meta_label"))
    verdicts = _verdicts("rule", c("rule_decision")) | _verdicts("final", c("decision")) | {"hard_denied": yes(c("hard") == "DENIED"), "raw_confidence": number(c("raw_confidence"))}
    row |= {} if replace else verdicts
    row |= _verdicts("finding", c("finding")) | {
        "days_before_receipt": days_before_receipt(field("arrival_date")), "sponsor_wellformed": yes(sponsor.startswith("SPN-") & (sponsor != "SPN-0000") & (F.length(sponsor) == 8)),
        "species_known": yes(field("species_code").isin(*V.SPECIES)), "world_known": yes(field("home_world").isin(*V.WORLDS)),
        "purpose_known": yes(field("declared_purpose").isin(*V.PURPOSES)), "visa_known": yes(field("visa_class").isin(*V.VISAS)),
    }
    row |= holds("src", "sources_seen", ROLES) | is_one_of("visa", field("visa_class"), V.VISAS) | is_one_of("fee", field("fee_status"), V.FEES)
    row |= is_one_of("purpose", field("declared_purpose"), V.PURPOSES, lambda v: v.replace(" ", "_")) | holds("flag", "risk_flags", V.FLAGS)
    for f in FIELDS:
        s = _source(f)
        row |= {f"has_{f}": yes(s != ""), f"native_{f}": yes(s.startswith("native")), f"stdocr_{f}": yes(s.isin(*STANDARD_STREAMS[1:])), f"special_{f}": yes((s != "") & ~s.isin(*STANDARD_STREAMS)), f"untrusted_{f}": yes(F.array_contains("untrusted_conflicts", f))}
    row |= {f"mark_{m}": yes(_source(m) != "") for m in MARKS} | {"risk_source_present": yes(_source("risk_flags") != "")}
    row |= {} if replace else holds("why", "reasons", REASONS)
    return row | {"trusted_chars_lt_120": yes(chars < 120), "trusted_chars_lt_400": yes(chars < 400), "trusted_chars_ge_1000": yes(chars >= 1000)}


def correctness_row(action: Column) -> Row:
    """The 28 features of the model that tells whether an action is right. Reads also proba and confidence (the engine's)."""
    evidence, p = arbiter_row(), F.col("proba")
    chosen = F.element_at(p, F.array_position(F.array(*map(F.lit, V.LABELS)), action).cast("int"))
    row = {"p_approved": p[0], "p_denied": p[1], "p_review": p[2], "chosen_p": chosen, "chosen_logit": logit(chosen), "runtime_confidence": number(F.col("confidence")), "changed": yes(action != F.col("decision")), "hard_denied": evidence["hard_denied"], "finding_present": yes(F.col("finding").isin(*V.LABELS))}
    row |= {n: evidence[n] for n in ("n_missing", "n_conflicts", "n_untrusted_conflicts", "n_flags", "observed_flags_seen", "has_dq_flag", "has_review_flag", "src_intake", "src_fee", "src_biometric", "risk_source_present", "trusted_chars_lt_120", "trusted_chars_lt_400")}
    return row | is_one_of("action", action, V.LABELS) | is_one_of("current", F.col("decision"), V.LABELS)


def arbiter_action() -> Column:
    """What the arbiter would do by itself: a lock, else the action of highest expected utility."""
    return F.coalesce(locked(F.col("finding"), F.col("hard")), best_action(F.col("proba")))


def gate_row(base: Column) -> Row:
    """The features by which the gate chooses between the arbiter's action and the engine's decision where they differ."""
    evidence, p, now = arbiter_row(), F.col("proba"), F.col("decision")
    worth = expected_utilities(p)
    ordered = F.array_sort(F.array(*worth.values()))
    at = lambda label: F.element_at(p, F.array_position(F.array(*map(F.lit, V.LABELS)), label).cast("int"))
    row = {f"p_{s}": p[i] for i, s in enumerate(_SHORT.values())} | {f"worth_{_SHORT[a]}": w for a, w in worth.items()}
    row |= {"worth_gap": ordered[2] - ordered[1], "p_gap": at(base) - at(now)}
    row |= {n: evidence[n] for n in ("n_missing", "n_conflicts", "n_untrusted_conflicts", "n_flags", "meta_conf", "dq_prob", "observed_flags_seen", "risk_source_present")}
    return row | is_one_of("base", base, V.LABELS) | is_one_of("engine", now, V.LABELS)
