"""Queries of feature rows, the disagreement gate and small ranking operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import channel, features, learning, metrics, ranking, rules
from . import derived as D
from .queries import _EU, _SQL_ARRAY, query

_STREAMS = ("", "native", "page_ocr", "ppocr_ocr", "threshold_ocr", "native_note")
_KEYS = (*features.FIELDS, *features.MARKS, "risk_flags")


def _evidence(spark, sf_dir) -> DataFrame:
    """Decided packets with the columns that only feature rows read."""
    k = F.col("k")
    # arrays, not create_map: the optimizer would write all its entries into each of the features that read one
    source = F.map_from_arrays(F.array(*map(F.lit, _KEYS)), F.array(*[D.pick(_STREAMS, k + i) for i in range(len(_KEYS))]))
    repaired = F.array_compact(F.array(*[F.when((k + i) % 13 == 0, f) for i, f in enumerate(features.FIELDS)]))
    found = {f"raw_{f}": F.col(f) for f in features.FIELDS}  # as they were before the rules' defaults
    more = {"field_sources": source, "repaired_fields": repaired, "explicit_risk_flags": F.when(k % 2 == 0, F.col("risk_flags")), "pages": k % 7 + 1, "pdf_bytes": k * 13 % 9973}
    df = rules.decide(D.packets(spark, sf_dir).withColumns(found | more))
    return df.withColumns({"raw_confidence": rules.raw_confidence(), "decision": F.when(k % 3 == 0, F.col("truth")).otherwise(F.col("rule_decision")), "confidence": F.col("meta_conf")})


def _undefaulted(df: DataFrame) -> DataFrame:
    """Fields as they were found, null if they weren't."""
    return df.withColumns({f: F.col(f"raw_{f}") for f in features.FIELDS})


_S = {f: f"([{', '.join(repr(s) for s in _STREAMS)}])[CAST((k + {i}) % {len(_STREAMS)} + 1 AS INT)]" for i, f in enumerate(_KEYS)}
_D = lambda cond: f"CAST(coalesce({cond}, false) AS INT)::DOUBLE"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_HIT = lambda col, values: _D(f"len(list_intersect({col}, {_SQL_ARRAY(values)})) > 0")
_HELD = lambda prefix, col, values: {f"{prefix}_{v}": _D(f"list_contains({col}, '{v}')") for v in values}
_ONE = lambda prefix, col, values: {f"{prefix}_{v.replace(' ', '_')}": _D(f"{col} = '{v}'") for v in values}
_SAID = lambda prefix, col: {f"{prefix}_{s}": _D(f"{col} = '{v}'") for v, s in (("APPROVED", "approved"), ("DENIED", "denied"), ("NEEDS_REVIEW", "review"))}
_STD = _IN(features.STANDARD_STREAMS)
_SUM = lambda conds: " + ".join(_D(x) for x in conds)
_F = features.FIELDS
_NAMES = dict(zip(_F, ("name", "species", "world", "visa", "sponsor", "date", "purpose", "fee")))
_WITH = f"""WITH {D.DECIDED}, ev AS (SELECT s.*, {', '.join(f'p.{f} AS raw_{f}' for f in _F)}, CASE WHEN s.k % 3 = 0 THEN s.truth ELSE s.rule_decision END AS decision,
  list_filter([{', '.join(f"CASE WHEN (s.k + {i}) % 13 = 0 THEN '{f}' END" for i, f in enumerate(_F))}], lambda x: x IS NOT NULL) AS repaired FROM scored s JOIN packets p USING (k))"""

_EVIDENCE = {
    "pages": "(k % 7 + 1)::DOUBLE", "pdf_bytes": "(k * 13 % 9973)::DOUBLE", "trusted_chars": "trusted_text_chars::DOUBLE", "injection_heavy": _D("injection_heavy"), "observed_flags_seen": _D("observed_flags_seen"),
    "n_flags": "len(risk_flags)::DOUBLE", "has_dq": _HIT("risk_flags", V.DISQUALIFYING), "has_review_flag": _HIT("risk_flags", V.REVIEW_ONLY),
    "revoked_sponsor": _D(f"raw_sponsor_id IN {_IN(V.PUBLIC_REVOKED)}"), "suspicious_sponsor": _D(f"raw_sponsor_id IN {_IN(V.PUBLIC_REVOKED)}"), "n_conflicts": "len(conflicts)::DOUBLE",
    **_ONE("fee", "coalesce(raw_fee_status, 'unknown')", V.FEES), **_HELD("src", "sources_seen", features.ROLES), **_SAID("finding", "finding"), **_SAID("rule", "rule_decision"),
    **{f"missing_{_NAMES[f]}": _D(f"raw_{f} IS NULL") for f in _F}, "n_missing": _SUM(f"raw_{f} IS NULL" for f in _F), **_ONE("visa", "raw_visa_class", V.VISAS), **_HELD("flag", "risk_flags", V.FLAGS),
    "n_field_sources": _SUM(f"{_S[f]} <> ''" for f in _F), "n_fields_from_native": _SUM(f"{_S[f]} = 'native'" for f in _F), "n_fields_from_standard_ocr": _SUM(f"{_S[f]} IN {_STD} AND {_S[f]} <> 'native'" for f in _F),
    "n_fields_from_specialized_ocr": _SUM(f"{_S[f]} NOT IN {_STD} AND {_S[f]} <> ''" for f in _F), "n_untrusted_conflicts": "len(untrusted_conflicts)::DOUBLE", "n_explicit_risk_flags": "CASE WHEN k % 2 = 0 THEN len(risk_flags) ELSE 0 END::DOUBLE",
    "n_r35_repairs": "len(repaired)::DOUBLE", "positive_waiver_seen": _D("positive_waiver_seen"), **{f"trusted_chars_ge_{n}": _D(f"trusted_text_chars >= {n}") for n in (120, 400, 1000)},
    **{f"field_ocr_{f}": _D(f"{_S[f]} NOT IN ('', 'native')") for f in _F}, **{f"field_specialized_{f}": _D(f"{_S[f]} <> '' AND {_S[f]} NOT IN {_STD}") for f in _F},
    **{f"untrusted_conflict_{f}": _D(f"list_contains(untrusted_conflicts, '{f}')") for f in _F}, **{f"r35_repair_{f}": _D(f"list_contains(repaired, '{f}')") for f in _F},
}
_VERDICTS = {**_SAID("rule", "rule_decision"), **_SAID("final", "decision"), "hard_denied": _D("hard = 'DENIED'"), "raw_confidence": "raw_confidence::DOUBLE", **_HELD("why", "reasons", features.REASONS)}
_ARBITER = {
    "n_missing": "len(missing)::DOUBLE", "n_conflicts": "len(conflicts)::DOUBLE", "n_untrusted_conflicts": "len(untrusted_conflicts)::DOUBLE", "n_flags": "len(risk_flags)::DOUBLE",
    "has_dq_flag": _HIT("risk_flags", V.DISQUALIFYING), "has_review_flag": _HIT("risk_flags", V.REVIEW_ONLY), "observed_flags_seen": _D("observed_flags_seen"), "positive_waiver_seen": _D("positive_waiver_seen"),
    "injection_heavy": _D("injection_heavy"), "trusted_chars": "trusted_text_chars::DOUBLE", "meta_conf": "coalesce(meta_conf, 0)::DOUBLE", "dq_prob": "coalesce(dq_prob, 0)::DOUBLE", **_SAID("meta", "meta_label"), **_SAID("finding", "finding"),
    "days_before_receipt": f"coalesce(date_diff('day', try_cast(arrival_date AS DATE), DATE '{V.RECEIPT_DATE}'), -1)::DOUBLE", "sponsor_wellformed": _D("starts_with(sponsor_id, 'SPN-') AND sponsor_id <> 'SPN-0000' AND length(sponsor_id) = 8"),
    "species_known": _D(f"species_code IN {_IN(V.SPECIES)}"), "world_known": _D(f"home_world IN {_IN(V.WORLDS)}"), "purpose_known": _D(f"declared_purpose IN {_IN(V.PURPOSES)}"), "visa_known": _D(f"visa_class IN {_IN(V.VISAS)}"),
    **_HELD("src", "sources_seen", features.ROLES), **_ONE("visa", "visa_class", V.VISAS), **_ONE("fee", "fee_status", V.FEES), **_ONE("purpose", "declared_purpose", V.PURPOSES), **_HELD("flag", "risk_flags", V.FLAGS),
    **{f"has_{f}": _D(f"{_S[f]} <> ''") for f in _F}, **{f"native_{f}": _D(f"starts_with({_S[f]}, 'native')") for f in _F}, **{f"stdocr_{f}": _D(f"{_S[f]} IN {_IN(features.STANDARD_STREAMS[1:])}") for f in _F},
    **{f"special_{f}": _D(f"{_S[f]} <> '' AND {_S[f]} NOT IN {_STD}") for f in _F}, **{f"untrusted_{f}": _D(f"list_contains(untrusted_conflicts, '{f}')") for f in _F},
    **{f"mark_{m}": _D(f"{_S[m]} <> ''") for m in features.MARKS}, "risk_source_present": _D(f"{_S['risk_flags']} <> ''"),
    "trusted_chars_lt_120": _D("trusted_text_chars < 120"), "trusted_chars_lt_400": _D("trusted_text_chars < 400"), "trusted_chars_ge_1000": _D("trusted_text_chars >= 1000"),
}
_LISTED = lambda row: ", ".join(f'{sql} AS "{n}"' for n, sql in row.items())


@query(f"{_WITH} SELECT k, {_LISTED(_EVIDENCE)} FROM ev")
def evidence_features(spark, sf_dir):
    return _undefaulted(_evidence(spark, sf_dir)).select("k", *[c.alias(n) for n, c in features.evidence_row().items()])


@query(f"{_WITH} SELECT k, {_LISTED({**_ARBITER, **_VERDICTS})} FROM ev")
def arbiter_features(spark, sf_dir):
    return _evidence(spark, sf_dir).select("k", *[c.alias(n) for n, c in features.arbiter_row().items()])


@query(f"{_WITH} SELECT k, {_LISTED(_ARBITER)} FROM ev")
def arbiter_features_replace(spark, sf_dir):
    return _evidence(spark, sf_dir).select("k", *[c.alias(n) for n, c in features.arbiter_row(replace=True).items()])


_CHOICE = f"""{_WITH}, worth AS MATERIALIZED (SELECT k, truth, finding, hard, decision, proba, meta_conf, missing, conflicts, untrusted_conflicts, risk_flags, observed_flags_seen, sources_seen, trusted_text_chars, {', '.join(f'{x} AS eu_{a}' for a, x in _EU.items())} FROM ev),
acted AS MATERIALIZED (SELECT *, CASE WHEN finding IS NOT NULL THEN finding WHEN hard = 'DENIED' THEN 'DENIED' WHEN eu_APPROVED >= eu_DENIED AND eu_APPROVED >= eu_NEEDS_REVIEW THEN 'APPROVED' WHEN eu_DENIED >= eu_NEEDS_REVIEW THEN 'DENIED' ELSE 'NEEDS_REVIEW' END AS act FROM worth),
chosen AS MATERIALIZED (SELECT *, proba[list_position({_SQL_ARRAY(V.LABELS)}, act)] AS chosen_p, proba[list_position({_SQL_ARRAY(V.LABELS)}, decision)] AS current_p FROM acted)"""
_TAKEN = ("n_missing", "n_conflicts", "n_untrusted_conflicts", "n_flags", "observed_flags_seen", "has_dq_flag", "has_review_flag", "src_intake", "src_fee", "src_biometric", "risk_source_present", "trusted_chars_lt_120", "trusted_chars_lt_400")
_CORRECT = {
    "p_approved": "round(proba[1], 9)", "p_denied": "round(proba[2], 9)", "p_review": "round(proba[3], 9)", "chosen_p": "round(chosen_p, 9)", "chosen_logit": "round(ln(greatest(least(chosen_p, 0.9999), 0.0001) / (1 - greatest(least(chosen_p, 0.9999), 0.0001))), 6)",
    "runtime_confidence": "meta_conf::DOUBLE", "changed": _D("act <> decision"), "hard_denied": _D("hard = 'DENIED'"), "finding_present": _D("finding IS NOT NULL"), **{n: _ARBITER[n] for n in _TAKEN},
    **_ONE("action", "act", V.LABELS), **_ONE("current", "decision", V.LABELS),
}


@query(f"{_CHOICE} SELECT k, {_LISTED(_CORRECT)} FROM chosen")
def correctness_features(spark, sf_dir):
    df = _evidence(spark, sf_dir).withColumn("action", features.arbiter_action())
    places = {"p_approved": 9, "p_denied": 9, "p_review": 9, "chosen_p": 9, "chosen_logit": 6}
    return df.select("k", *[(F.round(c, places[n]) if n in places else c).alias(n) for n, c in features.correctness_row(F.col("action")).items()])


_GAIN = "CASE WHEN truth = {x} THEN 8 WHEN truth = 'DENIED' AND {x} = 'APPROVED' THEN -4 WHEN {x} = 'NEEDS_REVIEW' THEN 2 WHEN truth = 'NEEDS_REVIEW' THEN 1 ELSE 0 END"


@query(f"""{_CHOICE} SELECT k, act AS base, decision AS engine, ({_GAIN.format(x='act')} - {_GAIN.format(x='decision')})::BIGINT AS gain, round(chosen_p - current_p, 6) AS p_gap,
  round(list_sort([eu_APPROVED, eu_DENIED, eu_NEEDS_REVIEW])[3] - list_sort([eu_APPROVED, eu_DENIED, eu_NEEDS_REVIEW])[2], 6) AS worth_gap FROM chosen WHERE act <> decision AND gain <> 0""")
def gate_rows(spark, sf_dir):
    """The rows that the disagreement gate learns from."""
    df = _evidence(spark, sf_dir).withColumn("base", features.arbiter_action())
    row = features.gate_row(F.col("base"))
    gain = (metrics.points(F.col("truth"), F.col("base")) - metrics.points(F.col("truth"), F.col("decision"))).cast("long")
    columns = [F.col("k"), F.col("base"), F.col("decision").alias("engine"), gain.alias("gain"), F.round(row["p_gap"], 6).alias("p_gap"), F.round(row["worth_gap"], 6).alias("worth_gap")]
    return ranking.rows_where(df, (F.col("base") != F.col("decision")) & (gain != 0), *columns)


@query()
def gate_actions(spark, sf_dir):
    """Cross-fitted gate on its own feature row: each fold's gate and threshold come from the others."""
    df = metrics.assign_folds(_evidence(spark, sf_dir).withColumn("base", features.arbiter_action()), "case_id", 2)
    row = {f"gate_{n}": c for n, c in features.gate_row(F.col("base")).items()}
    df = df.select("k", "base", F.col("decision").alias("engine"), "truth", "fold", *[c.alias(n) for n, c in row.items()])
    parts = []
    for fold in range(2):
        learn, use = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        gate = learning.fit_gate(learn, list(row), "base", "engine", "truth")
        least = learning.gate_threshold(gate(learn), "base", "engine", "truth")
        parts.append(gate(use).withColumn("least", F.lit(least)))
    both = parts[0].unionByName(parts[1])
    act = F.when((F.col("base") != F.col("engine")) & (F.coalesce("gate_p", F.lit(0.0)) < F.col("least")), F.col("engine")).otherwise(F.col("base"))
    return both.select("k", "fold", act.alias("action"))


# ---- ranking, sets, counts -----------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) = 1")
def best_value(spark, sf_dir):
    return ranking.best_of(D.table(spark, sf_dir, "events"), ["user_id"], "event_type", "value").select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (event_id % 3 <> 0), arg_max(event_type, event_id)) AS event_type FROM events GROUP BY user_id""")
def latest_not_crossed(spark, sf_dir):
    return ranking.latest_open(D.table(spark, sf_dir, "events").withColumn("crossed", F.col("event_id") % 3 == 0), ["user_id"], "event_type", "event_id", "crossed")


@query("SELECT event_id, round(value, 6) AS value FROM events ORDER BY value DESC, event_id LIMIT 15")
def top_fifteen(spark, sf_dir):
    return ranking.top(D.table(spark, sf_dir, "events"), "value", "event_id").select("event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {D.PACKETS}, l AS (SELECT case_id, untrusted_conflicts || conflicts || ['fee_status', 'visa_class'] AS l FROM packets)
SELECT case_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS listed FROM l""")
def ordered_distinct(spark, sf_dir):
    more = F.array(F.lit("fee_status"), F.lit("visa_class"))
    return D.packets(spark, sf_dir).select("case_id", F.array_join(ranking.ordered_distinct(F.col("untrusted_conflicts"), F.col("conflicts"), more), "|").alias("listed"))


@query(f"""WITH {D.PACKETS} SELECT case_id, CASE WHEN sponsor_id IS NULL THEN CASE WHEN k % 2 = 0 THEN 'SPN-1111' END WHEN k % 2 = 0 AND sponsor_id <> 'SPN-1111' THEN NULL ELSE sponsor_id END AS sponsor_id FROM packets""")
def unique_sponsor(spark, sf_dir):
    """The sponsor id that all readings agree on."""
    readings = F.array(F.col("sponsor_id"), F.when(F.col("k") % 2 == 0, "SPN-1111"), F.col("sponsor_id"))
    return D.packets(spark, sf_dir).select("case_id", ranking.unique_value(readings).alias("sponsor_id"))


@query("SELECT event_type AS op, 'a' AS true_ch, 'b' AS obs_ch, count(*) AS n FROM events GROUP BY 1")
def merged_counts(spark, sf_dir):
    """Counts of two corpora, added by operation."""
    e = D.table(spark, sf_dir, "events")
    part = lambda rest: e.where(F.col("user_id") % 2 == rest).groupBy(F.col("event_type").alias("op"), F.lit("a").alias("true_ch"), F.lit("b").alias("obs_ch")).agg(F.count("*").alias("n"))
    return channel.merge_counts(part(0), part(1)).select("op", "true_ch", "obs_ch", F.col("n").cast("long").alias("n"))
