"""Feature rows, the disagreement gate, small ranking operators."""

from datetime import date

from pyspark.sql import functions as F

from packetloom.operators import features, learning, ranking

STATE = """k long, applicant_name string, species_code string, home_world string, visa_class string, sponsor_id string, arrival_date string, declared_purpose string, fee_status string,
risk_flags array<string>, conflicts array<string>, untrusted_conflicts array<string>, sources_seen array<string>, observed_flags_seen boolean, positive_waiver_seen boolean, injection_heavy boolean,
trusted_text_chars int, finding string, rule_decision string, field_sources map<string, string>, missing array<string>, meta_label string, meta_conf double, dq_prob double, decision string, hard string,
raw_confidence double, reasons array<string>, pages int, pdf_bytes long, explicit_risk_flags array<string>, repaired_fields array<string>, proba array<double>, confidence double"""


def states(spark):
    full = (1, "Arix Soltari", "ARCTURIAN", "Wolf-1061c", "XW-1", "SPN-1234", "2026-07-01", "research", "paid", ["active_warrant"], [], ["fee_status"], ["intake", "fee"], True, False, False, 500, "APPROVED", "DENIED",
            {"visa_class": "native", "fee_status": "page_ocr", "sponsor_id": "note_crop", "_damage_implies_illegible": "x"}, [], "DENIED", 0.5, 0.1, "APPROVED", None, 0.8, ["clean_packet"], 3, 1000, ["active_warrant"], ["visa_class"], [0.5, 0.3, 0.2], 0.7)
    return spark.createDataFrame([full, (2, *[None] * 33)], STATE)


def row(df, columns):
    return {r.k: r for r in df.select("k", *[c.alias(n) for n, c in columns.items()]).collect()}


def test_row_widths_and_values(spark):
    df = states(spark)
    evidence, arbiter, replaced, right = features.evidence_row(), features.arbiter_row(), features.arbiter_row(replace=True), features.correctness_row(F.lit("DENIED"))
    assert [len(x) for x in (evidence, arbiter, replaced, right)] == [91, 151, 112, 28]
    e, a, c = row(df, evidence), row(df, arbiter), row(df, right)
    assert (e[1].has_dq, e[1].n_fields_from_native, e[1].n_fields_from_standard_ocr, e[1].n_fields_from_specialized_ocr, e[1].r35_repair_visa_class, e[1].trusted_chars_ge_400, e[1].n_missing) == (1, 1, 1, 1, 1, 1, 0)
    assert (a[1].days_before_receipt, a[1].sponsor_wellformed, a[1].special_sponsor_id, a[1].mark__damage_implies_illegible, a[1].why_clean_packet, a[1].final_approved) == (6, 1, 1, 1, 1, 1)
    assert (c[1].chosen_p, c[1].changed, c[1].action_DENIED, c[1].current_APPROVED) == (0.3, 1, 1, 1)
    # a packet of nulls has every feature, none of them null
    assert None not in tuple(e[2]) and None not in tuple(a[2]) and e[2].n_missing == 8 and a[2].days_before_receipt == (date(2026, 7, 7) - date(1900, 1, 1)).days


def test_latest_open_and_unique_value(spark):
    rows = [(1, "a", 1, False), (1, "b", 2, True), (2, "c", 1, True), (2, "d", 2, True), (3, "e", 1, None)]
    got = {r.g: r.v for r in ranking.latest_open(spark.createDataFrame(rows, "g int, v string, o int, x boolean"), ["g"], "v", "o", "x").collect()}
    assert got == {1: "a", 2: "d", 3: "e"}
    lists = spark.createDataFrame([(["a", None, "a"],), (["a", "b"],), ([None],), (None,)], "x array<string>")
    assert [r[0] for r in lists.select(ranking.unique_value(F.col("x"))).collect()] == ["a", None, None, None]


def test_gate_learns_whom_to_trust(spark):
    rows = [(i, float(i % 2), "APPROVED" if i % 2 else "DENIED", "DENIED" if i % 2 else "APPROVED", "APPROVED") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, f double, base string, engine string, truth string")
    gate = learning.fit_gate(df, ["f"], "base", "engine", "truth")
    p = {r.f: r.gate_p for r in gate(df).select("f", "gate_p").distinct().collect()}
    assert p[1.0] > 0.5 > p[0.0] and learning.gate_threshold(gate(df), "base", "engine", "truth") in (0.35, 0.45, 0.55, 0.65, 0.75, 0.85)
    none = learning.fit_gate(df.where("k < 0"), ["f"], "base", "engine", "truth")
    assert none(df).where("gate_p is null").count() == 40
