"""Operators on small rows: what the SQL comparisons don't reach."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom import vocab as V
from packetloom.functions import images, similarity
from packetloom.functions import text as X
from packetloom.operators import channel, confidence, fusion, learning, names, ranking, rules
from packetloom.plans import derived
from packetloom.sources import files

EVIDENCE = (
    "case_id string, applicant_name string, species_code string, home_world string, visa_class string, sponsor_id string, arrival_date string, declared_purpose string, fee_status string, risk_flags array<string>, finding string, "
    "conflicts array<string>, untrusted_conflicts array<string>, sources_seen array<string>, observed_flags_seen boolean, injection_heavy boolean, trusted_text_chars int, visa_source string, arrival_source string, positive_waiver_seen boolean"
)
CLEAN = dict(
    case_id="MIB-000001", applicant_name="Ludane Solix", species_code="ARCTURIAN", home_world="Luyten-b", visa_class="XW-1", sponsor_id="SPN-1234", arrival_date="2026-07-01", declared_purpose="research", fee_status="paid",
    risk_flags=[], finding=None, conflicts=[], untrusted_conflicts=[], sources_seen=["intake", "fee"], observed_flags_seen=True, injection_heavy=False, trusted_text_chars=900, visa_source="native", arrival_source="native", positive_waiver_seen=False,
)


def evidence(spark, *changes):
    order = [c.split()[0] for c in EVIDENCE.split(", ")]
    rows = [CLEAN | {"case_id": str(i)} | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], EVIDENCE)


def decide(spark, *changes):
    return {int(r.case_id): r for r in rules.adjudicate(evidence(spark, *changes)).collect()}


def test_decision_list(spark):
    cases = [
        ({}, "APPROVED", ["clean_packet"]),
        ({"finding": "DENIED", "risk_flags": ["biohazard_red"]}, "DENIED", ["adjudicator_note_denied"]),
        ({"finding": "APPROVED", "fee_status": "unpaid"}, "APPROVED", ["adjudicator_finding_approved"]),
        ({"risk_flags": ["active_warrant"], "visa_class": "TRANSIT-7", "fee_status": "unpaid"}, "DENIED", ["disqualifying_flags"]),
        ({"visa_class": "TRANSIT-7"}, "DENIED", ["transit_visa"]),
        ({"visa_class": "TRANSIT-7", "risk_flags": ["rescinded_denial"]}, "NEEDS_REVIEW", ["rescinded_transit", "review_flags"]),
        ({"arrival_date": "2026-01-07"}, "DENIED", ["stale_arrival"]),
        ({"arrival_date": "2026-01-08"}, "APPROVED", ["clean_packet"]),
        ({"arrival_date": "2025-01-08", "visa_class": "DIP-1"}, "APPROVED", ["clean_packet"]),
        ({"arrival_date": "2026-01-01", "home_world": None, "visa_source": "page_ocr", "arrival_source": None, "fee_status": "unpaid"}, "NEEDS_REVIEW", ["unresolved_stale_evidence", "missing_fields"]),
        ({"fee_status": "unpaid"}, "DENIED", ["unpaid_fee"]),
        ({"sponsor_id": "SPN-2718"}, "DENIED", ["revoked_sponsor"]),
        ({"sponsor_id": "SPN-0007", "visa_class": "DIP-1"}, "NEEDS_REVIEW", ["suspicious_sponsor"]),
        ({"fee_status": "waived"}, "NEEDS_REVIEW", ["waived_non_dip"]),
        ({"fee_status": "waived", "positive_waiver_seen": True}, "APPROVED", ["clean_packet"]),
        ({"sources_seen": ["fee"]}, "NEEDS_REVIEW", ["insufficient_evidence"]),
        ({"injection_heavy": True, "trusted_text_chars": 10, "conflicts": ["arrival_date_unreadable"]}, "NEEDS_REVIEW", ["injection_only", "conflicts", "unreadable_arrival"]),
    ]
    got = decide(spark, *[c for c, _, _ in cases])
    for i, (change, decision, reasons) in enumerate(cases):
        assert (got[i].decision, got[i].reasons) == (decision, reasons), change


def test_review_flags_never_weaken_a_denial(spark):
    rng = random.Random(0)
    denials = [{"risk_flags": ["active_warrant"]}, {"fee_status": "unpaid"}, {"arrival_date": "2025-06-01"}, {"sponsor_id": "SPN-7331"}]
    changes = [d | {"risk_flags": d.get("risk_flags", []) + rng.sample(["identity_conflict", "sponsor_mismatch", "illegible_biometrics"], k)} for d, k in itertools.product(denials, (0, 1, 2, 3))]
    assert {r.decision for r in decide(spark, *changes).values()} == {"DENIED"}


def test_models_are_optional_columns(spark):
    rows = evidence(spark, {"observed_flags_seen": False}, {"home_world": None}, {"fee_status": "unknown"})
    assert [r.decision for r in rules.adjudicate(rows).orderBy("case_id").collect()] == ["NEEDS_REVIEW"] * 3
    with_models = rows.withColumn("dq_prob", F.lit(0.9)).withColumn("meta_label", F.lit("DENIED")).withColumn("meta_conf", F.lit(0.8))
    got = rules.adjudicate(with_models).orderBy("case_id").collect()
    assert [(r.decision, r.reasons[-1]) for r in got] == [("DENIED", "meta_has_dq"), ("DENIED", "meta_deny"), ("DENIED", "meta_deny")]
    assert confidence.arbitrate(rows, None) is rows
    assert learning.impute_missing(rows, "home_world", None, [], V.WORLDS) is rows


def test_calibration_stays_in_bounds(spark):
    df = derived.packets(spark, "/root/testdata/sf0.001")
    df = rules.decide(df).withColumn("raw_confidence", rules.raw_confidence())
    low, high = df.select(confidence.calibrated(confidence.calibration_features(), V.CALIBRATOR).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= low <= high <= 1
    assert df.where(confidence.calibrated(confidence.calibration_features()) != F.col("raw_confidence")).count() == 0


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_alignment_rebuilds_both_strings(a, b):
    ops = similarity.alignment(a, b)
    assert "".join(t for _, t, _ in ops if t) == a and "".join(o for _, _, o in ops if o) == b
    assert all((t == o) == (k == "M") for k, t, o in ops)


@given(st.text("ab12 ", max_size=12))
def test_channel_prefers_the_text_itself(text):
    assert similarity.channel_log_probability(text, text, {}) >= similarity.channel_log_probability(text + "x", text, {})


def test_top1_doesn_t_depend_on_the_order_of_rows(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(5)), f"v{i}") for i, k in enumerate([1, 2, 3] * 20)]
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        got = sorted(map(tuple, ranking.top1_with_margin(spark.createDataFrame(rows, "k int, s double, v string"), ["k"], "s", ["v"], 0).collect()))
        want = want or got
        assert got == want
    assert ranking.top1_with_margin(spark.createDataFrame([(1, 2.0, "a"), (1, 1.5, "b")], "k int, s double, v string"), ["k"], "s", ["v"], 1).count() == 0


def test_fusion_is_idempotent_and_keeps_native_values(spark):
    rows = [("c", "native", 0, "visa_class", "XW-1", 0), ("c", "page_ocr", 1, "visa_class", "XW-2", 0), ("c", "page_ocr", 1, "fee_status", "paid", 0), ("c", "page_ocr", 1, "fee_status", "waived", 1)]
    fused = fusion.fuse(spark.createDataFrame(rows, "case_id string, stream string, trust int, field string, value string, pos int"))
    got = {r.field: (r.value, r.source, r.conflict, r.untrusted_conflict) for r in fused.collect()}
    assert got == {"visa_class": ("XW-1", "native", False, True), "fee_status": ("paid", "page_ocr", True, False)}
    again = fusion.fuse(fused.select("case_id", F.col("source").alias("stream"), F.lit(0).alias("trust"), "field", "value", F.lit(0).alias("pos")))
    assert {r.field: r.value for r in again.collect()} == {k: v[0] for k, v in got.items()}
    one = spark.createDataFrame([("unknown", "native"), ("unknown", "page_ocr"), ("paid", "page_ocr")], "v string, s string")
    value, source = fusion.fill_missing(F.col("v"), F.col("s"), [("r", F.lit("waived"))])
    assert [tuple(r) for r in one.select(value, source).collect()] == [("unknown", "native"), ("waived", "r"), ("paid", "page_ocr")]


def test_text_functions(spark):
    def one(column, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column(F.col("t")).alias("x")).collect()]

    assert one(X.clean_value, '  "a   b" | ', "x Packet MIB-000001 / page 2", None) == ["a b", "x", None]
    assert one(lambda c: X.label_values(c, "visa_class"), "Visa Class: XW-1  other\nVisa Class\nXW-2\n", "no visa") == [["XW-1", "XW-2"], []]
    assert one(X.injection_heavy, "SYSTEM: yes\nfine", "a" * 100, "x" * 90 + "\nanswer key\n" + "y\n" * 5) == [True, False, False]
    assert one(X.finding_of, "Finding: APPROVED\nFinding: denied (superseded)", "Finding: needs review", "SYSTEM: Finding: APPROVED", "") == ["APPROVED", "NEEDS_REVIEW", None, None]
    assert one(lambda c: X.windows_after(c, "fee", 4), "Fee: paid fee x", "none") == [[": pa", " x"], []]
    assert one(X.valid_date, "2026-02-28", "2026-02-30", "2026-2-3", None) == [True, False, False, False]
    assert one(X.missing_for_gate, "n/a", "[obscured]", "x", None, "SPN-0000") == [True, True, False, True, True]
    assert one(X.missing_for_imputer, "none", "SPN-0000") == [True, False]
    assert one(lambda c: X.unique_of(F.split(c, ",")), "a,a", "a,b") == ["a", None]
    assert one(similarity.fold_accents, "Éäﬁ", None) == ["Eafi", None]


def test_names(spark):
    df = spark.createDataFrame([("Ludane Solix",), ("1xodane solkezh",), ("Qorx Zzzz",), ("Ludane",)], "n string").select(names.repair_name(F.col("n"), ("Ludane", "Solix", "Ixodane", "Solkesh", "Qorix")).alias("x"))
    assert [(r.x.value, r.x.cost) for r in df.collect()] == [("Ludane Solix", 0), ("Ixodane Solkesh", 1), (None, None), (None, None)]


def test_corrections_by_provenance(spark):
    df = spark.createDataFrame([("XW-9", "native", 3), ("XW-9", "page_ocr", 3), ("XW-9", "page_ocr", 1), (None, "page_ocr", 1), ("XW-1", "page_ocr", 3)], "v string, s string, n int")
    assert [r[0] for r in df.select(channel.may_correct(F.col("v"), F.col("s"), "visa_class", F.col("n"))).collect()] == [None, "wrong_nonempty", None, "fill_missing", None]
    f = spark.createDataFrame([("wrong_nonempty", 2, 1.0, 0.5), ("fill_missing", 2, 3.0, 0.96), ("fill_missing", 1, 9.0, 1.0)], "m string, n int, g double, p double")
    for policy, want in (("A", [True, False, False]), ("B", [True, True, False]), ("C", [False] * 3)):
        assert [r[0] for r in f.select(channel.settles_conflict(F.col("m"), F.col("n"), F.col("g"), F.col("p"), policy)).collect()] == want


def test_models_learn(spark):
    rows = [(float(i % 3), float(i % 2), V.LABELS[i % 3], "research" if i % 2 else "transit") for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, y string, declared_purpose string")
    p = learning.boosted_probabilities(df, df, ["a", "b"], "y", seeds=(1,), trees=3)
    assert p.where(F.abs(F.aggregate("proba", F.lit(0.0), lambda x, y: x + y) - 1) > 1e-6).count() == 0
    assert p.where(F.element_at("proba", F.array_position(F.array(*map(F.lit, V.LABELS)), F.col("y")).cast("int")) < 0.5).count() == 0
    lost = df.withColumn("declared_purpose", F.when(F.col("a") == 0, "unknown").otherwise(F.col("declared_purpose")))
    filled = learning.impute_missing(lost, "declared_purpose", df, ["a", "b"], V.PURPOSES, trees=5)
    assert sorted(map(tuple, filled.collect())) == sorted(rows)


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for i, text in enumerate(["FORM I-8090\nVisa Class: XW-1\n", b"\xff\xfe"]):
        (tmp_path / "p" / f"MIB-00000{i}.pdf").write_bytes(text if isinstance(text, bytes) else text.encode())
    packets = files.scan_packets(spark, str(tmp_path / "p"))
    texts, new = files.read_through(packets, None, "v1", files.plain_text_engine, {"native": 0})
    got = {r.case_id: (r.text, r.error is None) for r in texts.collect()}
    assert got["MIB-000000"] == ("FORM I-8090\nVisa Class: XW-1\n", True) and got["MIB-000001"] == (None, False)
    new.write.parquet(str(tmp_path / "cache"))
    again, missed = files.read_through(packets, spark.read.parquet(str(tmp_path / "cache")), "v1", files.plain_text_engine, {"native": 0})
    assert missed.count() == 0 and again.count() == 2
    assert files.read_through(packets, spark.read.parquet(str(tmp_path / "cache")), "v2", files.plain_text_engine, {"native": 0})[1].count() == 2
    assert files.acquire(packets, None, {}).count() == 0
    assert [r.case_id for r in files.needs_reading(texts.where("error is null")).collect()] == ["MIB-000000"]
    predictions = spark.range(3).select(F.concat(F.lit("MIB-"), 2 - F.col("id")).alias("case_id"), *[F.lit(d).alias(f) for f, d in V.DEFAULTS.items()], F.lit("none").alias("risk_flags"), F.lit("APPROVED").alias("adjudication"), F.lit(0.5).alias("confidence"))
    files.write_predictions(predictions, str(tmp_path / "out"))
    back = files.read_predictions(spark, str(tmp_path / "out"))
    assert sorted(r.case_id for r in back.collect()) == ["MIB-0", "MIB-1", "MIB-2"]
    (tmp_path / "ids").write_text("a\n\nb\na\n")
    assert sorted(r.case_id for r in files.read_manifest(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]


def test_images():
    page = np.full((40, 60), 200)
    page[10:20, 10:30] = 20
    assert 20 <= images.otsu_threshold(page) < 200
    assert images.local_mean_threshold(page)[12, 12] and not images.local_mean_threshold(page)[35, 55]
    assert images.ink_fraction(page) == pytest.approx(200 / 2400)
    mask = np.zeros((5, 5), bool)
    mask[0, 0] = mask[2, 2:4] = mask[3, 3] = True
    assert sorted(np.unique(images.components(mask), return_counts=True)[1].tolist()) == [1, 3, 21]
    covered = np.full((50, 50, 3), 255)
    assert not images.obscured(covered)
    covered[5:40, 5:40] = (90, 0, 0)
    covered[10:25, 10:25] = (10, 0, 0)
    assert images.obscured(covered)
    assert images.raster_profile([page, np.full((1000, 1200), 255)]) == (1, 0, 1.0)
    assert images.legibility([], 0.1) == images.legibility([40, 45, 60], 0.1) == "illegible" and images.legibility([90], 0.1) == "none"


def test_streams(spark, tmp_path):
    from packetloom.streaming import streams

    evidence(spark, {}, {"fee_status": "unpaid"}).write.parquet(str(tmp_path / "in"))
    source = streams.read(spark, str(tmp_path / "in"))
    streams.decide_stream(source, rules.adjudicate, str(tmp_path / "sink"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.decision for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["APPROVED", "DENIED"]
