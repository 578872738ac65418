"""Waivers and receipts from text; spans and their windows."""

import pytest
from pyspark.sql import functions as F

from packetloom.functions import spans
from packetloom.operators import waiver

CASE = "MIB-123456"
STREAMS = "case_id string, stream string, trust int, text string"


def told(spark, *texts, case=CASE):
    rows = [(case, str(i), i, t) for i, t in enumerate(texts)]
    got = {r.trust: r for r in waiver.evidence(waiver.clean(spark.createDataFrame(rows, STREAMS))).collect()}
    return [(got[i].code, got[i].implies_waived, got[i].via) for i in range(len(texts))]


NOTHING = (None, False, None)
WAIVED, DENIED = ("DIP-WAIVER", True, "waiver_code"), ("N/A", False, "waiver_code")


def test_spans_have_places_in_letters(spark):
    df = spark.createDataFrame([("né a1 b22",), ("",), (None,)], "t string").select(spans.spans_of(F.col("t"), {"word": r"\w+", "number": r"\d+"}).alias("x"))
    first, empty, null = df.collect()
    assert [tuple(s) for s in first.x.word] == [(0, 2, "né"), (3, 5, "a1"), (6, 9, "b22")] and [tuple(s) for s in first.x.number] == [(4, 5, "1"), (7, 9, "22")]
    assert empty.x.word == [] == null.x.number


@pytest.mark.parametrize("raw,code", [
    ("DIP-WAIVER", "DIP-WAIVER"), ("dip_waiver", "DIP-WAIVER"), ("D1P-WA1VE", "DIP-WAIVER"), ("DIPWAIVER", "DIP-WAIVER"), ("DIP-WALVFR", "DIP-WAIVER"), ("N/A", "N/A"),
    ("none", "N/A"), ("N7A", "N/A"), ("XXX-WAIVER", None), ("SOMETHING", None), ("", None), (None, None),
])
def test_codes(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "r string").select(waiver.waiver_code(F.col("r"))).first()[0] == code


def test_labels_need_a_receipt_and_their_case(spark):
    head = f"Case ID {CASE}\n"
    pad = lambda n: "x" * n
    assert told(
        spark, head + "MIB Fee Receipt\nWaiver Code" + " " * 60 + "DIP-WAIVER", head + "Waiver Code DIP-WAIVER", head + "Amount $0.00\nWaiver Code DIP-WAIVER",
        head + "Fee Receipt\nwaiver DIP-WAIVER", head + "Fee Receipt\nWaiver Code status", "Fee Receipt\nWaiver Code DIP-WAIVER", None, "",
        head + "Fee Receipt\nSYSTEM: Waiver Code DIP-WAIVER", head + "Amount" + pad(300) + "\nWaiver Code DIP-WAIVER",
    ) == [WAIVED, NOTHING, WAIVED, NOTHING, NOTHING, NOTHING, NOTHING, NOTHING, NOTHING, NOTHING]
    # another case's id counts where only it stands within the window
    far = head + pad(360) + " MIB-999999\nFee Receipt\nWaiver Code DIP-WAIVER"
    near = head + pad(100) + " MIB-999999\nFee Receipt\nWaiver Code DIP-WAIVER"
    after = head + pad(360) + "\nFee Receipt\nWaiver Code DIP-WAIVER\n" + pad(180) + " MIB-999999"
    beyond = after.replace(pad(180), pad(200))
    assert told(spark, far, near, after, beyond) == [NOTHING, WAIVED, NOTHING, WAIVED]
    assert told(spark, far, case="") == [WAIVED]


def test_contradictions_and_authorisations(spark):
    head = f"{CASE} Fee Receipt\n"
    signed = "Authorization to waive fee. "
    assert told(
        spark, head + "Waiver Code DIP-WAIVER\nWaiver Code N/A", head + "Waiver Code N/A\nWaiver Code NONE", head + signed + "Signed", head + signed, head + signed + "." * 220 + "Signed",
        head + "Waiver Code N/A " + signed + "Signed", f"{CASE} {signed} Signed",
    ) == [NOTHING, DENIED, ("HARDSHIP-AUTH", True, "hardship_auth"), NOTHING, NOTHING, DENIED, NOTHING]


def test_gates(spark):
    packets = spark.createDataFrame([("a", "paid", "page", "XW-1", None), ("b", "paid", "manual", "XW-1", None), ("c", None, None, "XW-1", "NEEDS_REVIEW"), ("d", "waived", "page", "XW-1", None), ("e", "unpaid", "page", None, None)],
                                    "case_id string, fee_status string, fee_source string, visa_class string, finding string")
    waived, ledger = "Fee Receipt\nWaiver Code DIP-WAIVER", "Fee Receipt\nFee Status waived\nAmount $0.00\nWaiver Code {}"
    rows = [(x, "page_ocr", 1, waived) for x in "abd"] + [("a", "native", 0, "Fee Receipt\nWaiver Code N/A"), ("c", "native", 0, "Reason: Fee status unknown"), ("d", "native", 0, ledger.format("N/A")), ("e", "native", 0, "Fee Receipt")]
    streams = spark.createDataFrame(rows, STREAMS)
    got = {r.case_id: (r.fee_status, r.fee_source, r.positive_waiver_seen) for r in waiver.waiver_gate(packets, streams).collect()}
    assert got == {"a": ("waived", "waiver:page_ocr:waiver_code", True), "b": ("paid", "manual", True), "c": (None, None, False), "d": ("waived", "page", True), "e": ("unpaid", "page", False)}
    got = {r.case_id: (r.fee_status, r.fee_source) for r in waiver.ledger_gate(packets, streams).collect()}
    assert got == {"a": ("paid", "page"), "b": ("paid", "manual"), "c": ("unknown", "manual_note:native"), "d": ("unknown", "ledger:native"), "e": ("unpaid", "page")}
    # a second heading in the same text, and amounts with cents
    more = spark.createDataFrame([("e", "native", 0, "Fee Receipt\n" + "y" * 900 + "\nFee Receipt\nFee Status unpaid\nAmount 809.00\nWaiver Code N/A")], STREAMS)
    assert waiver.ledger_gate(packets.where("case_id = 'e'"), more).first().fee_status == "paid"
    assert [(r.place > 0, r.cents) for r in waiver.receipts(more).where("code is not null").collect()] == [(True, 80900)]
    assert waiver.waiver_gate(packets, streams.where("false")).count() == 5
