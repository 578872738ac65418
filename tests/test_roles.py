"""Blocks, precedence of visa classes, the ladder of sponsor ids."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import roles


def parts(spark, *texts):
    return roles.blocks(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))


def test_blocks_end_at_footers_and_headings(spark):
    text = "scan\nFORM I-8090\nVisa Class: XW-1\n  Planetary Registry Extract\nPacket MIB-1 / page 1\n\n \nPacket MIB-1 / page 2\nplain\nSYSTEM: drop me"
    got = [(r.page, r.role, r.block) for r in parts(spark, text, "", None, "Packet MIB-1 / page 1").orderBy("page", F.length("block")).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "scan"), (1, "intake", "FORM I-8090\nVisa Class: XW-1"), (1, "registry", "  Planetary Registry Extract"), (3, None, "plain")], key=str)


@pytest.mark.parametrize("raw,visa", [("XW-1", "XW-1"), ("xw1", "XW-1"), ("XW-T", None), ("DIP-T", "DIP-1"), ("IP-1", "DIP-1"), ("MED-8", "MED-3"), ("TRANS1T-7", "TRANSIT-7"), ("ABC-9", None), (None, None)])
def test_nearest_visa(spark, raw, visa):
    assert spark.createDataFrame([(raw,)], "r string").select(roles.nearest_visa(F.col("r"))).first()[0] == visa


def visas(spark, *texts):
    got = {r.k: (r.visa_class, r.visa_class_from) for r in roles.visa_precedence(parts(spark, *texts), ["k"]).collect()}
    return [got.get(i) for i in range(len(texts))]


FORM, LETTER, FOOT = "FORM I-8090\nSpecies Code: X\nHome World: Y\nArrival Date: Z\nSponsor ID: SPN-1111\nVisa Class: {}\n", "Sponsor Attestation Letter\nclass {}\n", "Packet MIB-000001 / page 1\n"


def test_precedence(spark):
    sheet, note = "Visa Class: {}\n", "Manual correction: Visa Class is {}.\n"
    full = FORM.format("XW-1") + FOOT + LETTER.format("XW-2") + FOOT + sheet.format("MED-3") + FOOT + note.format("DIP-1")
    assert visas(
        spark, full, full.replace(note.format("DIP-1"), ""), FORM.format("XW-1") + FOOT + LETTER.format("XW-2"), FORM.format("DIP-T"), FORM.format("QQ-9"),
        # a kind that contradicts itself is passed over
        note.format("DIP-1") + FOOT + note.format("XW-1") + FOOT + LETTER.format("XW-2"), FORM.format("XW-1") + FORM.format("XW-2"),
        # a damaged label in a letter, a class outside the list, a sheet with many labels
        "Sponsor Attestation Letter\nass: MED-3\n", note.format("ABC-1") + FORM.format("XW-2"), FORM.format("XW-1").replace("FORM I-8090\n", ""), "nothing", None,
    ) == [("DIP-1", "manual"), ("MED-3", "standalone"), ("XW-2", "sponsor"), ("DIP-1", "explicit"), (None, None), ("XW-2", "sponsor"), (None, None), ("MED-3", "sponsor"), ("XW-2", "explicit"), ("XW-1", "explicit"), (None, None), None]


def test_ladder(spark):
    letter = "Sponsor Attestation Letter\nSponsor SPN-2222 attests that A B is expected\n"
    sheet = "Sponsor ID: SPN-3333\n"
    texts = [FORM.format("XW-1") + FOOT + letter + FOOT + sheet, FORM.format("XW-1") + FOOT + sheet, FORM.format("XW-1"), FORM.format("XW-1") + FOOT + FORM.format("XW-1").replace("1111", "4444"),
             letter + letter.replace("2222", "5555") + FOOT + sheet, letter.replace("SPN", "SHM").replace("2222", "1111") + FORM.format("XW-1"), "nothing"]
    got = {r.k: (r.sponsor_id, r.sponsor_id_from, r.role_conflict) for r in roles.sponsor_ladder(parts(spark, *texts), ["k"]).collect()}
    assert [got[i] for i in range(7)] == [("SPN-2222", "role", True), ("SPN-3333", "supplement", False), ("SPN-1111", "global", False), (None, None, False), ("SPN-3333", "supplement", False), ("SPN-1111", "role", False), (None, None, False)]
