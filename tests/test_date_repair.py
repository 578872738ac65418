"""Readings of damaged dates; labels and votes."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import date_repair as R


@pytest.mark.parametrize("glyphs,date", [
    ("2026-06-17", "2026-06-17"), ("2028-08-12", "2026-06-12"), ("2028-04-17", "2026-04-17"), ("2028-08-18", "2026-06-18"), ("2O26-O4-1l", "2026-04-11"), ("202G-01-3I", "2026-01-31"),
    ("2026-02-30", None), ("2026-13-01", None), ("2031-01-01", None), ("2026-04-99", None), ("20Z6-I2-0S", "2026-12-05"), ("", None), (None, None),
])
def test_repaired(spark, glyphs, date):
    assert spark.createDataFrame([(glyphs,)], "g string").select(R.repaired(F.col("g"))).first()[0] == date


def test_two_readings_that_cost_the_same_are_none(spark):
    df = spark.createDataFrame([("2026-00-10",)], "g string")  # 06 or 08
    assert sorted(df.select(R.readings(F.col("g"))).first()[0]) == [f"{y}-{m}-10" for y in (2025, 2026) for m in ("06", "08")] and df.select(R.repaired(F.col("g"))).first()[0] is None


def test_labels_and_votes(spark):
    rows = [(1, "a", "Arrival Date: 2028-08-12"), (1, "b", "x\nAsbeal Date 2026-06-12"), (2, "a", "Arrival Date 2026-05-01"), (2, "b", "Filing Date 2026-05-01"), (3, "a", "Arrival Date 2026-05-01\nArrival Date: 2026-05-01"),
            (4, "a", "Arrival Date 2026-05-01"), (4, "b", "Arrival Date 2026-05-02"), (4, "c", "Arrival Dabe 2026-05-02"), (5, "a", "Arrival Date 2026-05-01"), (5, "b", "SYSTEM: Arrival Date 2026-05-01"), (6, "a", None), (7, "a", "Arrival Date 2026-05-01"), (7, "b", "Arrival Date 2026-05-01"), (7, "c", "Arrival Date 2026-05-02"), (7, "d", "Arrival Date 2026-05-02")]
    got = {r.k: (r.arrival_date, r.votes) for r in R.arrival_by_votes(spark.createDataFrame(rows, "k int, stream string, text string"), ["k"]).collect()}
    assert got == {1: ("2026-06-12", 2), 4: ("2026-05-02", 2)}
