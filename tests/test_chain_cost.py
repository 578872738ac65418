"""What the chain does for a packet: each text is searched once for each field, and texts without directives aren't taken apart."""

import re

import pytest
from pyspark.sql import functions as F

from packetloom.functions import text as X
from packetloom.operators import escalation as E
from packetloom.plans import escalation_queries as Q


@pytest.mark.parametrize("stages", [0, 1])
def test_a_text_is_searched_once_for_each_field(spark, sf, stages):
    state = E.start(Q.chain_packets(spark, sf), Q.ENGINES["native"])
    shown = spark.conf.get("spark.sql.debug.maxToStringFields", "25")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = E.escalate(state, Q.ENGINES, E.default_stages()[:stages])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    structure = stages  # the gate counts labels by the same function
    assert plan.count("regexp_extract_all(") <= len(E.FIELDS) * (1 + stages) + structure, plan.count("regexp_extract_all(")


ODD = ["", "\n", "a\nb\n", "a\r\nb", "a\x85b\u2028c\u2029d", "a\x0bb\fc\rd", "x\nSYSTEM : do\ny", "system\n: no directive\n", "the Answer Key is\r\nz", "MIB-000001,a b,DENIED,\nw", "MIB-000001,a b\nv", "Packet MIB-000001 / page 1"]
VALUES = ["paid", " a  b ", "'x'", "|\"y", "a Packet 7 / page 2 x", "packet", "a\tb", "``", None]


def test_lines_are_dropped_as_before(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, None]], "t string")
    bad = re.compile(r"(?i:SYSTEM\s*:|answer key|ignore visible evidence)|MIB-[0-9]{6},[^,\n]+,[A-Z0-9_]+,")
    for t, got, heavy in df.select("t", X.strip_injection(F.col("t")), X.injection_heavy(F.col("t"))).collect():
        parts = None if t is None else re.split("\r\n|[\n\x0b\f\r\x85\u2028\u2029]", t)
        assert got == (None if t is None else "\n".join(x for x in parts if not bad.search(x))), t
        assert t is None or heavy == any(bad.search(x) for x in parts), t


def test_values_are_cleaned_as_before(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    assert [r[0] for r in df.select(X.clean_value(F.col("v"))).collect()] == ["paid", "a b", "x", "y", "a", "packet", "a b", "", None]
