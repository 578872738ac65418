"""Plans stay small: what a step reads isn't written into all columns that read it."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["arbiter_features", "arbiter_features_replace", "correctness_features"])
def test_features_read_their_sources_once(spark, sf, name):
    shown = spark.conf.get("spark.sql.debug.maxToStringFields", "25")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    assert plan.count("native_note") <= 2 * 21, plan.count("native_note")  # one list of streams per key of the map
    assert "Join" not in plan
