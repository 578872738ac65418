"""Rows that cost much work are dealt over all cores, however the table is stored."""

import pytest

from packetloom.plans import date_queries, derived, escalation_queries, text_evidence_queries


@pytest.mark.parametrize("rows", [derived.rendered, escalation_queries.chain_packets, date_queries.date_texts, text_evidence_queries.fee_texts])
def test_costly_rows_are_spread(spark, sf, rows):
    held = [n for n in rows(spark, sf).select("*").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(held) >= spark.sparkContext.defaultParallelism and max(held) < sum(held) / 2
