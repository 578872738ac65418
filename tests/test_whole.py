"""Whole jobs against brute force on small tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions.similarity import EditDistances, alignment, channel_log_probability
from packetloom.plans import queries as Q


def edits(a, b):
    return sum(op != "M" for op, _, _ in alignment(a, b))


def test_edit_distances_are_those_of_alignments():
    rng = random.Random(1)
    for _ in range(50):
        known = ["".join(rng.choice("abcÜ ") for _ in range(rng.choice([0, 1, 2, 5, 9, 70]))) for _ in range(rng.randrange(1, 9))]
        text = "".join(rng.choice("abcÜ x") for _ in range(rng.choice([0, 1, 3, 8, 80])))
        assert EditDistances(known)(text) == [edits(k, text) for k in known]


def test_page_cer_whole_scores_all_letters_of_all_texts_and_items(spark, tmp_path):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("ab cdé漢") for _ in range(n))
    items = [(i, make(rng.randrange(40, 110))) for i in range(24)] + [(24, " "), (25, None), (3, "other text of a repeated item")]
    texts = [t for _, t in items[:22] if t] * 2 + [t[:-3] + "xyz" for _, t in items[5:15]] + [make(n) for n in (1, 70, 100, 219, 500)] + ["", "  ", None, "ß" * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, e in items:
        e = (e or "").upper()
        for t in texts:
            if t is not None:
                t = t.upper()
                want.setdefault(i, []).append(1.0 if not e.strip(" ") or not t.strip(" ") else min(1.0, edits(e, t) / len(e)))
    got = {r.item_id: (r.n, r.cer) for r in Q.QUERIES["page_cer_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(r), pytest.approx(sum(r) / len(r), abs=2e-6)) for i, r in want.items()}


def test_channel_counts_weigh_pairs_by_their_rows(spark, tmp_path):
    # purposes and damages recur unevenly
    rng = random.Random(5)
    orders = [(rng.choice([0, 0, 0, 0, 1, 2, 3]) + 1000 * 13 * i, rng.choice([0, 0, 0, 1, 2])) for i in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = Q._damaged(spark, str(tmp_path)).withColumn("true", Q.D.pick(Q.V.PURPOSES, F.col("k"))).collect()
    counts = collections.Counter()
    for r in rows:
        d = edits(r.true, r.raw)
        if not (d > 4 and d / max(len(r.true), len(r.raw), 1) > 0.6):
            counts.update(alignment(r.true, r.raw))
    got = {r.k: r.log_p for r in Q.QUERIES["channel_log_probability"](spark, str(tmp_path)).collect()}
    assert got == {r.k: pytest.approx(channel_log_probability(r.raw, r.true, counts), abs=1e-6) for r in rows}
    assert {(r.op, r.true_ch, r.obs_ch): r.n for r in Q.QUERIES["char_op_counts"](spark, str(tmp_path)).collect()} == counts
