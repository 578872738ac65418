"""The search for places holds numbers, not an object per match."""

import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from packetloom.functions import spans as S


def test_spans_of_null_empty_and_wide_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ab c\U0001f600 d")], "k int, t string").select("k", S.spans_of(F.col("t"), {"word": "[^ ]+", "d": "d"}).alias("x"))
    got = {r.k: ([tuple(s) for s in r.x.word], [tuple(s) for s in r.x.d]) for r in rows.collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([(0, 2, "ab"), (3, 5, "c\U0001f600"), (6, 7, "d")], [(6, 7, "d")])}


def test_a_batch_of_many_matches_stays_small():
    text = "word " * 1000
    texts = pa.array([text] * 300)
    tracemalloc.start()
    found = S._matches(texts, re.compile("[^ ]+"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.values) == 300_000 and found[299].as_py()[-1] == {"start": 4995, "end": 4999, "text": "word"}
    assert peak < 20_000_000, peak
