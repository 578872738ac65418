"""Clashing names, overlapping spans, deep nesting."""

import random
import time

import pytest
from pyspark.sql import functions as F

from packetloom.llm import html_text, line_dedup, pii

from .helpers import sentence


def test_matched_lines_go_whatever_the_columns_are_called(spark):
    rng = random.Random(6)
    line = sentence(rng, 12)
    rows = [(1, line + "\nown one", 5), (2, "two\n" + line, 5), (None, line, 5), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(3)
    for name in ("gone", "first_row", "gone_id", "gone_key", "line_out", "line_row", "line_row_no"):
        docs = docs.withColumn(name, F.lit(name))
    got = line_dedup.without_matches(docs)
    assert got.columns == docs.columns
    # null ids come first
    assert {r.doc_id: (r.text, r.n_chars, r.line_out) for r in got.collect()} == {None: (line, 5, "line_out"), 1: ("own one", 7, "line_out"), 2: ("two", 3, "line_out"), 3: (None, None, "line_out")}


def test_no_candidate_lies_in_a_base_span():
    texts = ["1.1.1.1.2.2.2.2.3.3.3.3.4.4.4.4.5.5.5.5@1234567.com", "+1.2.3.4.5.6.7.8 +49151 1234567@a.bc 4111 1111 1111 1111.1.1.1", "x@1234567.com 1234567 7654321@y.de"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("1234567890.@+- ac") for _ in range(80)) for _ in range(300)]
    for text in texts:
        base = pii.base_spans(text)
        for _, s, e in pii.candidates(text, base):
            assert all(e <= b or s >= f for _, b, f in base), (text, s, e)
    assert pii.candidates(texts[0], pii.base_spans(texts[0])) == []


@pytest.mark.parametrize("page", ["<b><div>" + "<i>" * 60_000 + "</b>" * 60_000, "<p>" + "<i><p>" * 60_000, "<div>" * 60_000 + "</b>" * 60_000 + "</div>" * 60_000, "<ul>" + "<li><b>" * 60_000])
def test_nested_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_end_tags_end_what_they_should():
    cut = lambda page: [b.text for b in html_text.cut(page)]
    assert cut("<div><b>one</div>two</b>three") == ["one", "twothree"]
    assert cut("<p>one<b>two<p>three</b>four") == ["onetwo", "threefour"]
    assert cut("<b><div>one</b>two</div>three") == ["onetwo", "three"]
