"""Ranked search against scoring every document."""

import collections
import math
import random
import re

import pytest

from packetloom.llm import lexical_search as X

from .helpers import empty_documents, odd_documents, sentence

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """[(item, [(score, doc_id)])] by the formula, over all pairs."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out.append((item, [(-s, None if none else i) for s, none, i in sorted(scored)[:k]]))
    return out


def found(df):
    """[(item, [(score, doc_id)])] with ranks checked."""
    by = collections.defaultdict(list)
    for r in df.collect():
        by[r.item_id].append((r.rank, r.score, r.doc_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    return {i: [(s, d) for _, s, d in sorted(v)] for i, v in by.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    docs = [(i, sentence(rng, rng.choice([1, 5, 40, 200]))) for i in rng.sample(range(10_000), 300)]
    docs += [(20_000 + i, docs[i][1]) for i in range(60)] + [(30_000, "ÄÖ漢字 x1,X1;x1 'ÄÖ漢字'"), (30_001, "\x00 ~!"), (30_002, None), (30_003, "")]
    items = [(i, sentence(rng, rng.choice([1, 8, 30]))) for i in range(25)] + [(25, "x1 ÄÖ漢字 X1"), (26, "nowhere"), (27, None), (28, "..."), (None, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("shard,parts", [(1, 3), (2, 1), (37, 5), (8192, 2)])
def test_top_is_that_of_scoring_all(spark, corpus, shard, parts):
    docs, items = corpus
    index, n = X.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), shard_docs=shard)
    got = found(X.search(index, n, spark.createDataFrame(items, ITEMS), block_bytes=300))
    assert got == {i: r for i, r in brute(docs, items) if r}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = [(1, "some words here"), (2, "x漢字 TEXT x"), (3, "alpha3"), (4, "12345")]
    got = found(X.rank(docs, spark.createDataFrame(items, ITEMS)))
    want = dict(brute([(r.doc_id, r.text) for r in docs.collect()], items))
    assert got == {i: r for i, r in want.items() if r} and got[1][0][1] is None
    assert X.rank(empty_documents(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert X.rank(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_queries_that_share_an_id_are_each_answered(spark, corpus):
    rows = X.rank(spark.createDataFrame(corpus[0], "doc_id long, text string"), spark.createDataFrame([(1, "alpha3 beta4"), (1, "gamma5")], ITEMS)).collect()
    one = brute(corpus[0], [(1, "alpha3 beta4"), (1, "gamma5")])
    assert sorted(r.score for r in rows) == sorted(s for _, top in one for s, _ in top)


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(X, "_PIECE", 10)
    text = sentence(random.Random(1), 500) + " " + "y" * 100
    assert X.terms_of(text.encode()) == collections.Counter(t.encode() for t in terms(text))
    assert X.count_terms(text.encode()) == len(terms(text)) and X.count_terms(b"") == 0 and X.count_terms(b" a") == 1
