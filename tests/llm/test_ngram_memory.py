"""What the steps of the n-gram join make and hold: linear in the postings, a range of a bucket at a time."""

import collections

import numpy as np

from packetloom.llm import ngram_join as N

from .test_similarity import brute_components, variants


def test_suspects_are_told_in_a_row_per_bucket_and_destination(spark):
    rows = variants(5, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)  # partners are in other chunks
    told = N._told(docs, 5, 4)
    assert {r.dest for r in told.select("dest").collect()} <= set(range(4)) and told.count() <= 16
    shingler = N.Shingler()
    heads = collections.defaultdict(set)
    for _, text in rows:
        s = shingler.shingles((text or "").encode())
        for x in s[: N.prefix_length(len(s))].tolist():
            heads[x].add(N.set_key(s))
    want = {k for keys in heads.values() if len(keys) > 1 for k in keys}
    found = [r.k for r in N._suspects(docs, 5, 4).collect()]
    assert len(want) > 16 and set(found) == want and len(found) == len(want)


def test_ranges_of_a_bucket_are_bounded_and_whole():
    rng = np.random.default_rng(2)
    cells = []
    for _ in range(7):
        s = np.sort(np.concatenate([rng.integers(0, 1 << 64, 900, np.uint64), np.full(100, 1 << 63, np.uint64)]))
        cells.append([s.tobytes(), rng.integers(0, 50, 1000).astype(np.uint32).tobytes(), np.arange(50).tobytes(), np.arange(50).astype(np.uint32).tobytes()])
    (s, d, k, n), = N._merged(cells)
    parts = list(N._merged(cells, 500))
    assert len(parts) == 14 and max(len(p[0]) for p in parts) < 2000
    assert (np.concatenate([p[0] for p in parts]) == s).all() and (np.concatenate([p[1] for p in parts]) == d).all()
    assert not any(set(a[0].tolist()) & set(b[0].tolist()) for a, b in zip(parts, parts[1:]))
    assert all((p[2] == k).all() and (p[3] == n).all() for p in parts) and len(k) == 350


def test_small_ranges_change_no_result(spark, monkeypatch):
    rows = variants(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(N, "_CHUNK", 97)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(docs).collect()}
    assert got == brute_components(rows)
