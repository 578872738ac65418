"""Periodic runs against trying every stretch."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from packetloom.llm import periodic_runs as P
from packetloom.llm.queries import op13_periodic_runs

from .helpers import empty_documents, odd_documents, sentence


def brute(words):
    """Maximal stretches by period, smallest first; a stretch whose words were found with a smaller period is no new run."""
    n, runs = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(12, 2 * p) and not any(words[i + q : i + length] == words[i : i + length - q] for q in range(1, p)):
                runs[i, p] = length
            i = j
    return [(s, length, p) for (s, p), length in sorted(runs.items())]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts():
    rng = random.Random(5)
    out = [list("a" * n) for n in (0, 1, 11, 12, 13, 40)] + [list("ab" * 6), list("ab" * 5 + "a"), list("abcdef" * 2), list("abcdefg" * 2), list("abcdefg" * 2)[:13], fibonacci(150), fibonacci(89)]
    for alphabet in (1, 2, 3, 8):
        for _ in range(40):
            words = [rng.choice("abcdefgh"[:alphabet]) for _ in range(rng.randrange(80))]
            for _ in range(rng.randrange(4)):
                p, at = rng.randrange(1, 12), rng.randrange(len(words) + 1)
                unit = [rng.choice("abcdefghij") for _ in range(p)]
                words[at:at] = (unit * 8)[: rng.randrange(p, 6 * p + 1)]
            out.append(words)
    return out


def test_runs_are_those_of_brute_force(monkeypatch):
    for words in texts():
        assert P.find(P.numbered(words)) == brute(words), "".join(words)
    monkeypatch.setattr(P, "PROBES", 7)
    monkeypatch.setattr(P, "CHUNKS", (1, 4))
    for words in texts()[::3]:
        assert P.find(P.numbered(words)) == brute(words)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return list(words)
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").split())
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in runs)]
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(kept)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(w), None, None, None) for i, w in enumerate(texts())] + [(1000 + i, sentence(rng, rng.randrange(1, 120)), "en", "a", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, odd_documents(spark).drop("size", "hash", "k", "source_size").schema)
    docs = docs.unionByName(odd_documents(spark).where("length(text) < 1000 or text is null").select(docs.columns))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = [expected(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(r[1] > 1 for r in want)


def test_odd_and_empty_tables(spark):
    assert P.detect_runs(odd_documents(spark)).count() == 11 and P.detect_runs(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("make", [lambda n: np.zeros(n, np.int64), lambda n: np.arange(n) % 1000, lambda n: np.random.default_rng(1).integers(0, 1000, n), lambda n: np.array([ord(c) for c in fibonacci(n)])])
def test_long_texts_take_near_linear_time(make):
    began = time.perf_counter()
    runs = P.find(make(200_000))
    assert time.perf_counter() - began < 20 and all(length >= max(12, 2 * p) for _, length, p in runs)
