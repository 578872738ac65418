import collections
import hashlib
import random
import re

from packetloom.llm import exact_dedup as X

from .helpers import empty_documents, odd_documents


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_normalise_is_the_replacement():
    for t in ["", " ", "a", " a", "a ", "\t\n a\r\x0b\x0c b  ", "a\x1cb\x85c d", "\n"]:
        assert X.normalise(t.encode()) == re.sub("[\x20\x09-\x0d]+", " ", t).encode()


def test_grace_spills_and_compares_content():
    rng = random.Random(1)
    records = [(hashlib.sha256(c).digest(), c, i) for i, c in enumerate(rng.choice([b"x" * 50, rng.randbytes(200)]) for _ in range(3000))]
    for budget in (1, 5000, 1 << 30):
        got = {c: sorted(v) for _, c, v in X.grace(iter(records), lambda p: [p], lambda v, p: v.append(p), budget)}
        want = collections.defaultdict(list)
        for _, c, i in records:
            want[c].append(i)
        assert got == want


def test_contents_with_one_digest_stay_apart():
    records = [(b"\0" * 32, c, i) for i, c in enumerate([b"a", b"b", b"a", b"c"] * 50)]
    got = {c: len(v) for _, c, v in X.grace(iter(records), lambda p: [p], lambda v, p: v.append(p), 1)}
    assert got == {b"a": 100, b"b": 50, b"c": 50}


def test_against_brute_force_with_odd_rows(spark):
    docs = odd_documents(spark)
    rows = X.exact_dedup(docs, table_bytes=100).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    by_text = collections.Counter(r.text_sha256 for r in rows if r.kept)
    assert set(by_text) == {r.text_sha256 for r in rows} and set(by_text.values()) == {1}
    assert X.exact_dedup(empty_documents(spark)).count() == 0
