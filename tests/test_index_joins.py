"""Nearest truths and near places against all pairs."""

import collections
import random

import pytest

from packetloom.functions.similarity import alignment, channel_log_probability
from packetloom.operators import nearest, proximity


def edits(a, b):
    return sum(op != "M" for op, _, _ in alignment(a, b))


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10)))
    known = [(g, f, w) for g in range(12) for f in "xy" for w in {word() for _ in range(rng.randrange(4))}]
    seen = []
    for g, f, w in known * 2:
        cut = list(w)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(cut) + 1)
            cut[at : at + rng.randrange(2)] = rng.choice(["", "a", "e", "Q"])
        seen.append((g, f, "".join(cut)))
    return seen + [(0, "x", None), (0, "x", ""), (None, "x", "abc"), (5, None, "abc"), (99, "x", "abc")], known + [(0, "x", None), (1, "y", ""), (None, "x", "abc")]


@pytest.mark.parametrize("rings", [(4,), (1, 2, 4), (2,)])
def test_nearest_truth_is_that_of_all_pairs(spark, tokens, rings):
    seen, known = tokens
    want = {}
    for g, f, raw in set(seen):
        near = sorted((edits(t.lower(), raw.lower()), t) for kg, kf, t in set(known) if raw is not None and t is not None and None not in (g, f) and (kg, kf) == (g, f))
        if near and near[0][0] <= rings[-1]:
            want[g, f, raw] = near[0]
    got = nearest.nearest_truth(spark.createDataFrame(seen, "g int, f string, raw string"), spark.createDataFrame(known, "g int, f string, truth string"), ["g"], ["f"], rings).collect()
    assert len(got) == len(want) > 20 and {(r.g, r.f, r.raw): (r.d, r.truth) for r in got} == want


def fitted(seen, known, most):
    """The same fit in plain Python."""
    truths = collections.defaultdict(set)
    for g, f, t in known:
        truths[g, f].add(t)
    found = {(g, f, r): [(edits(t.lower(), r.lower()), t) for t in truths[g, f] if edits(t.lower(), r.lower()) <= most] for g, f, r in set(seen)}
    found = {k: v for k, v in found.items() if v}
    assigned, before = {k: min(v)[1] for k, v in found.items()}, None
    while True:
        counts = collections.Counter()
        for (_, _, raw), t in assigned.items():
            d = edits(t, raw)
            if not (d > 4 and d / max(len(t), len(raw), 1) > 0.6):
                counts.update(alignment(t, raw))
        if counts == before:
            return assigned, counts
        before = counts
        assigned = {k: min((-round(channel_log_probability(k[2], t, counts), 9), d, t) for d, t in v)[2] for k, v in found.items()}


def test_fit_stands_still_where_plain_python_does(spark):
    rng = random.Random(8)
    truths = ["color", "colon", "cold", "gold", "bold", "rolls"]
    known = [(g, "x", t) for g in range(40) for t in rng.sample(truths, 3)]
    seen = [(g, "x", t.replace("l", rng.choice(["l", "1", "1"])).replace("o", rng.choice(["o", "0"]))[: rng.choice([9, 9, 4])]) for g, _, t in known]
    assignment, counts, rounds = nearest.fit_channel(spark.createDataFrame(seen, "g int, f string, raw string"), spark.createDataFrame(known, "g int, f string, truth string"), ["g"], ["f"])
    want, want_counts = fitted(seen, known, 2)
    assert counts == want_counts and rounds < 20
    assert {(r.g, r.f, r.raw): r.truth for r in assignment.collect()} == want
    nothing = spark.createDataFrame([], "g int, f string, raw string")
    assert nearest.fit_channel(nothing, spark.createDataFrame(known, "g int, f string, truth string"), ["g"], ["f"])[1] == {}


def test_deletions(spark):
    got = set(spark.range(1).select(nearest.deletions(nearest.F.lit("abca"), 2)).first()[0])
    assert got == {"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"}
    assert spark.range(1).select(nearest.deletions(nearest.F.lit(""), 3)).first()[0] == [""]


@pytest.mark.parametrize("reach", [1, 7, 220])
def test_near_places_are_those_of_all_pairs(spark, reach):
    rng = random.Random(reach)
    place = lambda n: [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(1000)) for _ in range(n)] + [(1, None), (2, 0)]
    left, right = place(150), place(40)
    near = [(a, b) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and abs(a[1] - b[1]) <= reach]
    df, marks = spark.createDataFrame(left, "doc int, start long"), spark.createDataFrame(right, "doc int, start long")
    got = [((r.doc, r.start), (r.doc, r.right_start)) for r in proximity.pairs_within(df, marks, ["doc"], "start", reach).collect()]
    assert sorted(got) == sorted(near)
    once = collections.Counter(tuple(r) for r in proximity.with_neighbour(df, marks, ["doc"], "start", reach).collect())
    assert once == collections.Counter(a for a in left if any(a == x for x, _ in near))


def test_a_long_document_is_spread(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000 + "a@b")], "doc_id int, text string")
    words = proximity.words(docs, "doc_id", "text")
    assert words.count() == 50_001 and proximity.with_neighbour(words, words.where("text = 'a@b'"), ["doc_id"], "start", 220).count() == 45
    parts = words.withColumn("cell", proximity.F.floor(proximity.F.col("start") / 220)).repartition(8, "doc_id", "cell").groupBy(proximity.F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(r[1] for r in parts) < 15_000
