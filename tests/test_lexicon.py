"""Lexicon search against scoring every pair."""

import collections
import math
import random

import pytest

from packetloom.functions.similarity import alignment
from packetloom.operators import lexicon as L


def words(rng, n):
    return {"".join(rng.choice("abcdr") for _ in range(rng.randrange(9))) for _ in range(n)}


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_scoring_every_pair(seed):
    rng = random.Random(seed)
    shares = L.priors({w: rng.choice([1, 1, 5, 200]) for w in words(rng, 60)})
    counts = collections.Counter()
    for _ in range(30 * (seed % 3)):
        a, b = rng.choice(sorted(shares)), rng.choice(sorted(shares))
        counts.update(alignment(a, b))
    costs, trie = L.EditCosts(counts), L.Lexicon(shares)
    for token in [*words(rng, 25), "", "zzz"]:
        want = sorted((costs.cost(w, token) - p, w) for w, p in shares.items())[:3]
        got = trie.search(token, costs, 3)
        assert [w for _, w in got] == [w for _, w in want] and [s for s, _ in got] == pytest.approx([-s for s, _ in want])
    assert L.Lexicon({}).search("a", costs) == []


def test_costs_are_cheapest_over_alignments():
    costs = L.EditCosts({("S", "l", "1"): 50, ("M", "a", "a"): 100})

    def cheapest(word, token):
        if not word and not token:
            return 0.0
        ways = []
        if word:
            ways.append(costs.of("D", word[0], None) + cheapest(word[1:], token))
        if token:
            ways.append(costs.of("I", None, token[0]) + cheapest(word, token[1:]))
        if word and token:
            ways.append(costs.of("S", word[0], token[0]) + cheapest(word[1:], token[1:]))
        return min(ways)

    for w, t in [("al", "a1"), ("", "ab"), ("abc", ""), ("all", "1a1"), ("abca", "acb")]:
        assert costs.cost(w, t) == pytest.approx(cheapest(w, t))
    assert costs.of("S", "l", "1") < costs.of("S", "l", "2") and min(costs.match, costs.of("S", "l", "1"), costs.of("I", None, "x")) > 0


def test_only_clear_words_are_given(spark):
    lexicon = spark.createDataFrame([("Solix", 5), ("solix", 5), ("solex", 1), ("tekul", 3), (None, 9)], "word string, n long")
    tokens = spark.createDataFrame([(t,) for t in ("SOLIX", "SOLIX", "sol1x", "solyx", "tekuI", None, "qqqqqqqqqqqqqq")], "raw string")
    got = {r.raw: (r.word, r.lead) for r in L.correct(tokens, "raw", lexicon, {("S", "i", "1"): 50, ("M", "s", "s"): 500}, 3.0).collect()}
    assert got["SOLIX"][0] == "solix" and got["sol1x"][0] == "solix" and got["tekuI"][0] == "tekul" and "solyx" not in got
    assert all(lead >= 3.0 for _, lead in got.values())
    one = L.correct(tokens, "raw", lexicon.where("word = 'tekul'")).collect()
    assert {r.word for r in one} == {"tekul"} and all(r.lead is None for r in one) and len(one) == 5
    assert L.correct(tokens, "raw", lexicon.where("false")).count() == 0


def test_a_boundless_lexicon_is_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        L.correct(spark.createDataFrame([("a",)], "raw string"), "raw", spark.range(4).selectExpr("cast(id as string) word", "id n"))
    assert math.isclose(sum(math.exp(p) for p in L.priors({"a": 3, "b": 1}).values()), 1)
