"""Links, labels and draws against brute force on small inputs."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from packetloom.llm import ngram_join as N
from packetloom.llm import pii, sp_sample

from .helpers import sentence
from .test_similarity import shingles, variants


def near_copies(n=40):
    """One group of near copies, all of which link, with exact copies among them, beside groups near the threshold."""
    rows = variants(11)
    words = sentence(random.Random(4), 80).split()
    for i in range(n):
        copy = list(words)
        copy[2 * (i % 30)] = f"own{i % 30}"
        rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), ""), (len(rows) + 1, None)]


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"block_sets": 5}])
def test_every_link_is_counted(spark, options):
    rows = near_copies()
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(j != i and bool(s) and 4 * len(s & o) >= 3 * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    assert max(want.values()) == 39
    assert {r.doc_id: r.n_links for r in N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()} == want


def test_t_occurrence_gives_all_links_once():
    for seed in range(10):
        texts = variants(seed, 60) + near_copies(200) if seed % 2 else variants(seed, 60)
        ids: dict = {}
        sets = [np.array(sorted(ids.setdefault(x, len(ids)) for x in shingles(t)), np.uint64) for _, t in texts]
        edges = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j])) > 0}
        links = [tuple(sorted(p)) for p in N.t_occurrence(sets)]
        assert len(links) == len(set(links)) and set(links) == edges
        part = [i % 2 for i in range(len(sets))]
        assert {tuple(sorted(p)) for p in N.t_occurrence(sets, part=part)} == {e for e in edges if part[e[0]] != part[e[1]]}


@pytest.mark.parametrize("later", [2, 5, 50])
def test_labels_reach_every_later_mention(later):
    weights = np.zeros((len(pii.features("")), len(pii.LABELS)))
    weights[0, 0] = 2.0  # a bias to none
    text = "Call +49 (151) 123-4567 now. " + ("filler words " * 8 + "49151 1234567 ") * later + "filler words " * 8 + "77777777"
    base, every = pii.find(text, weights, 4.0)
    assert len(base) == 1 and [text[s:e].strip() for k, s, e in every if (k, s, e) not in base] == ["49151 1234567"] * later


def test_messages_settle_on_a_long_chain():
    unary, pot = np.zeros((60, 2)), 6 * np.eye(2)
    unary[-1] = 0.0, -50.0
    assert pii.propagate(unary, [(i, i + 1, pot) for i in range(59)])[0] == pytest.approx(np.array([1, 0]) + np.tanh(3) ** 59 * 0.5 * np.array([1, -1]) + np.array([-0.5, 0.5]), abs=1e-3)


@pytest.fixture(scope="module")
def vocabulary():
    with open(sp_sample.default_path(), "rb") as f:
        return sp_sample.Vocabulary(f.read(), 0.002)


def test_draws_of_other_paths_follow_their_probabilities(vocabulary):
    for exclude in (1, 3, 60):
        cell = sp_sample.Lattice(vocabulary, " ontree")
        paths = list(cell.paths())
        excluded, n = dict(paths[:exclude]), 6000
        rest = {k: math.exp(v) for k, v in paths if k not in excluded}
        if not rest:
            continue
        draws = [lambda rng: cell.draw_but(rng, excluded)]
        if exclude == 1:
            assert cell.best in excluded
            draws.append(cell.draw_other)
        for draw in draws:
            rng = np.random.default_rng(3)
            got = collections.Counter(draw(rng) for _ in range(n))
            assert {k for k, _ in got} <= set(rest) and all(math.exp(v) == pytest.approx(rest[k], rel=1e-6) for k, v in got)
            counts = {k: c / n for (k, _), c in got.items()}
            assert all(counts.get(k, 0) == pytest.approx(p / sum(rest.values()), abs=0.03) for k, p in rest.items())


def test_draws_of_a_long_stretch_without_spaces_are_draws():
    with open(sp_sample.default_path(), "rb") as f:
        vocabulary = sp_sample.Vocabulary(f.read(), 0.0002)
    word, times = "tree\n", 200
    cell = sp_sample.Lattice(vocabulary, " " + word * times)
    draws = [cell.draw_other(np.random.default_rng(seed)) for seed in range(40)]
    assert cell.best_log < math.log(1e-15)
    assert len({p for p, _ in draws}) == 40 and cell.best not in {p for p, _ in draws}
    assert all(vocabulary.decode(p) == word * times for p, _ in draws)
    # the mean log weight of draws is that of the lattice: entropy from the sums, by places
    mean, total = [0.0], cell.total
    for end in range(1, len(total)):
        mean.append(sum(math.exp(w + total[s] - total[end]) * (mean[s] + w) for s, w in cell.starts(end)))
    logs = [log for _, log in draws]
    assert np.mean(logs) == pytest.approx(mean[-1] - total[-1], abs=4 * np.std(logs) / 40**0.5 + 1e-6)
