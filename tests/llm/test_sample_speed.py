"""Sums of many stretches: only pieces are added up, and lists of texts are looked up as one."""

import numpy as np

from packetloom.llm import sp_sample as S


def vocabulary():
    with open(S.default_path(), "rb") as f:
        return S.Vocabulary(f.read())


def test_beginnings_that_are_no_pieces_are_not_added_up(monkeypatch):
    added, extend = [], S.Together.extend
    monkeypatch.setattr(S.Together, "extend", lambda self, start, size, rows, w, number: added.append(bool((w > 0).all())) or extend(self, start, size, rows, w, number))
    v = vocabulary()
    words = [x[:12] for x in (" understandings", " mississippis12", " zzqjxwkwkwkwkw", " \u00fcberm\u00e4\u00dfiggro")]
    t = S.Together(v, words)
    assert all(added)
    ids, size, log, rest = t.best_paths()
    assert t.fine.tolist() == [True, True, False, True]  # the third is worked on by Lattice alone
    for x, p, lo, re, fine in zip(words, np.split(ids, np.cumsum(size)[:-1]), log, rest, t.fine):
        if not fine:
            continue
        one = S.Lattice(v, x)
        assert tuple(p.tolist()) == one.best and abs(lo - one.best_log) < 1e-9 and abs(re - one.others_log) < 1e-9


def test_codes_of_lists_empty_ones_among_them():
    s = S.Sampler(vocabulary())
    lists = [["a", "word", "a"], [], ["other"], ["word", "new"], []]
    got = s.codes(lists)
    assert [[s.stretch[c][1:] for c in x] for x in got] == lists
    assert s.codes([]) == [] and [x.tolist() for x in s.codes(lists)] == [x.tolist() for x in got]
