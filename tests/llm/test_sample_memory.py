"""A worker keeps each word once, draws in blocks, and turns a block's texts into strings, not a batch's."""

import numpy as np
import pyarrow as pa

from packetloom.llm import sp_sample as S


def vocabulary(alpha: float = S.ALPHA):
    with open(S.default_path(), "rb") as f:
        return S.Vocabulary(f.read(), alpha)


def test_words_are_kept_once():
    s = S.Sampler(vocabulary())
    s.codes([["some", "words", "kept"], ["kept", "once"]])
    kept = {id(w) for w in s.known}
    assert len(kept) == 4 and {id(w) for w in iter(s.stretch)} == kept
    s.memo = 3
    s.codes([["kept", "some"]])
    s.codes([["kept"]])
    assert {id(w) for w in iter(s.stretch)} == {id(w) for w in s.known}
    assert all(s.stretch[i] == " " + w for w, i in s.known.items())


def test_draws_of_a_frequent_stretch_go_in_blocks(monkeypatch):
    text = "banana " * 3000 + "mississippi " * 500 + "banana"
    v = vocabulary(1e-5)  # nearly all paths are alike, so that most choices are drawn
    want = S.Sampler(v).sample(text, 2, 7)
    sizes, draw = [], S.Together.draw
    monkeypatch.setattr(S, "CELLS", 700)
    monkeypatch.setattr(S.Together, "draw", lambda self, rows, keys: sizes.append(len(rows) * (self.reach + 1)) or draw(self, rows, keys))
    got = S.Sampler(v).sample(text, 2, 7)
    assert len(sizes) > 4 and max(sizes) <= 700
    assert [(a.tolist(), *b) for a, *b in got] == [(a.tolist(), *b) for a, *b in want]


def test_blocks_of_a_batch(monkeypatch):
    monkeypatch.setattr(S, "BATCH_LETTERS", 10)
    texts = pa.array(["", None, "äöü", "123456", "x" * 50, "", "12345", "1234", "1"])
    assert S.cuts(texts) == [(0, 4), (4, 5), (5, 8), (8, 9)]
    assert S.cuts(texts[:0]) == [] and S.cuts(pa.array([None, ""])) == [(0, 2)]


def test_room_grows_by_a_quarter():
    p = S.Paths()
    for at in range(7):
        n = p.add(np.arange(4000, dtype=np.int32), np.full(2000, 2), np.full(2000, -1.0), np.full(2000, -2.0))
        assert p.join(n[-2:]).tolist() == [3996, 3997, 3998, 3999]
    assert len(p) == 14_000 and len(p.start) <= 17_500 and len(p.ids) <= 35_000
