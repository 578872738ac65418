"""Token counts, personal data, language, segmentations."""

import collections
import itertools
import math

import numpy as np
import pytest

from packetloom.llm import langid, pii, sp_sample, token_count

from .helpers import DOCS, empty_documents, odd_documents

ODD = [
    "", "a", "it's we'LL 'd", "<|endoftext|>x<|endoftext|>", "  two  spaces ", "tab\t\ttab \n\n x", "naïve Ünï 漢字 \U0001f600\U0001f468‍\U0001f469", "x" * 3000, "1234 5678  y\x1c\x1d z\x85", "﻿á ½ ²",
]


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_count.default_path())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in token_count.count_tokens(docs).collect()}
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 512), t[:50]
    assert token_count.count_tokens(odd_documents(spark)).count() == 11
    assert token_count.count_tokens(empty_documents(spark)).count() == 0


def test_whole_tokens_count_one():
    text = open(token_count.default_path(), encoding="utf-8").read()
    whole = token_count.whole_tokens(text)
    assert len(whole) > 40_000
    counter = token_count.Counter(text, [])
    assert all(counter.count(w) == 1 for w in whole[::500] if counter.find(w) == [w])


def slow_spans(text):
    """Base spans by the patterns as the contract writes them."""
    import re

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


PRIVATE = [
    "mail a.b+c@x-y.example.com, b@c.d.e. f@g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111111",
    "+49 (151) 123-4567 or +1 2 +123456789012345678 ++12345678 +1.2.3.4", "5 4 4111111111111111 7", "١٢ 4111 1111", "9" * 500 + ".1.1.1",
]


def test_base_spans_against_the_contract_s_patterns(spark):
    for text in PRIVATE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]:
        assert pii.base_spans(text) == slow_spans(text), text[:80]


def test_field_carries_labels_to_later_mentions(spark):
    weights, agree = pii.train([r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text])
    text = "Call +49 (151) 123-4567 today. " + "filler words " * 30 + "Again: 49151 1234567 or 77777777 then."
    base, every = pii.find(text, weights, agree)
    assert [k for k, *_ in base] == ["phone"] and set(base) <= set(every)
    assert [text[s:e] for k, s, e in every if (k, s, e) not in base] == ["49151 1234567"]
    assert pii.find("numbers 5927243074273351 5927243074273351 5927243074273351", weights, agree)[1] == []
    assert pii.mask("x a@b.cc y", [("email", 2, 8)]) == "x <email> y"


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, pots = rng.normal(size=(4, 3)), [rng.normal(size=(3, 3)) for _ in range(3)]
    edges = [(0, 1, pots[0]), (1, 2, pots[1]), (1, 3, pots[2])]
    p = np.zeros((4, 3))
    for labels in itertools.product(range(3), repeat=4):
        w = math.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(q[labels[i], labels[j]] for i, j, q in edges))
        for i, k in enumerate(labels):
            p[i, k] += w
    assert pii.propagate(unary, edges) == pytest.approx(p / p.sum(1, keepdims=True))


def test_pii_odd_rows(spark):
    rows = pii.find_pii(odd_documents(spark)).collect()
    assert len(rows) == 11 and all(r.n_email == 0 for r in rows)
    assert pii.find_pii(empty_documents(spark)).count() == 0


def test_langid_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    import zlib

    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in got.items())
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_langid_doesn_t_depend_on_the_batch_or_the_block():
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en")] * 30
    model, grams = langid.fit(rows), langid.Grams()
    texts = ["the cat " * 50_000, "", "12 34", "und die katze", "the dog"]
    together = model.predict(grams, texts)
    assert together[0] == ["en", "und", "und", "de", "en"]
    for i, t in enumerate(texts):
        alone = model.predict(grams, [t])
        assert alone[0] == [together[0][i]] and alone[1] == pytest.approx([together[1][i]], abs=1e-6)


def test_langid_odd_rows(spark):
    rows = langid.identify(odd_documents(spark)).collect()
    assert len(rows) == 11 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert langid.identify(empty_documents(spark)).count() == 0
    assert langid.keep_identified(empty_documents(spark)).count() == 0
    kept = langid.keep_identified(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns


@pytest.fixture(scope="module")
def vocabulary():
    with open(sp_sample.default_path(), "rb") as f:
        return sp_sample.Vocabulary(f.read(), 0.002)


def all_paths(vocabulary, text):
    """Every segmentation of a text with the space before it, and its weight."""
    if not text:
        return {(): 0.0}
    out = {}
    for i in range(1, min(len(text), vocabulary.longest) + 1):
        piece = text[:i]
        w = vocabulary.weight.get(piece, vocabulary.unknown if i == 1 else None)
        if w is not None:
            head = (vocabulary.ids[piece],) if piece in vocabulary.ids else vocabulary.fallback(piece)
            for tail, more in all_paths(vocabulary, text[i:]).items():
                out[head + tail] = w + more
    return out


def test_sampling_without_replacement(vocabulary):
    text = "on a tree"
    weights = all_paths(vocabulary, " " + text)
    z = math.log(sum(map(math.exp, weights.values())))
    p = {k: math.exp(w - z) for k, w in weights.items()}
    sampler, n = sp_sample.Sampler(vocabulary), 4000
    first, second, estimate = collections.Counter(), collections.Counter(), 0.0
    for seed in range(n):
        (a, la, ga, ia), (b, lb, gb, ib) = sampler.sample(text, 2, seed)
        a, b = tuple(a.tolist()), tuple(b.tolist())
        assert a != b and ga > gb and math.exp(la) == pytest.approx(p[a], rel=1e-6) and math.exp(lb) == pytest.approx(p[b], rel=1e-6)
        first[a] += 1
        second[b] += 1
        estimate += math.exp(la) / ia + math.exp(lb) / ib
    for k in sorted(p, key=p.get)[-4:]:
        expected = sum(p[q] * p[k] / (1 - p[q]) for q in p if q != k)
        assert first[k] / n == pytest.approx(p[k], abs=0.03) and second[k] / n == pytest.approx(expected, abs=0.03)
    assert estimate / n == pytest.approx(1, abs=0.05)


def test_lattice_sums_and_order(vocabulary):
    for text in (" banana", " 漢字x", "  ක්!", " a\nb\t"):
        want = all_paths(vocabulary, text)
        z = math.log(sum(map(math.exp, want.values())))
        cell = sp_sample.Lattice(vocabulary, text)
        got = list(cell.paths())
        assert len(got) == len(want) and all(w == pytest.approx(min(0, want[k] - z), abs=1e-6) for k, w in got)
        assert [w for _, w in got] == sorted((w for _, w in got), reverse=True) and got[0][1] == pytest.approx(cell.best_log)


def test_all_segmentations_when_there_are_few():
    with open(sp_sample.default_path(), "rb") as f:
        vocabulary = sp_sample.Vocabulary(f.read(), 0.0002)
    got = sp_sample.Sampler(vocabulary).sample("ab", 50, 1)
    assert len(got) == len(all_paths(vocabulary, " ab")) and all(x[3] == 1 for x in got)
    assert len({tuple(x[0].tolist()) for x in got}) == len(got)


def test_round_trip_and_reruns(spark, vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sp_sample.default_path())
    texts = ODD + [r.text for r in odd_documents(spark).collect() if r.text] + ["\x00\x01", "▁ ▁", "<s> </s>", "x " * 50 + "y" * 200]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    rows = sp_sample.encode(docs, samples=3).collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == set(range(len(texts)))
    for r in rows:
        assert library.decode(r.ids) == texts[r.doc_id].replace("▁", " ")
    again = sp_sample.encode(docs.repartition(3), samples=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sp_sample.encode(odd_documents(spark), with_ids=False).where("rank = 1").count() == 11
    assert sp_sample.encode(empty_documents(spark)).count() == 0


def test_more_samples_than_paths():
    """At the default ALPHA, whatever its weight, every path is given once, and the weights are those of brute force."""
    with open(sp_sample.default_path(), "rb") as f:
        vocabulary = sp_sample.Vocabulary(f.read())
    sampler = sp_sample.Sampler(vocabulary)
    for text in ("trees", "a\nb", "漢é", "on a"):
        want = all_paths(vocabulary, " " + text)
        z = math.log(sum(map(math.exp, want.values())))
        got = sampler.sample(text, len(want) + 5, 3)
        assert {tuple(x[0].tolist()) for x in got} == set(want) and len(got) == len(want)
        assert all(x[1] == pytest.approx(min(0, want[tuple(x[0].tolist())] - z), rel=1e-9, abs=1e-9) and x[3] == 1 for x in got)


def test_draws_on_a_long_stretch(vocabulary):
    """Without a space a text is one stretch: the length of its first piece follows the exact shares."""
    text, n = "ab" * 150, 1500
    sampler, cell = sp_sample.Sampler(vocabulary), sp_sample.Lattice(vocabulary, " " + "ab" * 150)
    firsts = collections.Counter(int(sampler.sample(text, 1, seed)[0][0][0]) for seed in range(n))
    back = sp_sample.Lattice(vocabulary, " " + "ab" * 150)
    after = [0.0] * (len(back.text) + 1)  # log sums from the other side
    for start in range(len(back.text) - 1, -1, -1):
        each = [vocabulary.weight[back.text[start:end]] + after[end] for end in range(start + 1, min(len(back.text), start + vocabulary.longest) + 1) if back.text[start:end] in vocabulary.weight]
        after[start] = sp_sample.log_sum(each)
    assert after[0] == pytest.approx(cell.total[-1], rel=1e-9)
    for piece, seen in firsts.items():
        written = vocabulary.text[piece]
        assert seen / n == pytest.approx(math.exp(vocabulary.weight[written] + after[len(written)] - after[0]), abs=0.05)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "." * 200_000, "x\n" * 100_000])
def test_long_texts_without_words(vocabulary, text):
    import time

    began = time.process_time()
    (a, *_), (b, *_) = sp_sample.Sampler(vocabulary).sample(text, 2, 1)
    assert vocabulary.decode(a.tolist()) == vocabulary.decode(b.tolist()) == text and a.tolist() != b.tolist()
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a" * 1_000_000 + "@", "a@" + "." * 1_000_000, "1" * 1_000_000, "+1(" * 300_000, "1." * 500_000, "@" * 1_000_000, "x (at" * 150_000])
def test_pii_in_linear_time(text):
    import time

    weights, agree = pii.train(["write to a@b.cd or call +1 234 567 8901"])
    began = time.process_time()
    pii.find(text, weights, agree)
    assert time.process_time() - began < 5


def test_addresses_are_those_of_the_pattern():
    import random
    import re

    plain, spelled = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[A-Za-z0-9._%+-]+(?: ?[\[(](?:at|AT)[\])] ?|@)[A-Za-z0-9.-]*[A-Za-z0-9]")
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", ".", "@", "@", "_", "-", "1", " ", "(at)", "[at]", " (AT) ", "b.c", "é"]) for _ in range(rng.randrange(1, 16)))
        assert [m.span() for m in plain.finditer(text)] == list(pii.addresses(text, pii.AT, pii.DOMAIN))
        assert [m.span() for m in spelled.finditer(text)] == list(pii.addresses(text, pii.AT_SPELLED, pii.DOMAIN_LIKE))
