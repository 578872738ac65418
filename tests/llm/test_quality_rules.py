"""Quality rules against counting in Python."""

import collections
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import quality_rules as Q
from packetloom.llm.queries import op12_quality_rules

from .helpers import empty_documents, odd_documents, sentence

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [spark_hash(w) % Q.BUCKETS for w in words] + [spark_hash(*p) % Q.BUCKETS for p in zip(words, words[1:])]


def expected(rows, trusted):
    raw, good = collections.Counter(), collections.Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i in trusted:
            good.update(grams(text))
    n, t = sum(raw.values()), sum(good.values())

    def ratio(b):
        p = (raw[b] + 1) / (n + Q.BUCKETS)
        return round(1_000_000 * math.log((good[b] + Q.PRIOR * p) / ((t + Q.PRIOR) * p)))

    out = []
    for i, text in rows:
        g = grams(text)
        score = sum(map(ratio, g)) / max(len(g), 1) / 1_000_000
        out.append((i, *base(text), round(score, 9), not base(text)[-1] and score >= Q.LEAST_SCORE))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def got(df):
    assert df.columns == ["doc_id", *BASE, "score", "kept"]
    return in_order((*r[:-2], round(r.score, 9), r.kept) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, sentence(rng, rng.choice([3, 12, 60]))) for i in range(60)]
    out += [(60 + i, re.sub(r"(\w+)", r"\1%%%", sentence(rng, 40))) for i in range(10)]
    line = sentence(rng, 7)
    return out + [(70, f"{line}\n{line}\n \n \n{line} x"), (71, "a " * 30), (72, "a b c d e f a b c d e g " + sentence(rng, 50)), (73, " ".join("abcde" * 3)), (74, " wide spaces # and \x1c marks | " * 2), (75, sentence(rng, 3000))]


def test_every_column_equals_brute_force(spark, rows):
    trusted = [*range(0, 50), 50, 50, 999, None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(t,) for t in trusted], "doc_id long")
    want = in_order(expected(rows, set(trusted) - {None}))
    assert got(Q.assess(docs, ids)) == want
    score = {r[0]: r[-2] for r in want}
    assert max(score[i] for i in range(60, 70)) < min(score[i] for i in range(50))


def test_a_bounded_number_of_trusted_documents_is_used(spark, rows):
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.range(40).select(F.col("id").alias("doc_id"))
    used = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id")).limit(7).collect()}
    assert got(Q.assess(docs, ids, trusted_docs=7)) == in_order(expected(rows, used))


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = spark.createDataFrame([(4,), (0,), (None,)], "doc_id long")
    assert got(Q.assess(docs, ids)) == in_order(expected(rows, {4, 0}))
    nobody = got(Q.assess(docs, ids.where("false")))
    assert {r[-2] for r in nobody} == {0.0} and [r[-1] for r in nobody] == [not r[-3] for r in nobody]
    assert Q.assess(empty_documents(spark), ids).count() == 0


def test_labelled_texts_are_told_apart(spark):
    """On given documents: of the labelled ones, none of high quality goes by the score, and few others stay."""
    path = "/root/testdata/sf0.01"
    found = op12_quality_rules(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r.quality: r.share for r in found.collect()}
    assert share[1] > 0.99 and share[0] < 0.2
