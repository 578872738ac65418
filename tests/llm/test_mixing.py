import random

import pytest

from packetloom.llm import mixing as M

from .helpers import DOCS, empty_documents, odd_documents, sentence


def fill(sizes, weights, share=1.5, repeats=2):
    """Targets by sharing the excess again until none is above its limit."""
    budget, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = budget - sum(repeats * sizes[i] for i in range(len(sizes)) if i not in open_)
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > repeats * sizes[i]}
        for i in open_:
            target[i] = left * weights[i] / total
        if not over:
            break
        for i in over:
            target[i] = repeats * sizes[i]
        open_ -= over
    return target


def test_targets_are_the_fixed_point(spark):
    rng = random.Random(2)
    for sizes in ([rng.randrange(0, 1000) for _ in range(12)] + [100_000], [rng.randrange(500, 1000) for _ in range(20)], [0, 0], [7]):
        check_targets(spark, sizes)


def check_targets(spark, sizes):
    totals = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in M.targets(totals).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_taken_comes_near_target_and_reruns_agree(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randrange(1, 40)), "en", rng.choice("aaaab") if i % 3 else "c", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    got = M.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(docs.repartition(5)).collect()))
    for source in "abc":
        ids = {r[0] for r in rows if r[3] == source}
        mine = [r for r in got if r.doc_id in ids]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2
    assert all(r.taken <= 2 * r.size and r.taken % r.size == 0 for r in got)
    repeated = M.mixture(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in repeated} == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_word_count(spark):
    texts = ["", " ", "a", " a b", "a b ", "\x1fa\x0bb\x0c\r\n", "a b", None, "\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.word_count(M.F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 2, 2, 2, 1, 0, 0]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert M.mix(docs).count() == docs.count()
    assert M.mixture(docs).columns == docs.columns
    assert M.mix(empty_documents(spark)).count() == 0 and M.mixture(empty_documents(spark)).count() == 0


def test_rows_without_ids_are_divided(spark):
    """300 rows of one source share a null id: what is taken comes within a document of the target."""
    texts = [" ".join(["word"] * 10) if i % 3 else " ".join(["word", str(i)] * 5) for i in range(300)]
    docs = spark.createDataFrame([(None, t, "a") for t in texts] + [(i, "some words", s) for i, s in enumerate("bc")], "doc_id long, text string, source string")
    rows = M.mix(docs, share=0.5).collect()
    a = [r for r in rows if r.size == 10]
    assert len(a) == 300 and abs(sum(r.taken for r in a) - a[0].target) <= 10
    assert sum(r.taken for r in M.mix(docs, share=0.5).collect()) == sum(r.taken for r in rows)
    assert M.mixture(docs, share=0.5).count() == sum(r.taken // r.size for r in rows if r.taken)


@pytest.mark.parametrize("parts", [1, 6])
def test_mixture_holds_to_its_plan_behind_a_shuffle(spark, parts):
    """Null and repeated ids, whole repeats and clashing names, dealt anew: words taken come within a document of each source's target."""
    rng = random.Random(parts)
    texts = [sentence(rng, rng.randrange(5, 15)) for _ in range(400)]
    rows = [(None if i % 2 else i % 7, t, "ab"[i % 4 == 0]) for i, t in enumerate(texts)] + [(None, texts[1], "a")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    docs = docs.withColumn("size", M.F.lit("x")).withColumn("hash", M.F.lit(1)).withColumn("mix_row", M.F.lit(2)).withColumn("mix_copy", M.F.lit(3))
    aim = {("a" if r.source_size == max(x.source_size for x in plan) else "b"): r.target for plan in [M.mix(docs).collect()] for r in plan}
    got = M.mixture(docs)
    assert got.columns == docs.columns
    words = {r.source: r.n for r in got.groupBy("source").agg(M.F.sum(M.word_count(M.F.col("text"))).alias("n")).collect()}
    assert all(abs(words[s] - aim[s]) <= 15 for s in "ab")
