"""Neighbours are told apart where they meet: no join brings their signatures, and none of their matches is lost."""

import random

from pyspark.sql import functions as F

from packetloom.llm import line_dedup as L


def test_neighbours_need_no_join_and_lose_no_match(spark, capsys):
    rng = random.Random(4)
    sets = []
    for _ in range(60):
        base = rng.sample(range(1 << 40), rng.randrange(3, 60))
        sets += [sorted({*base[: len(base) - rng.randrange(0, 4)], *rng.sample(range(1 << 40), rng.randrange(0, 4))}) for _ in range(2)]
    sets = [(L.LONG_CLASS << L.HASH_BITS | w for w in s) for s in sets]
    rows = [(i, list(s)) for i, s in enumerate(sets)]
    words, n = F.col("words"), F.size("words")
    rare, single, pairs = L._keys(words, n)
    firsts = spark.createDataFrame(rows, "sid long, words array<long>").select(
        "sid", F.struct(F.col("sid").alias("doc_id"), F.lit(1).alias("line_no"), F.lit(0).cast("long").alias("row_key")).alias("place"), n.alias("n"),
        rare.alias("rare"), single.alias("single"), pairs.alias("pairs"), L.parity(words, False).alias("p"), L.parity(words, True).alias("q"),
    )
    found = L._neighbours(firsts)
    got = {(r.a, r.b) for r in found.collect()}
    like = lambda x, y: 4 * len({*x} & {*y}) >= 3 * len({*x} | {*y})
    want = {(i, i + 1) for i in range(0, len(rows), 2) if rows[i][1] != rows[i + 1][1] and len(rows[i][1]) > 2 < len(rows[i + 1][1]) and like(rows[i][1], rows[i + 1][1])}
    assert len(want) > 20 and want <= got
    found.explain()
    assert "Join" not in capsys.readouterr().out
