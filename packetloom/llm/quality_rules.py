"""Quality rules: counts of each text, and the log-likelihood ratio of its hashed n-grams (DataFrame functions only).

Two multinomials over buckets of hashed words and word pairs are counted, one over all documents, one over trusted
ones. A document's score is the mean, over its n-grams, of the log ratio of their probabilities; documents below a fixed
threshold go. Ratios are whole numbers of 10^-6 nats, so sums don't depend on their order and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Buckets of hashed n-grams: the two multinomials and the table of ratios have so many entries, whatever the input.
BUCKETS = 1 << 14
#: Documents whose mean log ratio per n-gram lies below this (nats) go.
LEAST_SCORE = -0.1
#: Weight of the raw corpus in the trusted multinomial, in n-grams: with few trusted texts, ratios shrink to zero.
PRIOR = 4 * BUCKETS
MICRO = 1_000_000
# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
#: The trusted multinomial is fitted on so many trusted ids at most (those with the smallest hashes): a table of this size is broadcast.
TRUSTED_DOCS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` words that the text holds twice or more. Windows are compared by 64-bit hashes: two of a text's N collide with odds of N^2 / 2^65."""
    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        # a window covers `size` words, or those up to the next one
        steps = let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(size), b - a)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(covered(x)))

    return let(words, lambda w: F.when(F.size(w) > size, of(w)).otherwise(F.lit(0).cast("long")))


def bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def ngram_counts(docs: DataFrame, trusted: DataFrame, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """bucket, n, trusted: n-grams of docs (doc_id, text) by bucket, over all and over the documents whose ids trusted (doc_id) lists, of which trusted_docs are used.

    At most BUCKETS rows leave a task; texts aren't shuffled.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(trusted_docs)
    marked = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    words = marked.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), words_of(F.col("text")).alias("words"))
    pairs = words.select("t", F.explode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("x")).select("t", "x.a", "x.b")
    both = F.array(bucket(F.col("a")), F.when(F.col("b").isNotNull(), bucket(F.col("a"), F.col("b"))))
    return pairs.select("t", F.explode(both).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("trusted"))


def log_ratios(counts: dict[int, tuple[int, int]]) -> list[int]:
    """Per bucket the log of trusted over raw probability, in 10^-6 nats, from {bucket: (n, trusted)}. Zero everywhere if nothing is trusted."""
    raw, good = sum(n for n, _ in counts.values()), sum(t for _, t in counts.values())
    out = []
    for b in range(BUCKETS):
        n, t = counts.get(b, (0, 0))
        p = (n + 1) / (raw + BUCKETS)
        out.append(round(MICRO * math.log((t + PRIOR * p) / ((good + PRIOR) * p))))
    return out


def ratio_sum(words: Column, ratios: list[int]) -> Column:
    """Sum of the ratios of the words and pairs of a text."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<long>")  # folded to one constant
    pair = lambda w, i, x: F.when(i + 1 < F.size(w), F.get(table, bucket(x, F.get(w, i + 1)))).otherwise(0)
    each = let(words, lambda w: F.transform(w, lambda x, i: F.get(table, bucket(x)) + pair(w, i, x)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)


def assess(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    trusted lists the ids (doc_id) of trusted documents, unknown ones included; at most trusted_docs of them are used;
    rows that share a listed id are all trusted. base_failed: under 10 words, or more than a fifth of them in repeated windows. kept: not base_failed, and
    the score isn't below `least`. Null, empty and white texts have no words, fail and have score 0; null ids are never
    trusted; without trusted documents every score is 0; other columns aren't read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = {r.bucket: (r.n, r.trusted) for r in ngram_counts(docs, trusted.select(F.col("doc_id").cast("long").alias("doc_id")), trusted_docs).collect()}  # BUCKETS rows at most
    text, words, n = F.coalesce("text", F.lit("")), F.col("words"), F.col("n_words")
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    rows = rows.select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"), ratio_sum(words, log_ratios(counts)).alias("sum"),
    )
    grams = F.greatest(2 * n - 1, F.lit(1))
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (F.col("sum") / grams / MICRO).alias("score"), (~failed & (F.col("sum") >= round(least * MICRO) * grams)).alias("kept"),
    )
