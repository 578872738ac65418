import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, an extra column with a clashing name."""
    rng = random.Random(3)
    long = sentence(rng, 5000)
    rows = [
        (1, None, None, None, None), (None, "some words here", "en", "a", 3), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 4),
        (4, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (6, "x", "fr", None, 1), (6, "x", "fr", None, 1),
        (7, "12345 !!", "en", "b", 8), (8, "Ünïcode ﬃ 漢字 \U0001f600 text\r\nwith lines\x0b", "de", "c", 9), (None, None, None, None, None),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("k", F.lit("k")).withColumn("source_size", F.lit(0))


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
