"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document has a 60-bit hash of its id. Words are summed by source and leading hash bits; a running sum over the
buckets of a source finds the bucket in which its budget ends, and only that bucket is split by the next bits, until it
is one hash value. A document is taken once more when its hash lies below its source's threshold: the budgets are
nested (a smaller one takes a subset), reruns agree, and no documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Bits of a hash that each level of the histogram resolves; five levels make the 60 bits.
LEVEL_BITS = 12
LEVELS = 5
HASH_BITS = LEVEL_BITS * LEVELS
#: The per-source table is broadcast up to this many rows (about 100 bytes each); beyond it, joins are shuffled.
BROADCAST_ROWS = 50_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    ends = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.size(parts).cast("long") - ends


def row_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text, as a long (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def second_hash(text: Column, row: Column) -> Column:
    """60 bits of a hash of a row's text and of its number as the files are read, which rereading them gives again."""
    return F.shiftrightunsigned(F.xxhash64(text, row), 64 - HASH_BITS)


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """Adds target to (source, source_size): share of all sizes by weight, at most repeats times the source's size.

    The excess above a limit is shared again by weight until none is above. In closed form: with the sources in order
    of limit per weight, those up to some place are at their limits and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * repeats)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.select(
        "source", "source_size", "weight", "cap",
        (F.sum("cap").over(up_to) - F.col("cap")).alias("caps_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight")).alias("weights_from"),
        (F.sum(F.col("source_size").cast("double")).over(everything) * share).alias("budget"),
    )
    ranked = ranked.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("budget") - F.col("caps_before")) / F.col("weights_from"))
    # Fullness is a prefix of this order: the sums that hold for the rest are those of its first member.
    ranked = ranked.withColumn("left_over", F.max(F.when(~F.col("full"), F.col("budget") - F.col("caps_before"))).over(everything))
    ranked = ranked.withColumn("left_weights", F.max(F.when(~F.col("full"), F.col("weights_from"))).over(everything))
    share_of = F.col("left_over") * F.col("weight") / F.col("left_weights")
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(share_of, F.col("cap"))).alias("target"))


class Plan:
    """What is taken of each source: `whole` times everything, and once more below the hash `low` (and one document that closes the gap)."""

    def __init__(self, sized: DataFrame, weights: tuple, share: float, repeats: int):
        """sized: source, size, hash, hash2."""
        self.sized = sized
        aim = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
        whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
        aim = aim.withColumn("whole", whole).withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size"))
        # low, low2: the prefixes of the hashes below which all is taken; gap: the words that are left after that
        zero = F.lit(0).cast("long")
        self.state = materialize(aim.select("source", "source_size", "target", "whole", "gap", zero.alias("low"), zero.alias("low2")), "mix-state")
        self.small = F.broadcast if self.state.count() <= BROADCAST_ROWS else (lambda df: df)
        self.refine_all("hash", "low", sized)
        # more than one row of the boundary hash are split by their second hash
        edge = self.join(sized, F.col("source"), ["low"]).where("hash = mix_low and size > 0").select(*sized.columns)
        shared = edge.groupBy("source").agg(F.count("*").alias("rows")).where("rows > 1")
        if not shared.isEmpty():
            self.refine_all("hash2", "low2", materialize(edge, "mix-edge"))
        self.close_gaps()

    def join(self, df: DataFrame, source: Column, names: list[str]) -> DataFrame:
        """df with columns of its source's state, as mix_<name>; null sources meet as well."""
        state = self.state.select(F.col("source").alias("mix_source"), *[F.col(n).alias(f"mix_{n}") for n in names])
        return df.join(self.small(state), source.eqNullSafe(F.col("mix_source")))

    def refine_all(self, name: str, low: str, rows: DataFrame) -> None:
        for level in range(1, LEVELS + 1):
            self.refine(name, low, rows, LEVEL_BITS * (LEVELS - level))

    def refine(self, name: str, low: str, rows: DataFrame, left: int) -> None:
        """Split each source's boundary range into buckets of `left` more bits and find the one in which the budget ends."""
        inside = self.join(rows, F.col("source"), [low]).where(F.shiftright(name, left + LEVEL_BITS) == F.col(f"mix_{low}"))
        sums = inside.groupBy("source", F.shiftright(name, left).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.select(F.col("source").alias("s"), "bucket", F.sum("words").over(upto).alias("upto"))
        keys = ["source", "source_size", "target", "whole", "gap", "low", "low2"]
        fit = self.state.join(sums, self.state["source"].eqNullSafe(F.col("s")), "left").groupBy(*keys).agg(
            F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("fits"),
            F.min(F.when(F.col("upto") > F.col("gap"), F.col("bucket"))).alias("edge"),
        )
        # without a bucket that doesn't fit, the threshold is the end of the range
        end = F.shiftleft(F.col(low) + 1, LEVEL_BITS)
        new = {k: F.col(k) for k in keys} | {"gap": F.col("gap") - F.coalesce("fits", F.lit(0)), low: F.coalesce("edge", end)}
        self.state = materialize(fit.select(*[c.alias(k) for k, c in new.items()]), "mix-state")

    def below(self, size: Column) -> Column:
        """Whether a row joined with low and low2 lies below its source's thresholds."""
        return (F.col("hash") < F.col("mix_low")) | ((F.col("hash") == F.col("mix_low")) & (F.col("hash2") < F.col("mix_low2")))

    def close_gaps(self) -> None:
        rest = self.join(self.sized, F.col("source"), ["low", "low2", "gap"]).where(~self.below(F.col("size")) & (F.col("size") > 0))
        nearest = F.min(F.struct(F.abs(F.col("size") - F.col("mix_gap")).alias("miss"), F.col("hash"), F.col("size"), F.col("hash2"), F.col("mix_gap").alias("gap")))
        closer = rest.groupBy("source").agg(nearest.alias("x")).where("x.miss < x.gap")
        closer = closer.select(F.col("source").alias("s"), F.col("x.hash").alias("closer"), F.col("x.hash2").alias("closer2"))
        self.state = materialize(self.state.join(closer, self.state["source"].eqNullSafe(F.col("s")), "left").drop("s"), "mix-state")

    def times(self, df: DataFrame, source: Column, size: Column) -> DataFrame:
        """df (with hash and hash2) with mix_source_size, mix_target and mix_times, how often each row is taken."""
        joined = self.join(df, source, ["source_size", "target", "whole", "low", "low2", "closer", "closer2"])
        again = self.below(size) | ((F.col("hash") == F.col("mix_closer")) & (F.col("hash2") == F.col("mix_closer2")))
        return joined.withColumn("mix_times", F.when(size > 0, F.col("mix_whole") + F.coalesce(again, F.lit(False)).cast("long")).otherwise(0))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"), row_hash(F.col(id_col)).alias("hash"),
        second_hash(F.col(text_col).cast("string"), F.monotonically_increasing_id()).alias("hash2"),
    )
    return materialize(sized, "mix-sized")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    Documents are taken whole: every one floor(target / source_size) times, and once more below the source's hash
    threshold; of the rest, the one whose size is nearest to what is still missing closes the gap, if that helps.
    Null text has size 0; a null source is a source of its own, last in order; null ids hash like the empty text; rows
    with one id, repeated whole or not, are told apart by their texts and their places in the files. Other columns aren't read. An empty table gives no rows.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    taken = Plan(sized, weights, share, repeats).times(sized, F.col("source"), F.col("size"))
    return taken.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_times")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs in the mix, each as often as it is taken, with the columns of docs. Texts aren't shuffled.

    Nulls, ties and repeated rows are treated as in mix(). Rows are written once beside their hashes, so that what the
    plan saw of a row is what is taken of it, wherever docs come from. Columns may have any names; an empty table, or one
    without words, gives no rows.
    """
    text = docs[text_col].cast("string")
    rows = materialize(docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"), docs[source_col].cast("string").alias("source"), word_count(text).alias("size"),
        row_hash(docs[id_col]).alias("hash"), second_hash(text, F.monotonically_increasing_id()).alias("hash2"),
    ), "mix-rows")
    taken = Plan(rows.select("source", "size", "hash", "hash2"), weights, share, repeats).times(rows, F.col("source"), F.col("size")).where("mix_times > 0")
    return taken.select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_times"))).alias("mix_copy")).select("mix_row.*")


#: DuckDB SQL for op8: the same threshold by a sorted running sum.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM totals),
summed AS (
  SELECT *, sum(cap) OVER w - cap AS caps_before, sum(weight) OVER () - sum(weight) OVER w + weight AS weights_from,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, cap / weight <= (budget - caps_before) / weights_from AS is_full FROM summed),
shared AS (
  SELECT *, max(CASE WHEN NOT is_full THEN budget - caps_before END) OVER () AS left_over,
         max(CASE WHEN NOT is_full THEN weights_from END) OVER () AS left_weights FROM marked),
aim AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(left_over * weight / left_weights, cap) END AS target FROM shared),
plan AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole,
         target - CAST(floor(target / greatest(source_size, 1)) AS BIGINT) * source_size AS budget FROM aim),
run AS (
  SELECT s.doc_id, s.size, s.hash, p.source, p.source_size, p.target, p.whole, p.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) AS upto
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
low AS (
  SELECT *, upto <= budget AS below, budget - coalesce(max(CASE WHEN upto <= budget THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM run),
closer AS (
  SELECT source, hash AS c_hash, size AS c_size FROM low WHERE NOT below AND size > 0
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), hash, size) = 1 AND abs(size - gap) < gap)
SELECT l.doc_id, l.size, l.source_size, l.target,
       CAST(l.size * (l.whole + CASE WHEN l.below OR (l.hash = c.c_hash AND l.size = c.c_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM low l LEFT JOIN closer c ON l.source IS NOT DISTINCT FROM c.source
"""
