"""Queries of nested models, and of metrics with sub-totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import confidence, metrics, nested, rules
from . import derived as D
from .queries import _POINTS, query


def _decided(spark, sf_dir) -> DataFrame:
    return nested.with_folds(rules.decide(D.packets(spark, sf_dir, D.spread_orders(spark, sf_dir))).withColumn("raw_confidence", rules.raw_confidence()), "k")


_FOLD = lambda seed, n: f"('0x' || substr(md5('{seed}:' || k), 1, 8))::BIGINT % {n}"


@query(f"""WITH {D.DECIDED}, f AS (SELECT {_FOLD(0, nested.OUTER)} AS o, {_FOLD(1, nested.INNER)} AS i, (truth = rule_decision)::INT AS y FROM decided),
cells AS (SELECT o, i, count(*) AS n, sum(y) AS hits FROM f GROUP BY ALL),
fits AS (SELECT a.o AS left_outer, b.i AS left_inner FROM (SELECT unnest(range({nested.OUTER})) AS o) a, (SELECT unnest(range({nested.INNER})) AS i) b)
SELECT left_outer::INT AS left_outer, left_inner::INT AS left_inner, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits FROM fits JOIN cells ON o <> left_outer AND i <> left_inner GROUP BY ALL""")
def nested_fold_table(spark, sf_dir):
    """What each of the nested fits learns from: rows and outcomes, from one count per cell."""
    cells = _decided(spark, sf_dir).groupBy("outer", "inner").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("rule_decision")).alias("hits"))
    numbers = lambda n: F.explode(F.array(*map(F.lit, range(n))))
    # a cell is dealt to the fits that don't leave it out: 56 at most
    dealt = cells.withColumn("left_outer", numbers(nested.OUTER)).withColumn("left_inner", numbers(nested.INNER)).where("left_outer <> outer and left_inner <> inner")
    return dealt.groupBy("left_outer", "left_inner").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def _labelled(decided: DataFrame) -> DataFrame:
    age = F.datediff(F.lit(V.RECEIPT_DATE).cast("date"), F.try_to_date("arrival_date", "yyyy-MM-dd"))
    flags = F.when(F.size("risk_flags") == 0, "none").otherwise(F.array_join("risk_flags", "|"))
    return decided.select("sponsor_id", "visa_class", "fee_status", flags.alias("risk_flags"), age.alias("age_days"), F.col("truth").alias("adjudication"), "outer")


@query()
def nested_cross_fit(spark, sf_dir):
    """Per outer fold the Brier scores of both levels: is the rules' decision right, by models that never saw the packet; the sponsors' policy is learned anew for each fold."""
    decided = _decided(spark, sf_dir)
    policy = nested.policy_by_fold(_labelled(decided))
    rows = decided.join(policy, "sponsor_id", "left").select(
        "k", "outer", "inner", (F.col("truth") == F.col("rule_decision")).cast("double").alias("y"), F.col("raw_confidence").alias("raw"),
        F.array(*confidence.calibration_features().values()).alias("x"), nested.fold_flags(F.col("learned")).alias("z"))
    scored = nested.stacked(rows, extra=(F.col("raw"),))
    error = lambda p: F.round(F.avg((F.col(p) - F.col("y")) ** 2), 4)
    return scored.groupBy("outer").agg(F.count("*").alias("n"), error("p_one").alias("brier_one"), error("p_two").alias("brier_two"), F.round(F.avg("y"), 6).alias("accuracy"))


@query()
def dq_model(spark, sf_dir):
    """Per outer fold: how the balanced model of disqualifying flags, which reads no flag and no decision, ranks packets it never saw."""
    decided = _decided(spark, sf_dir)
    features = {n: x for n, x in confidence.calibration_features().items() if n.startswith("src_") or n in ("n_missing", "n_conflicts", "has_untrusted_conflicts", "observed_flags_seen")}
    extra = [F.col("injection_heavy").cast("double"), F.col("positive_waiver_seen").cast("double"), F.col("biometric_seen").cast("double"), F.col("trusted_text_chars") / 500.0, *[(F.col("visa_class") == v).cast("double") for v in V.VISAS]]
    flagged = F.arrays_overlap("risk_flags", F.array(*map(F.lit, V.DISQUALIFYING))).cast("double")
    rows = decided.select("k", "outer", "inner", flagged.alias("y"), F.array(*features.values(), *extra).alias("x"), F.array_repeat(F.array().cast("array<double>"), nested.OUTER).alias("z")).persist()
    fitted = nested.fit_many(rows, [(o, None) for o in range(nested.OUTER)], balanced=True)
    scored = rows.withColumn("p", nested.own_fold(nested.chances(fitted)))
    mean = lambda side: F.round(F.avg(F.when(F.col("y") == side, F.col("p"))), 4)
    return scored.groupBy("outer").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("flagged"), mean(1).alias("p_flagged"), mean(0).alias("p_clear"))


@query(f"""WITH {D.DECIDED} SELECT rule_decision, visa_class, fee_status, grouping(rule_decision) * 4 + grouping(visa_class) * 2 + grouping(fee_status) AS level, count(*) AS n, sum({_POINTS})::BIGINT AS points,
  count(*) FILTER (truth = 'DENIED' AND rule_decision = 'APPROVED') AS false_approvals
FROM decided GROUP BY GROUPING SETS ((rule_decision, visa_class, fee_status), (rule_decision, visa_class), (visa_class, fee_status), (rule_decision), ())""")
def points_by_group(spark, sf_dir):
    """Points by decision, visa and fee, with sub-totals: every grouping from one aggregate, told apart by level."""
    df = rules.decide(D.packets(spark, sf_dir))
    return metrics.points_by(df, "truth", "rule_decision", ["rule_decision", "visa_class", "fee_status"], [("rule_decision", "visa_class", "fee_status"), ("rule_decision", "visa_class"), ("visa_class", "fee_status"), ("rule_decision",), ()])
