"""Policies and models learned from labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from .metrics import points
from .ranking import rows_where


def sponsor_policy(df: DataFrame, keys: list[str] | None = None, least_clean: int = 3, least_causal: int = 3, public: tuple[str, ...] = V.PUBLIC_REVOKED) -> DataFrame:
    """Sponsors whose non-diplomatic packets are all denied though diplomatic ones aren't: revoked, as the labels show.

    Rows: sponsor_id, visa_class, fee_status, risk_flags ('none' if none), age_days, adjudication. A clean packet is paid,
    unflagged and fresh. keys: learn within each of these groups (folds). One pass of conditional counts.
    """
    keys = keys or []
    c = F.col
    dip = c("visa_class") == "DIP-1"
    other = ~c("visa_class").isin("DIP-1", "TRANSIT-7")
    clean = other & (c("fee_status") == "paid") & (c("risk_flags") == "none") & (c("age_days") <= V.STALE_DAYS)
    denied = c("adjudication") == "DENIED"
    counts = df.where(~c("sponsor_id").isin(*public)).groupBy(*keys, "sponsor_id").agg(
        F.count_if(clean).alias("clean_non_dip"), F.count_if(clean & denied).alias("clean_denied"), F.count_if(other).alias("non_dip"), F.count_if(other & denied).alias("non_dip_denied"),
        F.count_if(dip).alias("dip"), F.count_if(dip & denied).alias("dip_denied"), F.count("*").alias("total"),
    )
    by_clean = (c("clean_non_dip") >= least_clean) & (c("clean_non_dip") == c("clean_denied"))
    by_cause = (c("non_dip") >= least_causal) & (c("non_dip") == c("non_dip_denied"))
    kept = counts.where((c("dip") > 0) & (c("dip_denied") == 0) & (by_clean | by_cause))
    return kept.withColumn("mode", F.when(by_clean, "clean").otherwise("causal_exception"))


def fold_survival(df: DataFrame, folds: int, required: int) -> DataFrame:
    """(sponsor_id, survived): sponsors that are learned with each fold left out, at least `required` times.

    Rows carry fold; each is copied to the folds that it isn't in, so all leave-one-out runs are one aggregate.
    """
    copies = df.withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("left_out <> fold")
    learned = sponsor_policy(copies, ["left_out"])
    return learned.groupBy("sponsor_id").agg(F.count("*").alias("survived")).where(F.col("survived") >= required)


def cross_fit(df: DataFrame, features: list[str], label: str, fold: str, make):
    """Out-of-fold class probabilities: for each fold, make() is fitted on the others and transforms it. Adds proba (array)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    parts = []
    for (k,) in sorted(data.select(fold).distinct().collect()):
        model = make().setFeaturesCol("features").setLabelCol(label).fit(data.where(F.col(fold) != k))
        parts.append(model.transform(data.where(F.col(fold) == k)).withColumn("proba", vector_to_array("probability")).drop("rawPrediction", "probability", "features", "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boosted_probabilities(df: DataFrame, train: DataFrame, features: list[str], label: str, seeds: tuple[int, ...] = (1, 2, 3), trees: int = 20) -> DataFrame:
    """Mean class probabilities of seeded ensembles of one-against-rest boosted trees, normalised. train=None: no model, proba is null."""
    if train is None:
        return df.withColumn("proba", F.lit(None).cast("array<double>"))
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    out, fitted = assembler.transform(df), assembler.transform(train)
    for k, name in enumerate(V.LABELS):
        for seed in seeds:
            target = fitted.withColumn("_y", (F.col(label) == name).cast("double"))
            model = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=trees, maxDepth=4, seed=seed).fit(target)
            out = model.transform(out).withColumn(f"_p{k}_{seed}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    mean = [sum((F.col(f"_p{k}_{s}") for s in seeds[1:]), F.col(f"_p{k}_{seeds[0]}")) / len(seeds) for k in range(len(V.LABELS))]
    total = mean[0] + mean[1] + mean[2]
    return out.withColumn("proba", F.array(*[F.when(total > 0, m / total).otherwise(1 / 3) for m in mean])).drop("features", *[f"_p{k}_{s}" for k in range(3) for s in seeds])


def impute_missing(df: DataFrame, field: str, train: DataFrame | None, features: list[str], allowed: tuple[str, ...], trees: int = 50) -> DataFrame:
    """Missing values of a closed field by a forest fitted on rows that have one; other values are never touched. train=None: nothing is filled."""
    from ..functions.text import missing_for_imputer

    if train is None:
        return df
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    rows = assembler.transform(train.where(F.col(field).isin(*allowed)))
    index = StringIndexer(inputCol=field, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    model = RandomForestClassifier(featuresCol="_features", labelCol="_y", predictionCol="_k", numTrees=trees, seed=1).fit(index.transform(rows))
    lost = IndexToString(inputCol="_k", outputCol="_v", labels=index.labels).transform(model.transform(assembler.transform(df.where(missing_for_imputer(F.col(field))))))
    filled = lost.withColumn(field, F.col("_v")).select(*df.columns)
    return df.where(~missing_for_imputer(F.col(field))).unionByName(filled)


def fit_gate(df: DataFrame, features: list[str], base: str, engine: str, truth: str, reg: float = 0.05):
    """A weighted logistic model on rows where base and engine differ in points: is base the better one, weighted by how much.

    Returns a function that adds gate_p (null without a model: fewer than two outcomes) to rows with the features.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gain = points(F.col(truth), F.col(base)) - points(F.col(truth), F.col(engine))
    rows = rows_where(df, (F.col(base) != F.col(engine)) & (gain != 0), *map(F.col, features), (gain > 0).cast("double").alias("label"), F.abs(gain).cast("double").alias("weight"))
    outcomes = rows.agg(F.countDistinct("label")).first()[0]
    if outcomes < 2:
        return lambda new: new.withColumn("gate_p", F.lit(None).cast("double"))
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", weightCol="weight", regParam=reg, maxIter=50, predictionCol="_y", probabilityCol="_p", rawPredictionCol="_z")]
    model = Pipeline(stages=steps).fit(rows)
    return lambda new: model.transform(new).withColumn("gate_p", vector_to_array("_p")[1]).drop("_raw", "_x", "_y", "_p", "_z")


def gate_threshold(scored: DataFrame, base: str, engine: str, truth: str, thresholds: tuple[float, ...] = (0.35, 0.45, 0.55, 0.65, 0.75, 0.85)) -> float:
    """The threshold on gate_p with the most points, then the fewest false approvals, then the highest: one pass for all."""
    act = lambda t: F.when((F.col(base) != F.col(engine)) & (F.coalesce("gate_p", F.lit(0.0)) < t), F.col(engine)).otherwise(F.col(base))
    sums = [x for i, t in enumerate(thresholds) for x in (F.sum(points(F.col(truth), act(t))).alias(f"p{i}"), F.count_if((F.col(truth) == "DENIED") & (act(t) == "APPROVED")).alias(f"f{i}"))]
    got = scored.agg(*sums).first()
    return max(thresholds, key=lambda t: (got[f"p{thresholds.index(t)}"] or 0, -(got[f"f{thresholds.index(t)}"] or 0), t))
