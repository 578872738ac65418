"""Nested cross-fitting: all logistic fits of all folds share every scan of the rows.

Rows carry an outer and an inner fold. Fit (o, i) learns from the rows that are neither in outer fold o nor in inner
fold i, fit (o, None) from all outside o. One pass adds up the gradients and Hessians of all fits, each at its own
coefficients, so 64 fits cost as many scans as one. What the driver sees is a gradient and a Hessian per fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confidence import logit
from .learning import sponsor_policy
from .metrics import assign_folds

OUTER, INNER = 8, 7
#: Inverse ridge of the fits, most Newton steps, and the step below which a fit stands still.
C, STEPS, STILL = 0.3, 40, 1e-10
#: Partial sums of tasks are added in so many groups per fit before the driver adds those.
SUM_GROUPS = 16

Fit = tuple[int, int | None]


def all_fits(outer: int = OUTER, inner: int = INNER) -> list[Fit]:
    return [(o, i) for o in range(outer) for i in range(inner)] + [(o, None) for o in range(outer)]


def with_folds(df: DataFrame, key: str, outer: int = OUTER, inner: int = INNER) -> DataFrame:
    """Adds outer and inner: two independent hashes of the key."""
    df = assign_folds(df, key, outer, 0).withColumnRenamed("fold", "outer")
    return assign_folds(df, key, inner, 1).withColumnRenamed("fold", "inner")


def _design(batch: pa.RecordBatch, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x (1 + common features), rows x folds x features that differ by outer fold)."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    z = batch.column("z").flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, folds, -1)
    return np.column_stack([np.ones(n), x]), z


def _chance(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))


def class_weights(rows: DataFrame, fits: list[Fit]) -> dict[Fit, tuple[float, float]]:
    """Per fit the weights of outcomes 0 and 1 that make both weigh the same, from rows with their counts n; counts of (outer, inner, y) are all that is collected."""
    counts = {(r.outer, r.inner, int(r.y)): r.rows for r in rows.groupBy("outer", "inner", "y").agg(F.sum("n").alias("rows")).collect()}
    out = {}
    for o, i in fits:
        by = [sum(n for (a, b, y), n in counts.items() if a != o and b != i and y == side) for side in (0, 1)]
        out[o, i] = tuple(sum(by) / (2 * n) if n else 0.0 for n in by)
    return out


def fit_many(rows: DataFrame, fits: list[Fit], folds: int = OUTER, c: float = C, balanced: bool = False) -> dict[Fit, np.ndarray]:
    """Coefficients (intercept first) of every ridge logistic fit, by Newton steps over rows (y, outer, inner, x, z).

    x: array of features; z: an array per outer fold of the features that may differ by it (lists learned outside that
    fold), empty arrays if there are none. Minimised is half the squared coefficients, the intercept's aside, plus c
    times the weighted log loss. A step that doesn't lower it is halved. balanced: both outcomes weigh the same in
    every fit. Rows whose y is null are left out. Equal rows are counted once, before the steps, and the counts are
    kept for the scans: steps take as long as the rows differ. Without rows all are 0.
    """
    rows = rows.where("y is not null").groupBy("y", "outer", "inner", "x", "z").agg(F.count("*").alias("n")).persist()
    try:
        return _newton(rows, fits, folds, c, balanced)
    finally:
        rows.unpersist()


def _newton(rows: DataFrame, fits: list[Fit], folds: int, c: float, balanced: bool) -> dict[Fit, np.ndarray]:
    """The steps of fit_many(), over (y, outer, inner, x, z, n), n being how often a row is there."""
    first = rows.first()
    if first is None:
        return {f: np.zeros(1) for f in fits}
    width = 1 + len(first.x) + len(first.z[0])
    weights = class_weights(rows, fits) if balanced else {f: (1.0, 1.0) for f in fits}
    at = {f: np.zeros(width) for f in fits}
    best: dict[Fit, tuple] = {}
    step = {f: np.zeros(width) for f in fits}
    still: set[Fit] = set()
    for _ in range(STEPS):
        open_ = [f for f in fits if f not in still]
        if not open_:
            break
        sums = _sums(rows, {f: at[f] for f in open_}, weights, folds, width)
        for f in open_:
            loss, slope, curve = sums[f]
            free = np.append(0.0, np.ones(width - 1))
            value = c * loss + 0.5 * (free * at[f] ** 2).sum()
            if f in best and value > best[f][0] + 1e-12 * abs(best[f][0]):
                step[f] = step[f] / 2
                at[f] = best[f][1] - step[f]
            else:
                best[f] = (value, at[f])
                step[f] = np.linalg.solve(c * curve + np.diag(free) + 1e-12 * np.eye(width), c * slope + free * at[f])
                at[f] = at[f] - step[f]
            if np.abs(step[f]).max() < STILL:
                still.add(f)
    return at


def _sums(rows: DataFrame, at: dict[Fit, np.ndarray], weights: dict, folds: int, width: int) -> dict[Fit, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, Hessian) of every fit at its coefficients, in one scan."""
    fits = list(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), 1 + width + width * width))
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, z = _design(batch, folds)
            y, outer, inner, often = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("y", "outer", "inner", "n"))
            designs = {o: np.column_stack([x, z[:, o]]) for o in {o for o, _ in fits}}
            for k, (o, i) in enumerate(fits):
                mine = (outer != o) & (inner != i) if i is not None else outer != o
                d, t = designs[o][mine], y[mine]
                eta = d @ at[o, i]
                p, w = _chance(eta), often[mine] * np.where(t > 0, weights[o, i][1], weights[o, i][0])
                total[k, 0] += (w * (np.logaddexp(0, eta) - t * eta)).sum()
                total[k, 1 : 1 + width] += d.T @ (w * (p - t))
                total[k, 1 + width :] += (d.T @ (d * (w * p * (1 - p))[:, None])).ravel()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["fit", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"fit": [key[0].as_py()], "sums": [np.sum([x.values.to_numpy() for x in table.column("sums")], axis=0)]}, schema=pa.schema([("fit", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(run, "fit int, sums array<double>").withColumn("part", F.spark_partition_id() % SUM_GROUPS)
    total = {f: np.zeros(1 + width + width * width) for f in fits}
    for r in parts.groupBy("fit", "part").applyInArrow(add, "fit int, sums array<double>").collect():  # SUM_GROUPS rows a fit at most
        total[fits[r.fit]] += np.array(r.sums)
    return {f: (t[0], t[1 : 1 + width], t[1 + width :].reshape(width, width)) for f, t in total.items()}


def chances(fitted: dict[Fit, np.ndarray], folds: int = OUTER) -> Column:
    """Of rows (outer, inner, x, z): an array with, per outer fold, the probability by a fit that didn't learn from the row: (o, inner), in its own outer fold (o, None)."""
    @F.arrow_udf("array<double>")
    def score(outer: pa.Array, inner: pa.Array, x: pa.Array, z: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([x, z], ["x", "z"])
        if not batch.num_rows:
            return pa.array([], pa.list_(pa.float64()))
        common, own = _design(batch, folds)
        out = np.full((batch.num_rows, folds), np.nan)
        of, within = outer.to_numpy(zero_copy_only=False), inner.to_numpy(zero_copy_only=False)
        for o in range(folds):
            d = np.column_stack([common, own[:, o]])
            for i in {None, *[i for a, i in fitted if a == o]}:
                rows = of == o if i is None else (of != o) & (within == i)
                if (o, i) in fitted and rows.any():
                    out[rows, o] = _chance(d[rows] @ fitted[o, i])
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, folds, dtype=np.int32), out.ravel())

    return score("outer", "inner", "x", "z")


def own_fold(values: Column) -> Column:
    """The value of a row's own outer fold."""
    return F.get(values, F.col("outer"))


def stacked(rows: DataFrame, folds: int = OUTER, inner: int = INNER, c: float = C, extra: tuple[Column, ...] = (), balanced: bool = False) -> DataFrame:
    """rows (key columns, y, outer, inner, x, z) with p_one and p_two: probabilities of models that never saw the row.

    Level one: all nested fits. Level two, per outer fold, learns from level one's probabilities (as logits) and extra
    columns; those it learns from were given to rows outside the outer fold by fits that had left out their inner fold,
    so it reads out-of-fold rows only. The rows are kept for the scans of both levels.
    """
    rows = rows.persist()
    one = fit_many(rows, all_fits(folds, inner), folds, c, balanced)
    second = rows.withColumn("_p", chances(one, folds)).withColumnsRenamed({"x": "_x", "z": "_z"})
    second = second.withColumn("x", F.array(*extra) if extra else F.array().cast("array<double>")).withColumn("z", F.transform("_p", lambda p: F.array(logit(p)))).persist()
    two = fit_many(second, [(o, None) for o in range(folds)], folds, c)
    out = second.withColumn("_q", chances(two, folds))  # only a row's own outer fold has a fit here
    return out.select(*[n for n in rows.columns if n not in ("x", "z")], own_fold(F.col("_p")).alias("p_one"), own_fold(F.col("_q")).alias("p_two"))


def policy_by_fold(labelled: DataFrame, folds: int = OUTER) -> DataFrame:
    """(sponsor_id, learned): the outer folds without whose rows a sponsor is learned as revoked; labelled as in sponsor_policy, with outer."""
    copies = labelled.withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("left_out <> outer")
    return sponsor_policy(copies, ["left_out"]).groupBy("sponsor_id").agg(F.collect_set("left_out").alias("learned"))


def fold_flags(learned: Column, folds: int = OUTER) -> Column:
    """z of a flag that was learned per outer fold: one list per fold."""
    return F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda o: F.array(F.coalesce(F.array_contains(learned, o), F.lit(False)).cast("double")))
