"""Nested fits against single ones; what each level may see."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import nested


def make(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(n, 3)), rng.normal(size=(n, 4, 1))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    return x, z, y, rng.integers(0, 4, n), rng.integers(0, 3, n)


def frame(spark, x, z, y, outer, inner):
    rows = [(i, float(y[i]), int(outer[i]), int(inner[i]), x[i].tolist(), z[i].tolist()) for i in range(len(y))]
    return spark.createDataFrame(rows, "k int, y double, outer int, inner int, x array<double>, z array<array<double>>").repartition(3)


def single(d, y, c, weight=None):
    """One ridge logistic fit by plain Newton steps."""
    d, b = np.column_stack([np.ones(len(d)), d]), np.zeros(d.shape[1] + 1)
    w, free = np.ones(len(y)) if weight is None else weight, np.append(0, np.ones(d.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ b))
        b = b - np.linalg.solve(c * (d.T * (w * p * (1 - p))) @ d + np.diag(free), c * d.T @ (w * (p - y)) + free * b)
    return b


@pytest.mark.parametrize("balanced", [False, True])
def test_every_fit_equals_its_single_fit(spark, balanced):
    x, z, y, outer, inner = make()
    got = nested.fit_many(frame(spark, x, z, y, outer, inner), nested.all_fits(4, 3), 4, 0.3, balanced)
    assert len(got) == 16
    for (o, i), b in got.items():
        m = (outer != o) & ((inner != i) if i is not None else True)
        n = [(y[m] == s).sum() for s in (0, 1)]
        weight = np.where(y[m] > 0, m.sum() / (2 * n[1]), m.sum() / (2 * n[0])) if balanced else None
        assert b == pytest.approx(single(np.column_stack([x, z[:, o]])[m], y[m], 0.3, weight), abs=1e-6)


@pytest.mark.parametrize("balanced", [False, True])
def test_equal_rows_are_scanned_once_and_count_as_often_as_they_are_there(spark, monkeypatch, balanced):
    x, z, y, outer, inner = (np.repeat(a, 5, 0) for a in make(60, 7))
    scanned, sums = [], nested._sums
    monkeypatch.setattr(nested, "_sums", lambda rows, *rest: scanned.append(rows.count()) or sums(rows, *rest))
    got = nested.fit_many(frame(spark, x, z, y, outer, inner), [(1, 2), (3, None)], 4, 0.3, balanced)
    assert set(scanned) == {60}
    for (o, i), b in got.items():
        m = (outer != o) & ((inner != i) if i is not None else True)
        n = [(y[m] == s).sum() for s in (0, 1)]
        weight = np.where(y[m] > 0, m.sum() / (2 * n[1]), m.sum() / (2 * n[0])) if balanced else None
        assert b == pytest.approx(single(np.column_stack([x, z[:, o]])[m], y[m], 0.3, weight), abs=1e-6)


def test_probabilities_come_from_fits_that_left_the_row_out(spark):
    x, z, y, outer, inner = make(120)
    df = frame(spark, x, z, y, outer, inner)
    fitted = nested.fit_many(df, nested.all_fits(4, 3), 4)
    for r in df.withColumn("p", nested.chances(fitted, 4)).collect():
        for o in range(4):
            b = fitted[o, None if o == r.outer else r.inner]
            assert r.p[o] == pytest.approx(1 / (1 + np.exp(-b @ [1, *r.x, *r.z[o]])))


def test_level_two_equals_its_single_fit_on_out_of_fold_rows(spark):
    x, z, y, outer, inner = make(200, 3)
    got = {r.k: (r.p_one, r.p_two) for r in nested.stacked(frame(spark, x, z, y, outer, inner), 4, 3, 0.3).collect()}
    full = [np.column_stack([x, z[:, o]]) for o in range(4)]
    for o in range(4):
        away, own = outer != o, outer == o
        logits = np.empty(len(y))
        for i in range(3):
            learn, give = away & (inner != i), away & (inner == i)
            logits[give] = np.column_stack([np.ones(give.sum()), full[o][give]]) @ single(full[o][learn], y[learn], 0.3)
        b = single(full[o][away], y[away], 0.3)
        mine = np.column_stack([np.ones(own.sum()), full[o][own]]) @ b
        clip = lambda v: np.log(np.clip(1 / (1 + np.exp(-v)), 1e-4, 0.9999) / (1 - np.clip(1 / (1 + np.exp(-v)), 1e-4, 0.9999)))
        two = single(clip(logits)[away][:, None], y[away], 0.3)
        for k, m in zip(np.nonzero(own)[0], mine):
            assert got[k] == pytest.approx((1 / (1 + np.exp(-m)), 1 / (1 + np.exp(-(two[0] + two[1] * clip(m))))), abs=1e-6)


def test_labels_of_the_own_fold_change_nothing(spark):
    """A leak test: turning all labels of an outer fold leaves its rows' probabilities as they were."""
    x, z, y, outer, inner = make(160, 5)
    before = {r.k: (r.p_one, r.p_two) for r in nested.stacked(frame(spark, x, z, y, outer, inner), 4, 3).where("outer = 2").collect()}
    turned = np.where(outer == 2, 1 - y, y)
    after = {r.k: (r.p_one, r.p_two) for r in nested.stacked(frame(spark, x, z, turned, outer, inner), 4, 3).where("outer = 2").collect()}
    assert len(before) > 20 and all(after[k] == pytest.approx(v, abs=1e-9) for k, v in before.items())


def test_policies_are_learned_outside_the_fold(spark):
    rows = [("SPN-1", v, "paid", "none", 10, a, o) for o in range(4) for v, a in (("XW-1", "DENIED"), ("DIP-1", "APPROVED"))] + [("SPN-2", "XW-1", "paid", "none", 10, "APPROVED" if o == 1 else "DENIED", o) for o in range(4)] * 3 + [("SPN-2", "DIP-1", "paid", "none", 10, "APPROVED", 0), ("SPN-2", "DIP-1", "paid", "none", 10, "APPROVED", 2)]
    df = spark.createDataFrame(rows, "sponsor_id string, visa_class string, fee_status string, risk_flags string, age_days int, adjudication string, outer int")
    learned = nested.policy_by_fold(df, 4)
    assert {r.sponsor_id: set(r.learned) for r in learned.collect()} == {"SPN-1": {0, 1, 2, 3}, "SPN-2": {1}}
    flags = learned.where("sponsor_id = 'SPN-2'").select(nested.fold_flags(F.col("learned"), 4)).first()[0]
    assert flags == [[0.0], [1.0], [0.0], [0.0]]


def test_no_rows(spark):
    none = frame(spark, *make(4)).where("false")
    assert all((b == 0).all() for b in nested.fit_many(none, nested.all_fits(4, 3), 4).values()) and nested.stacked(none, 4, 3).count() == 0
