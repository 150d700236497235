import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortlens.operators import linear, tuning
from cohortlens.operators.foldstats import LinearCandidate, MomentRegression, Penalty, fold_moments, linear_path, score_folds
from cohortlens.operators.metrics import regression_metrics

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c = rng.gauss(5, 2), rng.gauss(0, 1), rng.gauss(1000, 3)
        rows.append((i % 4, a, b, c, a + rng.gauss(0, 1), 2 * a - b + 0.1 * c + rng.gauss(0, 1)))
    return rows


@pytest.fixture(scope="module")
def table(spark, data):
    extra = [(0, None, 1.0, 1.0, 1.0, 1.0), (1, 1.0, math.nan, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data + extra, "fold int, a double, b double, c double, d double, y double").repartition(3)


def plain_net(x, y, l1, l2, steps=3000):
    """Proximal gradient descent on the plain objective."""
    n = len(y)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    b = np.zeros(x.shape[1])
    rate = 1 / (np.linalg.eigvalsh(xc.T @ xc / n).max() + l2)
    for _ in range(steps):
        moved = b - rate * (-(xc.T @ (yc - xc @ b)) / n + l2 * b)
        b = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
    return b, y.mean() - x.mean(axis=0) @ b


def arrays(data, fold=None, other=False):
    own = [r for r in data if fold is None or (r[0] != fold) == other]
    return np.array([r[1:5] for r in own]), np.array([r[5] for r in own])


def test_fold_moments_add_up(table, data):
    found = fold_moments(table, NAMES, "y")
    for moments, (x, y) in ((found.all(), arrays(data)), (found.of(2), arrays(data, 2)), (found.without(2), arrays(data, 2, True))):
        joined = np.column_stack([x, y])
        assert moments.n == len(y)
        assert np.allclose(moments.mean, joined.mean(axis=0)) and np.allclose(moments.cov, np.cov(joined.T, bias=True))
    assert found.of(9) is None


def test_scores_equal_fits_fold_by_fold(table, data):
    penalties = [Penalty(), Penalty(total=30.0), Penalty.elastic(0.3, 1.0), Penalty.elastic(0.5, 0.5)]
    found = score_folds(table, NAMES, "y", penalties, 4, metrics=("r2", "rmse", "mape", "mae"))
    for fold in range(4):
        (x, y), (hx, hy) = arrays(data, fold, True), arrays(data, fold)
        for i, p in enumerate(penalties):
            b, b0 = plain_net(x, y, p.l1, p.l2 + p.total / len(y)) if i else (None, None)
            if not i:
                solved = np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)[0]
                b, b0 = solved[:-1], solved[-1]
            e = hy - hx @ b - b0
            got = found[fold, i]
            assert got["mse"] == pytest.approx((e * e).mean(), rel=1e-4) and got["r2"] == pytest.approx(1 - (e * e).mean() / hy.var(), rel=1e-4)
            assert got["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-3) and got["mape"] == pytest.approx(100 * np.abs(e / hy).mean(), rel=1e-3)


def test_elastic_net_reaches_the_optimum(table, data):
    x, y = arrays(data)
    whole = table.where("fold is not null")
    for alpha, ratio in ((0.2, 1.0), (0.5, 0.5), (2.0, 0.1)):
        fit = linear.elastic_net(whole, NAMES, "y", alpha, ratio)
        b, b0 = plain_net(x, y, alpha * ratio, alpha * (1 - ratio))

        def loss(w, c):
            return ((y - x @ w - c) ** 2).mean() / 2 + alpha * ratio * np.abs(w).sum() + alpha * (1 - ratio) / 2 * w @ w

        assert loss(np.array(fit.coefficients), fit.intercept) <= loss(b, b0) + 1e-9
    assert set(linear.lasso(table, NAMES, "y", 1e6).coefficients) == {0.0}


def test_sums_about_a_far_point_are_taken_again(spark):
    # The first rows are far from the rest, which hardly varies.
    rows = [(1e9, 0.0)] * 0 + [(float(i % 7), 3.0 * (i % 7)) for i in range(50)]
    df = spark.createDataFrame([(1e6 + a, b) for a, b in rows], "a double, y double")
    far = spark.createDataFrame([(0.0, 0.0)] * 1000, "a double, y double").coalesce(1)
    m = linear.moments(df, ["a", "y"])
    assert np.allclose(m.cov, np.cov(np.array([(1e6 + a, b) for a, b in rows]).T, bias=True), rtol=1e-9)
    both = far.unionAll(spark.createDataFrame([(1e8 + a, b) for a, b in rows] * 40, "a double, y double"))
    joined = np.array([(0.0, 0.0)] * 1000 + [(1e8 + a, b) for a, b in rows] * 40)
    assert np.allclose(linear.moments(both, ["a", "y"]).cov, np.cov(joined.T, bias=True), rtol=1e-9)


def test_grid_search_takes_one_scan_for_r2(spark, table, tmp_path):
    assembled = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="skip").transform(table)
    rows = assembled.where("fold is not null and y is not null").select("fold", "features", F.col("y").alias("label"))
    est = MomentRegression()
    grid = [{est.alpha: a, est.l1_ratio: r} for a in (0.0, 0.1, 1.0, 10.0) for r in (0.0, 0.5, 1.0)]
    model, best, scores, rejected = tuning.grid_search(rows, est, grid, tuning.RegressionScore("r2"), 4)
    assert len(scores) == 12 and not rejected and best["alpha"] in (0.0, 0.1)
    slow = tuning.grid_search(rows, LinearRegression(solver="normal"), [{}], tuning.RegressionScore("r2"), 4)[2][0]
    assert scores[0] == pytest.approx(slow)
    fitted = model.transform(rows)
    assert regression_metrics(fitted, "label", "prediction").first().r2 > 0.9
    # A grid point out of range is rejected; a fold without rows leaves no mean.
    _, _, some, why = tuning.grid_search(rows, est, [{est.alpha: -1.0}, {est.alpha: 0.0}], tuning.RegressionScore("rmse"), 4)
    assert math.isnan(some[0]) and 0 in why and not math.isnan(some[1])
    assert all(math.isnan(s) for s in tuning.grid_search(rows, est, [{est.alpha: 0.0}], tuning.RegressionScore("r2"), 5)[2])


def test_cv_scores_of_candidates_equal_those_of_functions(table):
    whole = table.where("fold is not null").dropna()
    fits = {"ols": lambda t: linear.ols(t, NAMES, "y"), "ridge": lambda t: linear.ridge(t, NAMES, "y", 30.0)}
    plain = {name: (lambda train, held, fit=fit: fit(train).transform(held, "prediction")) for name, fit in fits.items()}
    fast = {"ols": LinearCandidate(tuple(NAMES)), "ridge": LinearCandidate(tuple(NAMES), Penalty(total=30.0))}
    want = {r.model: r for r in tuning.cv_scores(whole, plain, 4, label="y").collect()}
    got = {r.model: r for r in tuning.cv_scores(whole, fast | {"again": plain["ols"]}, 4, label="y").collect()}
    assert got.keys() == {"ols", "ridge", "again"}
    for name in fast:
        assert all(got[name][m] == pytest.approx(want[name][m]) for m in ("r2", "rmse", "mape"))


def test_path(table):
    path = linear_path(table, NAMES, "y", [0.01, 1.0, 1e5], [0.5, 1.0], 4).collect()
    assert len(path) == 6
    by = {(r.alpha, r.l1_ratio): r for r in path}
    assert by[1e5, 1.0].nonzero == 0 and by[0.01, 1.0].nonzero >= 3 and by[0.01, 1.0].r2 > by[1e5, 1.0].r2
    empty = linear_path(table.limit(0), NAMES, "y", [0.1], [1.0], 4).collect()
    assert [(r.r2, r.coefficients) for r in empty] == [(None, None)]
