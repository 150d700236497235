import random

import numpy as np
import pytest

from cohortlens.operators import linear


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b = rng.gauss(3, 2), rng.gauss(-1, 1)
        rows.append((i, a, b, 2 * a - b + 5 + rng.gauss(0, 0.5)))
    return rows, spark.createDataFrame(rows, "i int, a double, b double, y double").cache()


def design(rows):
    m = np.array(rows)
    return np.column_stack([np.ones(len(m)), m[:, 1:3]]), m[:, 3]


def test_ols_matches_numpy(data):
    rows, df = data
    x, y = design(rows)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    fit = linear.ols(df, ["a", "b"], "y")
    assert (fit.intercept, *fit.coefficients) == pytest.approx(tuple(want), rel=1e-9)


@pytest.mark.parametrize("width", [3, 40])
def test_moments_of_any_width(spark, data, width):
    rows, _ = data
    x = np.array(rows)[:, 1:]
    x = np.column_stack([x] + [np.sin(i + x[:, 0]) + 1e6 for i in range(width - 3)])
    names = [f"c{i}" for i in range(width)]
    m = linear.moments(spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)), names)
    assert m.n == len(x) and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cov, np.cov(x.T, bias=True), atol=1e-8)
    empty = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    with pytest.raises(ValueError, match="no complete rows"):
        linear.moments(empty, names)


def test_inference_matches_numpy(data):
    rows, df = data
    x, y = design(rows)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ beta
    s2 = r @ r / (len(y) - 3)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
    table, summary = linear.ols_inference(df, ["a", "b"], "y", order=["i"])
    assert [t.se for t in table.collect()] == pytest.approx(list(se), rel=1e-8)
    s = summary.first()
    assert s.durbin_watson == pytest.approx(np.sum(np.diff(r) ** 2) / (r @ r), rel=1e-8)
    assert s.f_p_value < 1e-50 and 0 < table.first().p_value < 1e-6
    assert table.first().ci_low < 5 < table.first().ci_high


def test_ridge_limits(data):
    _, df = data
    free = linear.ols(df, ["a", "b"], "y")
    assert linear.ridge(df, ["a", "b"], "y", 1e-9).coefficients == pytest.approx(free.coefficients, rel=1e-6)
    assert abs(linear.ridge(df, ["a", "b"], "y", 1e9).coefficients[0]) < 1e-3


def coordinate_descent(x, y, alpha, ratio):
    x, y = x - x.mean(0), y - y.mean()
    n, beta = len(y), np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(beta)):
            rho = x[:, j] @ (y - x @ beta + x[:, j] * beta[j]) / n
            soft = np.sign(rho) * max(abs(rho) - alpha * ratio, 0)
            beta[j] = soft / (x[:, j] @ x[:, j] / n + alpha * (1 - ratio))
    return beta


@pytest.mark.parametrize("ratio", [1.0, 0.5, 0.1])
def test_penalised_fits_match_coordinate_descent(data, ratio):
    rows, df = data
    x, y = design(rows)
    fit = linear.elastic_net(df, ["a", "b"], "y", 0.7, ratio)
    assert fit.coefficients == pytest.approx(tuple(coordinate_descent(x[:, 1:], y, 0.7, ratio)), abs=1e-4)


def test_robust_equals_ols_without_outliers_in_shape(data):
    _, df = data
    fit = linear.robust_lm(df, ["a", "b"], "y")
    assert fit.coefficients == pytest.approx(linear.ols(df, ["a", "b"], "y").coefficients, abs=0.05)
    assert fit.iterations < 50 and len(fit.standard_errors) == 3


def test_one_huge_outlier(spark, data):
    rows, _ = data
    spoiled = [(*r[:3], r[3] + (1e4 if r[0] == 17 else 0)) for r in rows]
    df = spark.createDataFrame(spoiled, "i int, a double, b double, y double")
    robust = linear.robust_lm(df, ["a", "b"], "y")
    assert (robust.intercept, *robust.coefficients) == pytest.approx((5, 2, -1), abs=0.15)
    assert abs(linear.ols(df, ["a", "b"], "y").intercept - 5) > 1


def irls(x, y, passes=200):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(passes):
        r = y - x @ beta
        s = np.median(np.abs(r)) / linear.MAD_FACTOR
        w = np.minimum(1, linear.HUBER_T / np.maximum(np.abs(r / s), 1e-300))
        beta = np.linalg.solve((x.T * w) @ x, (x.T * w) @ y)
    return beta, np.median(np.abs(y - x @ beta)) / linear.MAD_FACTOR


@pytest.mark.parametrize("constant", [True, False])
def test_robust_against_numpy(spark, data, constant):
    rows, _ = data
    spoiled = [(*r[:3], r[3] + (30 if r[0] % 9 == 0 else 0)) for r in rows]
    df = spark.createDataFrame(spoiled, "i int, a double, b double, y double")
    x, y = design(spoiled)
    x = x if constant else x[:, 1:]
    beta, s = irls(x, y)
    fit = linear.robust_lm(df, ["a", "b"], "y", constant=constant)
    assert fit.estimates == pytest.approx(tuple(beta), abs=1e-4)
    r = (y - x @ beta) / s
    inside = np.abs(r) <= linear.HUBER_T
    psi = np.clip(r, -linear.HUBER_T, linear.HUBER_T)
    n, p = x.shape
    k = 1 + p / n * inside.var() / inside.mean() ** 2
    cov = k**2 * (psi @ psi / (n - p) * s**2) / inside.mean() ** 2 * np.linalg.inv(x.T @ x)
    assert fit.standard_errors == pytest.approx(tuple(np.sqrt(np.diag(cov))), rel=1e-3)
    assert fit.table(spark).count() == p


def test_perfect_fit_has_zero_scale(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "a double, y double")
    fit = linear.robust_lm(df, ["a"], "y")
    assert fit.coefficients[0] == pytest.approx(2.0) and fit.scale == pytest.approx(0, abs=1e-9)


def test_vif_and_coefficients(spark, data):
    _, df = data
    assert all(v.vif == pytest.approx(1.0, abs=0.05) for v in linear.vif(df, ["a", "b"]).collect())
    twin = df.withColumn("c", df.a + df.b * 0.01)
    assert linear.vif(twin, ["a", "c"]).first().vif > 1000
    exact = {r.feature: r.vif for r in linear.vif(df.selectExpr("a", "b", "2 * a AS c", "1.0 AS d"), ["a", "b", "c", "d"]).collect()}
    assert exact["a"] == exact["c"] == float("inf") and exact["b"] == pytest.approx(1.0, abs=0.05) and exact["d"] is None
    table = linear.coefficient_table(spark, linear.ols(df, ["a", "b"], "y"), "y").collect()
    assert [t.feature for t in table] == ["a", "b"] and "increase" in table[0].reading and "decrease" in table[1].reading
