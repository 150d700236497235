import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators.descent import lbfgs
from cohortlens.operators.kernels import PairwiseProbability, TubeRegression, coupled
from cohortlens.operators.models import KernelSvm, RandomFourierFeatures, svm_linear
from cohortlens.operators.nystroem import NystroemMap, landmarks, nystroem, rbf


def table(spark, rows, **columns):
    return spark.createDataFrame(rows, "key long, x array<double>, label double").withColumn("features", array_to_vector("x")).repartition(3, "key")


def line(seed, count=120, width=2):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        x = [rng.gauss(3, 2) for _ in range(width)]
        rows.append((i, x, 1.5 * x[0] - 0.5 * x[-1] + 2 + rng.gauss(0, 0.3) + (rng.random() < 0.05) * 20))
    return rows


def tube_loss(w, b, x, y, c, epsilon):
    return w @ w / 2 + c * np.maximum(np.abs(y - x @ w - b) - epsilon, 0).sum()


def plain_tube(x, y, c, epsilon):
    """Subgradient descent with falling steps from least squares; the best point met."""
    w = np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)[0]
    best, low = w, math.inf
    for t in range(1, 60000):
        r = y - x @ w[:-1] - w[-1]
        s = np.where(np.abs(r) > epsilon, np.sign(r), 0.0)
        value = tube_loss(w[:-1], w[-1], x, y, c, epsilon)
        if value < low:
            best, low = w.copy(), value
        g = np.append(w[:-1] - c * s @ x, -c * s.sum())
        w = w - 0.5 / math.sqrt(t) * g / max(1e-9, np.linalg.norm(g))
    return best, low


@pytest.mark.parametrize(("c", "epsilon"), [(1.0, 0.3), (0.05, 0.0)])
def test_tube_regression_is_at_the_optimum(spark, c, epsilon):
    rows = line(3)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    model = TubeRegression(c=c, epsilon=epsilon).fit(table(spark, rows)).stages[-1]
    got = tube_loss(np.array(model.coefficients), model.intercept, x, y, c, epsilon)
    _, low = plain_tube(x, y, c, epsilon)
    assert got <= low * 1.002 + 1e-3


def test_points_inside_the_tube_do_not_move_the_fit(spark):
    rows = line(4)
    first = TubeRegression(c=2.0, epsilon=1.0).fit(table(spark, rows)).stages[-1]
    def at(x):
        return sum(b * v for b, v in zip(first.coefficients, x)) + first.intercept

    inside = [(i, x, at(x) + 0.5 * (y - at(x))) if abs(y - at(x)) < 0.8 else (i, x, y) for i, x, y in rows]
    assert sum(a != b for a, b in zip(rows, inside)) > 60
    again = TubeRegression(c=2.0, epsilon=1.0).fit(table(spark, inside)).stages[-1]
    assert np.allclose(again.coefficients, first.coefficients, atol=0.01) and again.intercept == pytest.approx(first.intercept, abs=0.02)


def test_tube_regression_on_a_kernel_and_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2)], 0.0) for i in range(120)]
    rows = [(i, x, math.sin(2 * x[0])) for i, x, _ in rows]
    extra = [(900, None, 1.0), (901, [1.0], None), (902, [math.nan], 1.0)]
    df = spark.createDataFrame(rows + extra, "key long, features array<double>, label double")
    model = TubeRegression("rbf", c=10.0, epsilon=0.1, gamma=0.5, components=12, tol=1e-3).fit(df.where("key < 900"))
    scored = model.transform(df.where("key < 900")).collect()
    assert np.mean([abs(r.prediction - r.label) for r in scored]) < 0.1
    line_of = TubeRegression().fit(df)
    assert np.isfinite(line_of.stages[-1].intercept)
    with pytest.raises(ValueError, match="out of range"):
        TubeRegression("poly").fit(df)
    with pytest.raises(ValueError, match="no complete rows"):
        TubeRegression().fit(df.limit(0))


def test_lbfgs_finds_the_minimum():
    def bowl(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(lbfgs(bowl, np.array([-1.2, 1.0]), 1e-10, 500), [1, 1], atol=1e-5)


def test_landmarks_follow_the_data_and_their_kernel_error_is_smaller(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 3, (6, 4))
    x = centres[rng.integers(0, 6, 400)] + rng.normal(0, 0.3, (400, 4))
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    df = table(spark, rows)
    gamma, width = 0.2, 40
    exact = rbf(x, x, gamma)

    def error(mapped):
        z = np.array([r.z for r in mapped.orderBy("key").collect()])
        return np.abs(z @ z.T - exact).mean()

    by_rows = nystroem(df, components=width, gamma=gamma).transform(df).select("key", vector_to_array("kernel_features").alias("z"))
    random_ones = RandomFourierFeatures(gamma=gamma, components=width).transform(df).select("key", vector_to_array("kernel_features").alias("z"))
    assert error(by_rows) < error(random_ones) / 5
    # Copies of a row are one landmark, wherever the rows lie.
    copies = table(spark, rows[:10] * 50)
    found = landmarks(copies, "features", 40)
    assert len(found) == 10 and np.allclose(landmarks(copies.repartition(7), "features", 40), found)
    full = NystroemMap(x[:50], gamma)
    assert np.allclose(full.map(x[:50]) @ full.map(x[:50]).T, exact[:50, :50], atol=1e-6)


def test_rbf_machine_separates_rings(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        r, a = (1.0 if i % 2 else 3.0) + rng.gauss(0, 0.1), rng.uniform(0, 2 * math.pi)
        rows.append((i, [r * math.cos(a), r * math.sin(a)], float(i % 2)))
    df = table(spark, rows)
    model = KernelSvm("rbf", "scale", c=10.0, components=30).fit(df)
    assert model.transform(df).where("prediction = label").count() > 230


def test_coupling_equals_a_plain_solver():
    rng = np.random.default_rng(8)
    for k in (2, 3, 5):
        r = rng.uniform(0.05, 0.95, (20, k, k))
        r = np.triu(r, 1) + np.tril(1 - r.transpose(0, 2, 1), -1)
        got = coupled(r)
        assert np.allclose(got.sum(axis=1), 1) and (got >= 0).all()
        for row, own in zip(r, got):
            # Gauss-Seidel steps on the same sum of squares.
            q = -row * row.T
            np.fill_diagonal(q, (row * row).sum(axis=0) - np.diag(row) ** 2)
            p = np.full(k, 1 / k)
            for _ in range(1500):
                for t in range(k):
                    p[t] = (-(q[t] @ p - q[t, t] * p[t]) + p @ q @ p) / q[t, t]
                    p /= p.sum()
            assert np.allclose(own, p, atol=1e-6)
    # Consistent pairs give back the probabilities they come from.
    p = np.array([0.5, 0.3, 0.2])
    assert np.allclose(coupled((p[:, None] / (p[:, None] + p))[None]), p)


def test_pairwise_machines_give_calibrated_classes(spark):
    rng = random.Random(9)
    centres = [(0, 0), (3, 0), (0, 3)]
    rows = [(i, [centres[i % 3][0] + rng.gauss(0, 1), centres[i % 3][1] + rng.gauss(0, 1)], float(i % 3)) for i in range(300)]
    df = table(spark, rows).withColumn("fold", (F.col("key") % 2).cast("int"))
    model = PairwiseProbability(lambda: svm_linear(1.0, one_vs_rest=False, max_iter=30), 2).fit(df)
    scored = model.transform(df)
    assert set(scored.columns) == {*df.columns, "probability", "prediction"}
    found = scored.withColumn("p", vector_to_array("probability")).collect()
    assert all(math.isclose(sum(r.p), 1.0) and r.prediction == float(np.argmax(r.p)) for r in found)
    assert np.mean([r.prediction == r.label for r in found]) > 0.85
    for k in range(3):
        assert np.mean([r.p[k] for r in found]) == pytest.approx(1 / 3, abs=0.03)
    with pytest.raises(ValueError, match="two classes"):
        PairwiseProbability(lambda: svm_linear(one_vs_rest=False)).fit(df.where("label = 1"))
