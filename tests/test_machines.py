"""Machines fitted in shared passes are those of the library, in fewer jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import machines, models
from cohortlens.operators.nystroem import nystroem


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(500, 2)), rng.integers(0, 2, 500)])
    score = 2 * x[:, 0] + x[:, 2] + rng.normal(0, 0.4, 500)
    data = [(v.tolist(), float(np.digitize(s, [-0.5, 1.5])), float(1 + i % 3)) for i, (v, s) in enumerate(zip(x, score))]
    df = spark.createDataFrame(data, "x array<double>, label double, w double").withColumn("features", array_to_vector("x"))
    return df.repartition(3).cache()


def library(c, total, **kw):
    return LinearSVC(standardization=False, maxIter=40, tol=1e-4, regParam=1 / (c * total), **kw)


def close(a, b):
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6) and a.intercept == pytest.approx(b.intercept, abs=1e-6)


def test_classes_and_strengths_share_passes(spark, rows, monkeypatch):
    total = rows.agg(F.sum("w")).first()[0]
    passes = []
    monkeypatch.setattr(machines, "summed", lambda *a, run=machines.summed: (passes.append(1), run(*a))[1])
    est = models.svm_linear(1.0, "w", max_iter=40)
    found = est.fit_grid(rows, [{est.C: 0.5}, {est.C: 5.0}])
    assert len(passes) < 120
    for c, model in zip((0.5, 5.0), found):
        want = OneVsRest(classifier=library(c, total), weightCol="w").fit(rows)
        for a, b in zip(model.models, want.models):
            close(a, b)
        mine, theirs = (m.transform(rows).select(vector_to_array("rawPrediction"), "prediction").collect() for m in (model, want))
        assert np.allclose([r[0] for r in mine], [r[0] for r in theirs], atol=1e-5) and [r[1] for r in mine] == [r[1] for r in theirs]


def test_kernel_features_made_in_each_pass(spark, rows):
    two = rows.withColumn("label", (F.col("label") > 1).cast("double"))
    found = models.svm_poly(2, 2.0, 0.5, max_iter=40).fit(two)
    mapped = models.ScaledVector(factor=0.5**0.5).transform(two)
    mapped = PolynomialExpansion(inputCol="scaled_features", outputCol="kernel_features", degree=2).transform(mapped)
    close(found.stages[-1], library(2.0, 500, featuresCol="kernel_features").fit(mapped))
    radial = models.svm_rbf(0.3, components=10, max_iter=15).fit(two)
    mapped = nystroem(two, components=10, gamma=0.3).transform(two)
    close(radial.stages[-1], library(1.0, 500, featuresCol="kernel_features").setMaxIter(15).fit(mapped))


def test_a_model_is_saved_as_the_librarys(spark, rows, tmp_path):
    model = models.svm_linear(1.0, max_iter=5).fit(rows)
    model.write().save(str(tmp_path / "m"))
    again = OneVsRestModel.load(str(tmp_path / "m"))
    assert [m.intercept for m in again.models] == [m.intercept for m in model.models]


def test_what_is_no_class_is_refused(spark, rows):
    with pytest.raises(ValueError, match="two classes"):
        models.svm_linear(one_vs_rest=False).fit(rows)
    with pytest.raises(ValueError, match="classes from 0"):
        models.svm_linear().fit(rows.withColumn("label", F.when(F.col("w") > 1, F.col("label"))))
    with pytest.raises(ValueError, match="no rows"):
        models.svm_linear().fit(rows.limit(0))
