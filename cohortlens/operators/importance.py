"""Feature importances, selection by importance, and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, error_columns
from cohortlens.operators.features import feature_names
from cohortlens.operators.metrics import regression_metrics
from cohortlens.operators.models import kept


def importance_values(model) -> np.ndarray:
    """Importances of a fitted model: tree gains, or absolute coefficients.

    Several classes, or one-vs-rest parts, are averaged.
    """
    if isinstance(model, PipelineModel):
        return importance_values(model.stages[-1])
    if hasattr(model, "models"):
        return np.mean([importance_values(m) for m in model.models], axis=0)
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    raise TypeError(f"{type(model).__name__} has no importances")


def importance_table(spark: SparkSession, model, names: Sequence[str], top: int | None = None) -> DataFrame:
    """(feature, importance, rank), strongest first; equal ones in name order."""
    values = importance_values(model)
    if len(values) != len(names):
        raise ValueError(f"{len(values)} importances for {len(names)} features")
    ordered = sorted(zip(names, map(float, values)), key=lambda r: (-r[1], r[0]))
    rows = [(n, v, i + 1) for i, (n, v) in enumerate(ordered)][:top]
    return spark.createDataFrame(rows, "feature string, importance double, rank int").orderBy("rank")


def importance_select_refit(
    train: DataFrame, estimator, top: int = 10, features: str = "features"
) -> tuple[PipelineModel, DataFrame]:
    """Rank features on the training rows, keep the strongest, refit on those alone."""
    with kept(train) as (train,):
        return _selected(train, estimator, top, features)


def _selected(train: DataFrame, estimator, top: int, features: str) -> tuple[PipelineModel, DataFrame]:
    first = estimator.fit(train)
    names = feature_names(train, features)
    ranking = importance_table(train.sparkSession, first, names)
    values = importance_values(first)
    keep = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))[:top]
    slicer = VectorSlicer(inputCol=features, outputCol=f"{features}_top", indices=keep)
    refit = estimator.copy({estimator.featuresCol: f"{features}_top"})
    return PipelineModel([slicer, refit.fit(slicer.transform(train))]), ranking


def actual_vs_predicted(
    scored: DataFrame,
    key: Sequence[str],
    actual: str = "actual",
    predicted: str = "predicted",
    tolerance: float = 1.0,
) -> DataFrame:
    """Per-row comparison with difference, absolute error, tolerance flag and percent error."""
    return scored.select(
        *[as_col(k) for k in key],
        as_col(actual).alias("actual"),
        as_col(predicted).alias("predicted"),
        *[e.alias(n) for n, e in error_columns(actual, predicted, tolerance).items()],
    )


def evaluate_dataset(
    scored: DataFrame, key: str, actual: str = "actual", predicted: str = "predicted", n_features: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Metrics with the worst row attached, and all rows by falling absolute error.

    The worst row (smallest key on a tie) is found in the same pass as the metrics.
    """
    error = F.abs(as_col(actual) - as_col(predicted))
    worst = F.min_by(
        F.struct(
            as_col(key).alias("worst_key"),
            as_col(actual).alias("worst_actual"),
            as_col(predicted).alias("worst_predicted"),
            error.alias("max_abs_error"),
        ),
        F.struct(-error, as_col(key)),
    )
    metrics = regression_metrics(scored, actual, predicted, n_features, also=[("__worst", worst)])
    report = metrics.select("*", "__worst.*").drop("__worst")
    rows = actual_vs_predicted(scored, [key], actual, predicted).orderBy(F.desc("abs_error"), key)
    return report, rows
