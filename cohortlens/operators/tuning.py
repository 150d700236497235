"""Evaluators, cross-validation, grid search and leaderboards."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.foldstats import LinearCandidate, score_folds
from cohortlens.operators.metrics import accuracy_metrics, regression_metrics, roc_auc, target_verdict
from cohortlens.operators.models import class_probability, fit_cached, kept, without_inputs
from cohortlens.session import ensure_checkpoint_dir


class BalancedAccuracy(Evaluator):
    """Mean recall over the classes present."""

    def __init__(self, label: str = "label", prediction: str = "prediction") -> None:
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        value = accuracy_metrics(dataset, self.label, self.prediction).first().balanced_accuracy
        return math.nan if value is None else value

    def isLargerBetter(self) -> bool:
        return True


class RocAuc(Evaluator):
    """Exact ROC AUC of the positive class."""

    def __init__(self, label: str = "label", positive: int = 1) -> None:
        super().__init__()
        self.label, self.positive = label, positive

    def _evaluate(self, dataset: DataFrame) -> float:
        score = F.get(class_probability(dataset), F.lit(self.positive)).alias("__score")
        # Ranking reads its input twice; the model is to score the rows once.
        scored = dataset.select(self.label, score).persist()
        try:
            value = roc_auc(scored, self.label, "__score", float(self.positive)).first()
        finally:
            scored.unpersist()
        return math.nan if value is None or value.roc_auc is None else value.roc_auc

    def isLargerBetter(self) -> bool:
        return True


class RegressionScore(Evaluator):
    """``mape`` (rows with a zero target left out), ``rmse``, ``mae``, ``mse`` or ``r2``."""

    def __init__(
        self, metric: str = "mape", label: str = "label", prediction: str = "prediction"
    ) -> None:
        super().__init__()
        self.metric, self.label, self.prediction = metric, label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        value = regression_metrics(dataset, self.label, self.prediction).first()[self.metric]
        return math.nan if value is None else value

    def isLargerBetter(self) -> bool:
        return self.metric == "r2"


def _fold_tables(
    df: DataFrame, fold: int, fold_col: str, prep: Estimator | None
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold, preprocessed by a fit on the training rows."""
    train, held = df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
    if prep is None:
        return train, held
    fitted = prep.fit(train)
    return fitted.transform(train), fitted.transform(held)


def _cached_folds(
    df: DataFrame, fold: int, fold_col: str, prep: Estimator | None, estimator: Estimator | None = None
) -> list[DataFrame]:
    """A fold's tables, cached, with the columns for one estimator if given; filters of a cached table are not cached again."""
    tables = _fold_tables(df, fold, fold_col, prep)
    if prep is None:
        return list(tables)
    return [(t if estimator is None else without_inputs(t, prep, estimator)).persist() for t in tables]


def _best_of(maps: Sequence[Mapping], scores: Sequence[float], evaluator: Evaluator) -> Mapping:
    """The first parameter set of the best score; none if no set has a score."""
    sign = 1.0 if evaluator.isLargerBetter() else -1.0
    valid = [i for i, s in enumerate(scores) if not math.isnan(s)]
    return maps[max(valid, key=lambda i: sign * scores[i])] if valid else {}


def grid_search(
    df: DataFrame,
    estimator: Estimator,
    grid: Sequence[Mapping],
    evaluator: Evaluator,
    folds: int,
    fold_col: str = "fold",
    prep: Estimator | None = None,
    parallelism: int = 4,
) -> tuple[Model, dict, list[float], dict[int, str]]:
    """Score every parameter set on every fold, then refit the best on all rows.

    Preprocessing is fitted once per fold, on that fold's training rows, and shared by all
    parameter sets. A parameter set that the estimator rejects scores NaN; if all are, the
    estimator's own parameters are fitted. Any other failure ends the search. An estimator with a
    ``score_grid`` method (train, held, maps, evaluator) scores all sets of a fold itself, one with a ``fit_grid`` method
    fits all strengths of a fold at once, and one with a
    ``score_folds`` method scores all sets on all folds of rows that need no preprocessing.
    Returns the model, its parameters, the mean scores and why sets were rejected.
    """
    ensure_checkpoint_dir(df.sparkSession)
    maps = list(grid) or [{}]
    if prep is None and hasattr(estimator, "score_folds") and isinstance(evaluator, RegressionScore):
        scores, rejected, refit = estimator.score_folds(df, maps, evaluator, folds, fold_col)
        best = _best_of(maps, scores, evaluator)
        return PipelineModel([refit(best)]), {p.name: v for p, v in best.items()}, scores, rejected
    # Every fold and the refit read the rows; what leads to them (splits, folds) runs once.
    with kept(df) as (rows,):
        return _searched(rows, estimator, maps, evaluator, folds, fold_col, prep, parallelism)


def _searched(
    df: DataFrame,
    estimator: Estimator,
    maps: Sequence[Mapping],
    evaluator: Evaluator,
    folds: int,
    fold_col: str,
    prep: Estimator | None,
    parallelism: int,
) -> tuple[Model, dict, list[float], dict[int, str]]:
    sums = [0.0] * len(maps)
    rejected: dict[int, str] = {}
    for fold in range(folds):
        train, held = _cached_folds(df, fold, fold_col, prep, estimator)

        def score(i: int, train: DataFrame = train, held: DataFrame = held) -> tuple[int, float]:
            try:
                return i, evaluator.evaluate(estimator.fit(train, maps[i]).transform(held))
            except (IllegalArgumentException, ValueError) as error:
                if len(maps) == 1:
                    raise
                rejected[i] = f"{error!s:.200}"
                return i, math.nan

        try:
            if hasattr(estimator, "score_grid"):
                for i, value in enumerate(estimator.score_grid(train, held, maps, evaluator)):
                    sums[i] += value / folds
                continue
            if hasattr(estimator, "fit_grid") and {p.name for m in maps for p in m} == {"C"}:
                for i, model in enumerate(estimator.fit_grid(train, maps)):
                    sums[i] += evaluator.evaluate(model.transform(held)) / folds
                continue
            with ThreadPool(min(parallelism, len(maps))) as pool:
                for i, value in pool.imap_unordered(
                    inheritable_thread_target(df.sparkSession)(score), range(len(maps))
                ):
                    sums[i] += value / folds
        finally:
            train.unpersist()
            held.unpersist()
    best = _best_of(maps, sums, evaluator)
    return (
        fit_with_preprocessing(df, estimator, prep, best),
        {p.name: v for p, v in best.items()},
        sums,
        rejected,
    )


def fit_with_preprocessing(
    df: DataFrame, estimator: Estimator, prep: Estimator | None = None, params: Mapping | None = None
) -> PipelineModel:
    """Preprocessing and model in one saveable pipeline."""
    ensure_checkpoint_dir(df.sparkSession)  # long boosting runs cut their lineage there
    if prep is None:
        return PipelineModel([estimator.fit(df, dict(params or {}))])
    fitted = prep.fit(df)
    train = without_inputs(fitted.transform(df), prep, estimator).persist()
    try:
        return PipelineModel([fitted, estimator.fit(train, dict(params or {}))])
    finally:
        train.unpersist()


def fit_or_fallback(
    df: DataFrame,
    estimator: Estimator,
    grid: Sequence[Mapping],
    evaluator: Evaluator,
    folds: int,
    smallest_class: int,
    fold_col: str = "fold",
    prep: Estimator | None = None,
) -> tuple[PipelineModel, dict]:
    """Grid search where every fold can hold every class, else a plain fit of the base model."""
    if grid and folds >= 2 and smallest_class >= folds:
        model, params, *_ = grid_search(df, estimator, grid, evaluator, folds, fold_col, prep)
        return model, params
    return fit_with_preprocessing(df, estimator, prep), {}


def _score_candidates(df: DataFrame, models: Mapping, folds: int, fold_col: str, label: str) -> list[tuple]:
    """(model, fold, r2, rmse, mape) of the linear candidates."""
    groups: dict = {}
    for name, model in models.items():
        if isinstance(model, LinearCandidate):
            groups.setdefault(model.features, []).append(name)
    rows = []
    for features, names in groups.items():
        found = score_folds(df, features, label, [models[n].penalty for n in names], folds, fold_col)
        rows += [(names[i], fold, m["r2"], m["rmse"], m["mape"]) for (fold, i), m in found.items()]
    return rows


def _score_fits(
    df: DataFrame, models: Mapping, folds: int, fold_col: str, prep: Estimator | None, label: str
) -> list[tuple]:
    """(model, fold, r2, rmse, mape) of models that are fitted on the rows of each fold."""
    rows = []
    for fold in range(folds):
        train, held = _cached_folds(df, fold, fold_col, prep)
        try:
            if train.isEmpty() or held.isEmpty():
                continue
            for name, model in models.items():
                if isinstance(model, LinearCandidate):
                    scored = model.scored(train, held, label)
                elif isinstance(model, Estimator):
                    scored = model.fit(train).transform(held)
                else:
                    scored = model(train, held)
                m = regression_metrics(scored, label, "prediction").first()
                if m is not None:
                    rows.append((name, fold, m.r2, m.rmse, m.mape))
        finally:
            train.unpersist()
            held.unpersist()
    return rows


def cv_scores(
    df: DataFrame,
    models: Mapping[str, Estimator | LinearCandidate | Callable[[DataFrame, DataFrame], DataFrame]],
    folds: int,
    fold_col: str = "fold",
    prep: Estimator | None = None,
    label: str = "label",
) -> DataFrame:
    """Mean R2, RMSE and MAPE of every regressor over the folds, by rising MAPE.

    A model is an estimator, a linear candidate, or a function of (train, validation) that returns the
    validation rows with a ``prediction``. All linear candidates over the same features are scored from one set
    of fold statistics. Folds without training or validation rows are skipped, and so are means of no value.
    """
    fast = {name for name, model in models.items() if isinstance(model, LinearCandidate) and prep is None}
    slow = {name: model for name, model in models.items() if name not in fast}
    with kept(df) as (known,):
        rows = [] if prep is not None else _score_candidates(known, models, folds, fold_col, label)
        if slow:
            rows += _score_fits(known, slow, folds, fold_col, prep, label)
    scores = df.sparkSession.createDataFrame(
        rows, "model string, fold int, r2 double, rmse double, mape double"
    )
    return (
        scores.groupBy("model")
        .agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"))
        .orderBy(F.asc_nulls_last("mape"), "model")
    )


def tuned_leaderboard(
    train: DataFrame,
    test: DataFrame,
    models: Mapping[str, tuple[Estimator, Sequence[Mapping]]],
    folds: int,
    fold_col: str = "fold",
    prep: Estimator | None = None,
    label: str = "label",
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Tune every model on MAPE, score it on the test rows, rank by test MAPE."""
    rows, fitted = [], {}
    # All models read the same rows.
    with kept(train, test) as (train, test):
        for name, (estimator, grid) in models.items():
            start = time.monotonic()
            model, params, *_ = grid_search(
                train, estimator, grid, RegressionScore("mape", label), folds, fold_col, prep
            )
            seconds = time.monotonic() - start
            fitted[name] = model
            m = regression_metrics(model.transform(test), label, "prediction").first()
            rows.append(
                (name, m.r2, m.rmse, m.mape, {k: str(v) for k, v in params.items()}, seconds)
            )
    table = train.sparkSession.createDataFrame(
        rows,
        "model string, r2 double, rmse double, mape double, params map<string,string>, seconds double",
    ).withColumn("goal", target_verdict(F.col("mape"), F.col("rmse")))
    return table.orderBy(F.asc_nulls_last("mape"), "model"), fitted


def early_stopped(make: Callable[[str], Estimator], indicator: str = "__held") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A ``cv_scores`` candidate that stops boosting once the fold's own validation rows stop improving.

    ``make`` builds the estimator for the name of the column that flags those rows.
    """

    def run(train: DataFrame, held: DataFrame) -> DataFrame:
        both = train.withColumn(indicator, F.lit(False)).unionByName(held.withColumn(indicator, F.lit(True)))
        return fit_cached(make(indicator), both).transform(held)

    return run


def classifier_board(
    train: DataFrame,
    test: DataFrame,
    models: Mapping[str, tuple[Estimator, Sequence[Mapping]]],
    evaluator: Evaluator,
    folds: int,
    fold_col: str = "fold",
    prep: Estimator | None = None,
    label: str = "label",
    positive: int = 1,
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Tune every classifier with one evaluator on one split; one row each, best balanced accuracy first.

    Rows: accuracy, balanced accuracy and AUC of the positive class on the test rows, and the
    chosen parameters. A model without probabilities or margins has no AUC.
    """
    rows, fitted = [], {}
    # All models read the same rows.
    with kept(train, test) as (train, test):
        for name, (estimator, grid) in models.items():
            model, params, *_ = grid_search(train, estimator, grid, evaluator, folds, fold_col, prep)
            fitted[name] = model
            scored = model.transform(test).persist()
            try:
                m = accuracy_metrics(scored, label, "prediction").first()
                graded = {"probability", "rawPrediction"} & set(scored.columns)
                auc = RocAuc(label, positive).evaluate(scored) if graded else None
            finally:
                scored.unpersist()
            chosen = {k: str(v) for k, v in params.items()}
            rows.append((name, m.accuracy, m.balanced_accuracy, None if auc is None or math.isnan(auc) else auc, chosen))
    table = train.sparkSession.createDataFrame(
        rows, "model string, accuracy double, balanced_accuracy double, roc_auc double, params map<string,string>"
    )
    return table.orderBy(F.desc_nulls_last("balanced_accuracy"), "model"), fitted


def best_model(leaderboard: DataFrame, metric: str = "mape") -> DataFrame:
    """The leading row; models without a score are skipped."""
    known = leaderboard.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return known.orderBy(metric, "model").limit(1)


def out_of_fold_r2(
    df: DataFrame,
    estimator: Estimator,
    folds: int,
    fold_col: str = "fold",
    label: str = "label",
) -> float | None:
    """R2 of predictions for rows held out of the fit; stands in for out-of-bag scores."""
    scored = None
    for fold in range(folds):
        train, held = _fold_tables(df, fold, fold_col, None)
        part = fit_cached(estimator, train).transform(held).select(label, "prediction")
        scored = part if scored is None else scored.unionByName(part)
    return regression_metrics(scored, label, "prediction").first().r2


def params_table(spark: SparkSession, grid: Sequence[Mapping], scores: Sequence[float]) -> DataFrame:
    """One row per parameter set with its mean score."""
    rows = [({p.name: str(v) for p, v in m.items()}, float(s)) for m, s in zip(grid, scores)]
    return spark.createDataFrame(rows, "params map<string,string>, score double")
