"""End-to-end flows: paired change, tuned classifier, regression, scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import (
    cut_bins,
    format_probabilities,
    numeric_or_null,
    truncate_to_int,
)
from cohortlens.operators import split
from cohortlens.operators.clean import align_schema, drop_rare_classes, threshold_features
from cohortlens.operators.describe import corr_with_target, describe, error_vs_feature, safe_corr
from cohortlens.operators.features import label_decoder, label_encoder, standard_scale
from cohortlens.operators.importance import actual_vs_predicted
from cohortlens.operators.linear import LinearFit, ols, robust_lm
from cohortlens.operators.metrics import (
    accuracy_metrics,
    classification_report,
    confusion_matrix,
    pct_within,
    regression_metrics,
)
from cohortlens.operators.models import class_probability, kept, named_columns
from cohortlens.operators.pairing import pair_timepoints, with_changes
from cohortlens.operators.tuning import BalancedAccuracy, fit_or_fallback

# Rating bins and their labels, lowest first.
FIVE_GROUP_EDGES = (0, 2, 4, 6, 8, 10)
FIVE_GROUP_LABELS = ("E (1-2)", "D (3-4)", "C (5-6)", "B (7-8)", "A (9-10)")
TWO_GROUP_EDGES = (0, 6, 10)
TWO_GROUP_LABELS = ("Not High Pain (1-6)", "High Pain (7-10)")


def paired_changes(df: DataFrame, measures: Sequence[str], **pairing) -> DataFrame:
    """Subjects known at both timepoints for every measure, with their changes."""
    return with_changes(pair_timepoints(df, measures, **pairing), measures).dropna()


def paired_change_report(
    df: DataFrame, measures: Sequence[str], outcome: str, **pairing
) -> tuple[DataFrame, DataFrame]:
    """Description of every change, and its correlation with the outcome's change.

    Both outputs start from the one grouped pairing pass.
    """
    changes = paired_changes(df, [*measures, outcome], **pairing)
    columns = [f"{m}_Change" for m in [*measures, outcome]]
    corr = changes.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            safe_corr(F.col(f"{m}_Change"), F.col(f"{outcome}_Change")).alias(f"corr_{m}")
            for m in measures
        ],
    )
    return describe(changes, columns), corr


def label_ratings(
    df: DataFrame,
    rating: str,
    edges: Sequence[float] = FIVE_GROUP_EDGES,
    labels: Sequence[str] = FIVE_GROUP_LABELS,
    out: str = "group",
    min_count: int = 2,
) -> DataFrame:
    """Bin a rating into ordered groups; unrated rows and rare groups are removed."""
    rated = (
        df.withColumn(rating, truncate_to_int(numeric_or_null(rating)))
        .withColumn(out, cut_bins(rating, edges, labels))
        .dropna(subset=[rating, out])
    )
    return drop_rare_classes(rated, out, min_count) if min_count > 1 else rated


@dataclass(frozen=True)
class ClassifierRun:
    model: PipelineModel
    classes: tuple[str, ...]
    params: dict
    train: DataFrame
    test: DataFrame

    def scored(self, which: str = "test") -> DataFrame:
        rows = self.model.transform(getattr(self, which))
        rows = rows.withColumn("probabilities", class_probability(rows))
        return label_decoder(self.classes).transform(rows)


def tuned_classifier(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    estimator: Estimator,
    prep: Estimator,
    grid: Sequence[Mapping] = (),
    evaluator: Estimator | None = None,
    test_size: float = 0.2,
    fold_rule: str = "steps",
    weight_col: str | None = None,
    seed: int = 42,
) -> ClassifierRun:
    """Stratified split, encode, tune by stratified folds, refit on the training rows."""
    # What leads to the rows runs once for the classes, the split and the training rows.
    with kept(df) as (df,):
        encoder = label_encoder(df, target)
        classes = tuple(encoder.labelsArray[0])
        train, test = split.stratified_split(encoder.transform(df), target, key, test_size, seed)
        # Read many times by the fit; rebuilt from the hash split if an executor is lost.
        cached = split.hash_order(train, target, key, seed).persist()
        smallest = split.min_class_count(cached, target)
    try:
        folds = split.choose_folds(smallest, fold_rule)
        rows = split.balanced_weights(cached, target, weight_col) if weight_col else cached
        if grid:
            rows = split.stratified_kfold(rows, target, key, folds, seed)
        if rows is not cached:
            # Keys and the classes' names have done their work, and would go along into every copy.
            rows = rows.drop(*(({target, *key} - named_columns([estimator, prep])) - {"label", "fold", weight_col}))
        # Weights and folds are joined and numbered once.
        with kept(rows) as (rows,):
            if rows is not cached:
                rows.count()
                cached.unpersist()
            model, params = fit_or_fallback(
                rows, estimator, grid, evaluator or BalancedAccuracy(), folds, smallest, prep=prep
            )
    finally:
        cached.unpersist()
    return ClassifierRun(model, classes, params, train, test)


def classification_outcome(scored: DataFrame, target: str, labels: Sequence[str]) -> dict[str, DataFrame]:
    return {
        "accuracy": accuracy_metrics(scored, target, "predicted"),
        "report": classification_report(scored, labels, target, "predicted"),
        "confusion": confusion_matrix(scored, labels, target, "predicted"),
    }


def score_new_rows(
    df: DataFrame, run: ClassifierRun, feature_columns: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Score rows of any shape: align to the training schema, predict, spell out probabilities.

    Row-wise only, so it runs on batch tables and on streams alike.
    """
    schema = run.train.select(*feature_columns).schema
    scored = run.model.transform(align_schema(df, schema, keep))
    scored = scored.withColumn("__p", class_probability(scored))
    return (
        label_decoder(run.classes)
        .transform(scored)
        .select(
            *keep,
            "predicted",
            format_probabilities(F.col("__p"), run.classes).alias("probabilities"),
        )
    )


def threshold_regression(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    threshold: float = 0.10,
    test_size: float = 0.2,
    seed: int = 42,
) -> tuple[LinearFit, DataFrame]:
    """Keep features correlated with the target, scale, fit least squares, score both parts.

    Features are chosen, and the scaler and model fitted, on the training rows only.
    """
    train, _ = split.train_test_split(df, key, test_size, seed)
    ranked = threshold_features(corr_with_target(train, features, target), threshold)
    chosen = [r.feature for r in ranked.orderBy(F.desc("abs_corr"), "feature").collect()]
    if not chosen:
        raise ValueError(f"no feature reaches |corr| >= {threshold}")
    scaler = standard_scale(train, chosen)
    fit = ols(scaler.transform(train), chosen, target)
    part = F.when(split.is_test(key, test_size, seed), "test").otherwise("train")
    scored = fit.transform(scaler.transform(df).withColumn("part", part))
    return fit, regression_metrics(scored, target, "predicted", len(chosen), by=["part"])


def change_regression(
    df: DataFrame,
    measures: Sequence[str],
    outcome: str,
    subject: str = "subject_id",
    tolerance: float = 1.0,
    min_rows: int = 11,
    **pairing,
) -> dict[str, DataFrame]:
    """Predict the outcome's change from the measures' changes, robustly and by least squares.

    Returns the robust coefficient table, the test metrics of both models, the share of errors within the
    tolerance, the error's correlation with every predictor, and the row-by-row comparison.
    """
    changes = paired_changes(df, [*measures, outcome], subject=subject, **pairing)
    columns, target = [f"{m}_Change" for m in measures], f"{outcome}_Change"
    changes = changes.select(subject, target, *columns).persist()
    try:
        rows = changes.count()
        if rows < min_rows:
            raise ValueError(f"{rows} paired subjects, need {min_rows}")
        train, _ = split.train_test_split(changes, subject)
        robust, plain = robust_lm(train, columns, target), ols(train, columns, target)
    finally:
        changes.unpersist()
    _, test = split.train_test_split(changes, subject)
    scored = test.select(
        subject, *columns, F.col(target).alias("actual"),
        F.array(
            F.struct(F.lit("robust").alias("model"), robust.predicted().alias("predicted")),
            F.struct(F.lit("least squares").alias("model"), plain.predicted().alias("predicted")),
        ).alias("__m"),
    ).select(subject, *columns, "actual", F.inline("__m"))
    least = scored.where(F.col("model") == "least squares")
    return {
        "coefficients": robust.table(df.sparkSession),
        "metrics": regression_metrics(scored, n_features=len(columns), by=["model"]),
        "within": pct_within(least, tolerance),
        "error_corr": error_vs_feature(least, columns, "actual", "predicted"),
        "rows": actual_vs_predicted(least, [subject], tolerance=tolerance),
    }
