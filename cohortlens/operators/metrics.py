"""Evaluation metrics over prediction tables; each reads its input once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col
from cohortlens.operators.hypothesis import rank_sum_parts
from cohortlens.operators.ranks import cumulative_counts, long_measures


def mape_column(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error as an aggregate; rows with actual 0 are left out.

    With no other rows it is 0 when every prediction is 0, else infinite.
    """
    scored = F.avg(F.when(actual != 0, F.abs(F.try_divide(actual - predicted, actual)))) * 100
    only_zeros = F.when(F.max(F.abs(predicted)) > 0, F.lit(math.inf)).otherwise(F.lit(0.0))
    return F.when(F.count_if(actual != 0) > 0, scored).otherwise(only_zeros)


def _regression_sums(actual: Column, predicted: Column) -> list[Column]:
    err = actual - predicted
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(actual).alias("__var"),
        mape_column(actual, predicted).alias("mape"),
    ]


def regression_metrics(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    n_features: int = 1,
    by: Sequence[str] = (),
    also: Sequence[tuple[str, Column]] = (),
) -> DataFrame:
    """MSE, RMSE, MAE, R2, adjusted R2 and MAPE, from one aggregate.

    R2 of a constant target is 1 for perfect predictions, else 0. ``also`` names further
    aggregates to take in the same pass.
    """
    a, p = as_col(actual).cast("double"), as_col(predicted).cast("double")
    sums = df.where(a.isNotNull() & p.isNotNull()).groupBy(*[as_col(b) for b in by]).agg(
        *_regression_sums(a, p), *[e.alias(name) for name, e in also]
    )
    r2 = F.when(F.col("__var") > 0, 1 - F.try_divide(F.col("mse"), F.col("__var"))).otherwise(
        F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    n = F.col("n").cast("double")
    adjusted = 1 - (1 - F.col("r2")) * F.try_divide(n - 1, n - n_features - 1)
    return (
        sums.withColumn("r2", r2)
        .withColumn("adj_r2", adjusted)
        .select(
            *by,
            "n",
            "mse",
            F.sqrt("mse").alias("rmse"),
            "mae",
            "r2",
            "adj_r2",
            "mape",
            *[name for name, _ in also],
        )
    )


def max_error_row(df: DataFrame, key: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """The row with the largest absolute error; ties go to the smallest key.

    ``orderBy.limit(1)`` keeps one row per task instead of sorting the table.
    """
    error = F.abs(as_col(actual) - as_col(predicted))
    return (
        df.select(as_col(key).alias(key), as_col(actual).alias("actual"), as_col(predicted).alias("predicted"), error.alias("abs_error"))
        .orderBy(F.desc("abs_error"), key)
        .limit(1)
    )


def pct_within(
    df: DataFrame, tolerance: float = 1.0, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Count and percentage of rows with an absolute error below the tolerance."""
    hit = F.abs(as_col(predicted) - as_col(actual)) < tolerance
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("n_within"),
        (F.avg(hit.cast("double")) * 100).alias("pct_within"),
    )


def target_verdict(
    mape: Column, rmse: Column, mape_goal: float = 10.0, rmse_goal: float = 1.0
) -> Column:
    return (
        F.when(mape <= mape_goal, F.lit("mape"))
        .when(rmse <= rmse_goal, F.lit("rmse"))
        .otherwise(F.lit("missed"))
    )


def confusion_counts(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """(actual, predicted, n): every classification metric is derived from this table."""
    return df.groupBy(
        *[as_col(b) for b in by],
        as_col(actual).alias("actual"),
        as_col(predicted).alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _label_table(df: DataFrame, labels: Sequence[object], name: str = "label") -> DataFrame:
    listed = F.array(
        *[F.struct(F.lit(i).alias(f"{name}_order"), F.lit(v).alias(name)) for i, v in enumerate(labels)]
    )
    return df.sparkSession.range(1).select(F.inline(listed))


def confusion_matrix(
    df: DataFrame, labels: Sequence[object], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Counts for the full grid of the listed labels, zeros included."""
    grid = _label_table(df, labels, "actual").select(
        "actual", F.explode(F.array(*[F.lit(v) for v in labels])).alias("predicted")
    )
    counts = confusion_counts(df, actual, predicted)
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def _per_class(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("np"), hit.cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("np"), F.lit(0).cast("long").alias("tp")),
    )
    return (
        confusion.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("na").alias("support"), F.sum("np").alias("n_predicted"), F.sum("tp").alias("tp"))
    )


def accuracy_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and balanced accuracy (mean recall over the classes present in the truth)."""
    per_class = _per_class(confusion_counts(df, actual, predicted, by), by)
    recall = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    return per_class.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, recall)).alias("balanced_accuracy"),
    )


def classification_report(
    df: DataFrame,
    labels: Sequence[object] | None = None,
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.

    Divisions by zero give 0. A label list fixes the order and keeps empty classes.
    """
    stats = _per_class(confusion_counts(df, actual, predicted))
    if labels is not None:
        stats = _label_table(df, labels).join(stats, "label", "left").na.fill(0, ["support", "n_predicted", "tp"])
    else:
        stats = stats.withColumn("label_order", F.lit(0))
    zero = F.lit(0.0)
    tp = F.col("tp").cast("double")
    scored = (
        stats.withColumn("precision", F.coalesce(F.try_divide(tp, F.col("n_predicted")), zero))
        .withColumn("recall", F.coalesce(F.try_divide(tp, F.col("support")), zero))
        .withColumn("f1", F.coalesce(F.try_divide(2 * tp, F.col("n_predicted") + F.col("support")), zero))
    )
    total = F.sum("support")
    share = F.try_divide(F.sum("tp").cast("double"), total)

    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), zero)

    summary = scored.agg(
        total.alias("support"),
        F.array(
            F.struct(F.lit("accuracy").alias("label"), share.alias("precision"), share.alias("recall"), share.alias("f1")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")),
            F.struct(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1")),
        ).alias("__rows"),
    ).select("support", F.inline("__rows"))
    classes = scored.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    return classes.unionByName(summary)


def roc_auc(
    df: DataFrame, label: str, score: str, positive: object = 1, by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    """Exact area under the ROC curve, tied scores averaged; null with a single class.

    The rank-sum statistic over its group sizes, on the distributed ranks: scores are
    neither binned nor sorted in one task.
    """
    # The melted measure name gives a real grouping column when there is no other.
    labelled = df.select(
        *[as_col(b) for b in by], as_col(label).alias("__label"), as_col(score).alias("__score")
    )
    tall = long_measures(labelled, ["__score"], [*by, "__label"], "__curve")
    is_pos = as_col("__label") == F.lit(positive)
    counts = cumulative_counts(
        tall,
        "value",
        [*by, "__curve"],
        {"na": is_pos.cast("int"), "nb": (~is_pos).cast("int")},
        few_groups=few_groups or not by,
    )
    parts = counts.groupBy(*by, "__curve").agg(*rank_sum_parts())
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return parts.select(
        *by,
        F.col("n1").alias("n_positive"),
        F.col("n2").alias("n_negative"),
        F.try_divide(F.col("u1"), n1 * n2).alias("roc_auc"),
    )
