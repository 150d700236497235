"""Descriptive statistics and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, numeric_or_null
from cohortlens.operators.linear import vector_sums
from cohortlens.operators.ranks import cumulative_counts, group_quantiles, long_measures, quantile_column

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def count_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*[as_col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"))


def value_counts(
    df: DataFrame, column: str, categories: Sequence[str] | None = None
) -> DataFrame:
    """Class frequencies; with an ordered category list also the empty classes."""
    counts = df.groupBy(as_col(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    if categories is None:
        return counts.orderBy(column)
    order = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias(column)) for i, c in enumerate(categories)])
    listed = df.sparkSession.range(1).select(F.inline(order))
    return (
        listed.join(counts.where(as_col(column).isin(*categories)), column, "left")
        .select(column, "ordinal", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("ordinal")
    )


def describe(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    exact: bool = True,
    few_groups: bool = False,
) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max per (group, measure).

    All follow from one set of running counts; ``exact=False`` takes one pass with sketched quartiles.
    """
    keys = [*by, "measure"]
    tall = long_measures(df, measures, by)
    if not exact:
        sketch = F.percentile_approx("value", list(QUARTILES.values()), 10_000)
        stats = tall.groupBy(*keys).agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            sketch.alias("__q"),
        )
        return stats.select(*keys, "n", "mean", "sd", "min", *[F.col("__q")[i].alias(q) for i, q in enumerate(QUARTILES)], "max")
    counts = cumulative_counts(tall, "value", keys, {"n": F.lit(1)}, few_groups or not by)
    shifted = F.col("value") - F.col("center")
    sums = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("center").alias("__c"),
        F.sum(F.col("n") * shifted).alias("__s"),
        F.sum(F.col("n") * shifted * shifted).alias("__ss"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *[quantile_column(p).alias(q) for q, p in QUARTILES.items()],
    )
    n = F.col("n").cast("double")
    variance = F.greatest(F.lit(0.0), F.try_divide(F.col("__ss") - F.col("__s") * F.col("__s") / n, n - 1))
    return sums.select(
        *keys,
        "n",
        (F.col("__c") + F.col("__s") / n).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(variance)).alias("sd"),
        "min",
        *QUARTILES,
        "max",
    )


def group_median(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    exact: bool = True,
    few_groups: bool = False,
) -> DataFrame:
    """Median per (group, measure)."""
    tall = long_measures(df, measures, by)
    return group_quantiles(
        tall, "value", [*by, "measure"], {"median": 0.5}, exact, few_groups=few_groups or not by
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are known; null if one is constant.

    Built from the covariance aggregates: the plain ``corr`` divides by zero on a
    constant input under ANSI rules.
    """
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    scale = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.try_divide(F.covar_pop(xs, ys), F.when(scale > 0, scale))


def corr_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(safe_corr(numeric_or_null(x), numeric_or_null(y)).alias("corr"))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Signed and absolute correlation of every feature with the target, strongest first.

    A single grouped pass over the melted features: width costs rows, not plan size,
    and only running moments are shuffled.
    """
    tall = df.select(
        numeric_or_null(target).alias("__y"), *[numeric_or_null(f).alias(f) for f in features]
    ).unpivot(["__y"], [as_col(f) for f in features], "feature", "__x")
    return (
        tall.groupBy("feature")
        .agg(safe_corr(F.col("__x"), F.col("__y")).alias("corr"))
        .withColumn("abs_corr", F.abs("corr"))
        .orderBy(F.desc_nulls_last("abs_corr"), "feature")
    )


def error_vs_feature(df: DataFrame, features: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Correlation of the prediction error (actual - predicted) with every feature."""
    error = numeric_or_null(actual) - numeric_or_null(predicted)
    return corr_with_target(df.withColumn("__error", error), features, "__error")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix as (feature, other, corr) rows, each pair over the rows that know both.

    One aggregate of sums over pairs, whatever the number of columns; values are shifted by
    their column's mean first. A pair of which one side is constant gives null.
    """
    p = len(columns)
    data = df.select(*[numeric_or_null(c).alias(c) for c in columns])
    centre = data.agg(*[F.avg(as_col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shifted = F.array(*[as_col(c) - F.lit(float(centre[i] or 0.0)) for i, c in enumerate(columns)])
    known = F.transform("__x", lambda v: v.isNotNull().cast("double"))
    filled = F.transform("__x", lambda v: F.coalesce(v, F.lit(0.0)))

    def pairs(a: str, b: str) -> Column:
        return F.flatten(F.transform(a, lambda v: F.transform(b, lambda w: v * w)))

    prepared = data.select(shifted.alias("__x")).select(known.alias("k"), filled.alias("x"))
    prepared = prepared.withColumn("xx", F.transform("x", lambda v: v * v))
    # Per ordered pair (i, j): count, sum of x_i, sum of x_i squared, sum of x_i x_j.
    sums = vector_sums(prepared, F.concat(pairs("k", "k"), pairs("x", "k"), pairs("xx", "k"), pairs("x", "x")))
    rows = []
    if sums is not None:
        n, s, ss, sp = sums.reshape(4, p, p)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            value = None
            if sums is not None and n[i, j] > 0:
                mean_a, mean_b = s[i, j] / n[i, j], s[j, i] / n[i, j]
                var_a, var_b = ss[i, j] / n[i, j] - mean_a**2, ss[j, i] / n[i, j] - mean_b**2
                # Squares of shifted values lose what is small against the column's level.
                floor_a, floor_b = (1e-13 * (ss[q] / n[i, j] + (centre[c] or 0.0) ** 2) for q, c in (((i, j), i), ((j, i), j)))
                if var_a > floor_a and var_b > floor_b:
                    cov = sp[i, j] / n[i, j] - mean_a * mean_b
                    value = float(max(-1.0, min(1.0, cov / (var_a * var_b) ** 0.5)))
            rows.append((a, b, value))
    return df.sparkSession.createDataFrame(rows, "feature string, other string, corr double")


def vector_columns(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Spread an array or vector column into named double columns."""
    arr = as_col(column)
    if dict(df.dtypes)[column] == "vector":
        arr = vector_to_array(arr)
    return df.select("*", *[F.get(arr, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
