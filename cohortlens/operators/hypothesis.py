"""Two-sample tests between timepoints, for any number of measures in one job."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exact
from cohortlens.functions.columns import as_col, kolmogorov_sf, normal_sf
from cohortlens.operators.ranks import cumulative_counts, long_measures, quantile_column
from cohortlens.shipping import ship_package

METHODS = ("auto", "exact", "asymptotic")


def _two_sample_counts(
    df: DataFrame, measures: Sequence[str], group: str, a: object, b: object, by: Sequence[str] = ()
) -> DataFrame:
    tall = long_measures(df.where(as_col(group).isin(a, b)), measures, [*by, group])
    in_a, in_b = as_col(group) == F.lit(a), as_col(group) == F.lit(b)
    return cumulative_counts(
        tall,
        "value",
        [*by, "measure"],
        {"na": in_a.cast("int"), "nb": in_b.cast("int")},
        few_groups=not by,
    )


def rank_sum_parts() -> list[Column]:
    """Aggregates over two-sample counts: group sizes, U of the first group, tie term."""
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    t = na + nb
    return [
        F.max("na_total").alias("n1"),
        F.max("nb_total").alias("n2"),
        F.sum(na * (F.col("nb_before") + nb / 2)).alias("u1"),
        F.sum(t * t * t - t).alias("ties"),
    ]


def ks_part() -> Column:
    """Largest distance between the two empirical distribution functions."""
    fa = F.try_divide((F.col("na_before") + F.col("na")).cast("double"), F.col("na_total"))
    fb = F.try_divide((F.col("nb_before") + F.col("nb")).cast("double"), F.col("nb_total"))
    return F.max(F.abs(fa - fb)).alias("ks_d")


def rank_sum_p(alternative: str = "two-sided") -> Column:
    """Normal-approximation p-value with tie and continuity correction."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0)))
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    if alternative == "two-sided":
        u = F.greatest(F.col("u1"), n1 * n2 - F.col("u1"))
    elif alternative == "greater":
        u = F.col("u1")
    elif alternative == "less":
        u = n1 * n2 - F.col("u1")
    else:
        raise ValueError(f"unknown alternative {alternative!r}")
    distance = u - n1 * n2 / 2 - 0.5
    tail = normal_sf(F.try_divide(distance, sd))
    # All values equal: no evidence either way.
    p = F.when(sd == 0, F.lit(1.0))
    if alternative == "two-sided":
        return p.otherwise(F.least(F.lit(1.0), tail * 2))
    return p.otherwise(tail)


def ks_p() -> Column:
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return kolmogorov_sf(F.col("ks_d") * F.sqrt(F.try_divide(n1 * n2, n1 + n2)))


def _with_exact(parts: DataFrame, method: str, approximate: Column, fits: Column, counted: Column) -> Column:
    """The p-value by method: counted where the sizes allow it, else by its limiting distribution."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "asymptotic":
        return approximate
    ship_package(parts.sparkSession)
    if method == "exact":
        return F.when(fits, counted)
    return F.when(fits, counted).otherwise(approximate)


def rank_sum_p_value(parts: DataFrame, alternative: str = "two-sided", method: str = "auto") -> Column:
    """P-value of the rank test from ``rank_sum_parts``.

    ``auto`` counts arrangements where no values are tied and the smaller group has at most 8 (and U at
    most a million places), and is the normal approximation elsewhere; ``exact`` is null there.
    """

    @F.pandas_udf("double")
    def counted(u1: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        values = [exact.rank_sum_exact(*row, alternative) if row[0] == row[0] else None for row in zip(u1, n1, n2)]
        return pd.Series(values, dtype="float64")

    n1, n2 = F.col("n1"), F.col("n2")
    fits = (F.col("ties") == 0) & (F.least(n1, n2) <= exact.RANK_SMALLER) & (n1.cast("double") * n2 <= exact.RANK_PLACES)
    fits = fits & (F.least(n1, n2) > 0)
    shown = counted(F.when(fits, F.col("u1")), F.when(fits, n1).otherwise(1), F.when(fits, n2).otherwise(1))
    return _with_exact(parts, method, rank_sum_p(alternative), fits, shown)


def ks_p_value(parts: DataFrame, method: str = "auto") -> Column:
    """P-value of the distribution test; ``auto`` counts paths for groups of at most 10,000, else takes the limit."""

    @F.pandas_udf("double")
    def counted(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        values = [exact.ks_exact(*row) if row[0] == row[0] else None for row in zip(d, n1, n2)]
        return pd.Series(values, dtype="float64")

    n1, n2 = F.col("n1"), F.col("n2")
    fits = (F.greatest(n1, n2) <= exact.KS_LARGEST) & (F.least(n1, n2) > 0)
    shown = counted(F.when(fits, F.col("ks_d")), F.when(fits, n1).otherwise(1), F.when(fits, n2).otherwise(1))
    return _with_exact(parts, method, ks_p(), fits, shown)


def mann_whitney(
    df: DataFrame,
    measures: Sequence[str],
    group: str = "timepoint",
    a: object = "T0",
    b: object = "T2",
    alternative: str = "two-sided",
    method: str = "asymptotic",
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(*by, measure, n1, n2, u1, p_value)``; measures without both groups are left out.

    ``by`` tests within each group of rows. See ``rank_sum_p_value`` for ``method``.
    """
    parts = _two_sample_counts(df, measures, group, a, b, by).groupBy(*[as_col(c) for c in by], "measure").agg(*rank_sum_parts())
    tested = parts.where((F.col("n1") > 0) & (F.col("n2") > 0))
    return tested.select(*[as_col(c) for c in by], "measure", "n1", "n2", "u1", rank_sum_p_value(tested, alternative, method).alias("p_value"))


def ks_2sample(
    df: DataFrame,
    measures: Sequence[str],
    group: str = "timepoint",
    a: object = "T0",
    b: object = "T2",
    method: str = "asymptotic",
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(*by, measure, n1, n2, ks_d, p_value)`` with the two-sided p-value; see ``ks_p_value`` for ``method``."""
    parts = (
        _two_sample_counts(df, measures, group, a, b, by)
        .groupBy(*[as_col(c) for c in by], "measure")
        .agg(F.max("na_total").alias("n1"), F.max("nb_total").alias("n2"), ks_part())
    )
    tested = parts.where((F.col("n1") > 0) & (F.col("n2") > 0))
    return tested.select(*[as_col(c) for c in by], "measure", "n1", "n2", "ks_d", ks_p_value(tested, method).alias("p_value"))


def change_verdict(p_median: Column, p_distribution: Column, alpha: float = 0.05) -> Column:
    """Which of median and distribution changed significantly."""
    return (
        F.when((p_median < alpha) & (p_distribution < alpha), F.lit("both"))
        .when(p_median < alpha, F.lit("median"))
        .when(p_distribution < alpha, F.lit("distribution"))
        .otherwise(F.lit("none"))
    )


def decrease_verdict(p: Column) -> Column:
    """Strength of a one-sided decrease: below 0.001, below 0.05, or none."""
    return (
        F.when(p < 0.001, F.lit("p < 0.001"))
        .when(p < 0.05, F.lit("p < 0.05"))
        .otherwise(F.lit("none"))
    )


def biomarker_screen(
    df: DataFrame,
    measures: Sequence[str],
    group: str = "timepoint",
    a: object = "T0",
    b: object = "T2",
    alpha: float = 0.05,
    method: str = "asymptotic",
) -> DataFrame:
    """Medians, rank test, distribution test and verdict for every measure.

    Both tests and both medians come out of the same running counts: one job,
    however many measures. ``method`` is that of both tests.
    """
    counts = _two_sample_counts(df, measures, group, a, b)

    parts = counts.groupBy("measure").agg(
        *rank_sum_parts(),
        ks_part(),
        quantile_column(0.5, "na").alias("median_a"),
        quantile_column(0.5, "nb").alias("median_b"),
    )
    both = parts.where((F.col("n1") > 0) & (F.col("n2") > 0))
    tested = both.withColumns({"p_median": rank_sum_p_value(both, method=method), "p_distribution": ks_p_value(both, method)})
    return tested.select(
        "measure",
        "n1",
        "n2",
        "median_a",
        "median_b",
        "u1",
        "p_median",
        "ks_d",
        "p_distribution",
        change_verdict(F.col("p_median"), F.col("p_distribution"), alpha).alias("verdict"),
    )
