"""Column expressions: all run JVM-side inside generated code."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def numeric_or_null(c: str | Column) -> Column:
    """Number, or null where the text is not one; NaN counts as missing."""
    x = as_col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def is_missing(c: str, kind: str) -> Column:
    """Whether a column of the given type is null or NaN."""
    x = as_col(c)
    return x.isNull() | F.isnan(x) if kind in ("float", "double") else x.isNull()


def truncate_to_int(c: str | Column) -> Column:
    """Integer part, rounding toward zero; null for text that is no number and beyond 32 bits."""
    return as_col(c).try_cast("double").try_cast("int")


def map_values(c: str | Column, mapping: Mapping[str, object]) -> Column:
    """Recode; a value without an entry becomes null."""
    x = as_col(c)
    out = F.lit(None)
    for old, new in mapping.items():
        out = F.when(x == F.lit(old), F.lit(new)).otherwise(out)
    return out


def cut_bins(
    c: str | Column,
    edges: Sequence[float],
    labels: Sequence[object],
    include_lowest: bool = True,
) -> Column:
    """Right-closed bins ``(e0,e1], (e1,e2] ...``; values outside become null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = as_col(c)
    low = x >= edges[0] if include_lowest else x > edges[0]
    out = F.when(~low, F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(x <= hi, F.lit(label))
    return out


def hash_uniform(key: str | Column, seed: object) -> Column:
    """A uniform number in [0, 1) that depends only on the key and the seed.

    Splits, folds and samples built on it need no shuffle and come out the same
    however the table is partitioned or re-read after an executor loss.
    """
    digest = F.md5(F.concat(as_col(key).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# Coefficients of the Chebyshev-fitted complementary error function,
# constant term first.
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z / 2)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(coefficient)
    upper = t * F.exp(poly - z * z)
    return F.when(x >= 0, upper).otherwise(F.lit(2.0) - upper)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    return erfc(z / math.sqrt(2.0)) / 2


def kolmogorov_sf(lam: Column) -> Column:
    """Upper tail of the limiting Kolmogorov distribution.

    The alternating series converges fast for large arguments, its theta-function
    twin for small ones.
    """
    large = sum(
        (F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in range(1, 6)),
        F.lit(0.0),
    )
    series = sum(
        (
            F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8) / (lam * lam))
            for k in range(1, 5)
        ),
        F.lit(0.0),
    )
    small = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * series
    tail = F.when(lam <= 0.05, F.lit(1.0)).when(lam < 1.18, small).otherwise(large)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))


def percent_error(difference: Column, actual: Column, digits: int = 2) -> Column:
    """Signed error in percent of the actual value; null where that is zero."""
    return F.round(F.when(actual != 0, F.try_divide(difference, actual) * 100), digits)


def error_columns(actual: str, predicted: str, tolerance: float = 1.0) -> dict[str, Column]:
    """Per-row error columns of a prediction table."""
    a, p = as_col(actual), as_col(predicted)
    return {
        "difference": p - a,
        "residual": a - p,
        "abs_error": F.abs(p - a),
        "within_tolerance": F.abs(p - a) < tolerance,
        "pct_error": percent_error(F.round(p - a, 2), a),
    }


def format_probabilities(probability: Column, classes: Sequence[str]) -> Column:
    """``"class=12.3%, ..."`` from an array of class probabilities."""
    parts = [
        F.concat(F.lit(f"{name}="), F.format_string("%.1f%%", F.get(probability, F.lit(i)) * 100))
        for i, name in enumerate(classes)
    ]
    return F.concat_ws(", ", *parts)
