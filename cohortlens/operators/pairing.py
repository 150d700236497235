"""Pairing of timepoints per subject and changes between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, numeric_or_null


def pair_timepoints(
    df: DataFrame,
    measures: Sequence[str],
    subject: str = "subject_id",
    timepoint: str = "timepoint",
    timepoints: Sequence[str] = ("T0", "T2"),
    require: str = "each",
) -> DataFrame:
    """One row per subject with ``<measure>_<timepoint>`` means.

    All measures and timepoints are averaged in a single grouped pass: one shuffle,
    combined on the map side, in place of a pivot and a join per measure. Listing
    the timepoints keeps others out and lets the filter reach the scan.

    ``require='each'`` keeps subjects that have, for every measure, a value at some
    listed timepoint (the effect of inner-joining per-measure pivots); ``'any'`` keeps
    subjects with at least one value.
    """
    t = as_col(timepoint)
    means = [
        F.avg(F.when(t == tp, numeric_or_null(m))).alias(f"{m}_{tp}")
        for m in measures
        for tp in timepoints
    ]
    paired = (
        df.where(t.isin(*timepoints)).groupBy(as_col(subject).alias(subject)).agg(*means)
    )
    present = [F.coalesce(*[F.col(f"{m}_{tp}") for tp in timepoints]).isNotNull() for m in measures]
    keep = present[0]
    for p in present[1:]:
        keep = keep & p if require == "each" else keep | p
    return paired.where(keep)


def delta(measure: str, before: str = "T0", after: str = "T2") -> Column:
    return F.col(f"{measure}_{after}") - F.col(f"{measure}_{before}")


def with_changes(
    paired: DataFrame, measures: Sequence[str], before: str = "T0", after: str = "T2"
) -> DataFrame:
    """Add ``<measure>_Change`` for every measure."""
    return paired.withColumns({f"{m}_Change": delta(m, before, after) for m in measures})


def join_measures(tables: Sequence[DataFrame], subject: str = "subject_id") -> DataFrame:
    """Inner equi-join of per-measure tables on the subject key.

    For measures of one table prefer ``pair_timepoints``, which needs no join.
    """
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, subject, "inner")
    return out
