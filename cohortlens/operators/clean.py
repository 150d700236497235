"""Projection, cleaning and filtering operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import as_col, hash_uniform, is_missing, map_values, numeric_or_null


def select_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[as_col(c) for c in wanted if c in df.columns])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast the listed columns that exist to double; bad text becomes null."""
    return df.withColumns({c: numeric_or_null(c) for c in columns if c in df.columns})


def map_values_strict(df: DataFrame, column: str, mapping: Mapping[str, object]) -> DataFrame:
    """Recode only if every value present (null included) has an entry.

    The check is one aggregate; values without an entry never leave the executors.
    """
    x = as_col(column)
    unmapped = df.agg(F.max(F.when(x.isNull() | ~x.isin(*mapping), 1)).alias("u")).first()["u"]
    return df if unmapped else df.withColumn(column, map_values(x, mapping))


def filter_timepoint(df: DataFrame, timepoint: str, column: str = "timepoint") -> DataFrame:
    return df.where(as_col(column) == timepoint)


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in the listed columns, or in any column."""
    return df.dropna(subset=list(subset) if subset else None)


def null_fractions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(feature, n_rows, n_null, null_fraction)`` from one aggregate pass; NaN counts as null."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    agg = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(is_missing(c, kinds[c])).alias(f"__n{i}") for i, c in enumerate(names)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col("__rows").alias("n_rows"),
            F.col(f"__n{i}").alias("n_null"),
            F.try_divide(F.col(f"__n{i}").cast("double"), F.col("__rows")).alias("null_fraction"),
        )
        for i, c in enumerate(names)
    ]
    return agg.select(F.inline(F.array(*entries)))


def drop_sparse_columns(
    df: DataFrame, max_null_fraction: float = 0.5, keep: Iterable[str] = ()
) -> DataFrame:
    """Drop columns whose null share is strictly above the limit.

    One row per column reaches the driver; the rest stays a lazy projection.
    """
    kept = set(keep)
    checked = [c for c in df.columns if c not in kept]
    sparse = [
        r.feature
        for r in null_fractions(df, checked).collect()
        if r.null_fraction is not None and r.null_fraction > max_null_fraction
    ]
    return df.drop(*sparse)


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(as_col(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def drop_rare_classes(df: DataFrame, column: str, min_count: int = 2) -> DataFrame:
    """Remove rows of known classes with fewer than ``min_count`` rows; rows without a class stay.

    One anti join, whatever the number of classes; nothing is collected.
    """
    rare = class_counts(df.where(as_col(column).isNotNull()), column).where(F.col("n") < min_count)
    return df.join(rare.select(as_col(column)), column, "left_anti")


def exclude_keys(df: DataFrame, keys: DataFrame | Sequence[object], column: str) -> DataFrame:
    """Rows whose key is not listed: a literal filter, or an anti join. Rows without a key stay."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(as_col(column)), column, "left_anti")
    return df.where(~F.coalesce(as_col(column).isin([k for k in keys if k is not None]), F.lit(False)))


def lookup_rows(df: DataFrame, keys: DataFrame | Sequence[object], column: str) -> DataFrame:
    """Rows whose key is listed: a literal filter, or a semi join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(column), column, "left_semi")
    return df.where(as_col(column).isin(list(keys)))


def stack_groups(groups: Mapping[str, DataFrame], tag: str = "timepoint") -> DataFrame:
    """Union of frames by column name, each tagged with its group."""
    out = None
    for name, df in groups.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def dedupe_first(df: DataFrame, subject: str, order: Sequence[str]) -> DataFrame:
    """The first row of each subject in the given order.

    ``min_by`` keeps one row per subject on the map side, so a subject that owns
    a third of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c != subject]
    first = F.min_by(
        F.struct(*[as_col(c) for c in rest]), F.struct(*[as_col(c) for c in order])
    ).alias("__first")
    return (
        df.groupBy(as_col(subject).alias(subject))
        .agg(first)
        .select(*[F.col("__first")[c].alias(c) if c in rest else as_col(c) for c in df.columns])
    )


def sample_n(df: DataFrame, key: str, n: int, seed: object = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run."""
    return (
        df.withColumn("__u", hash_uniform(key, seed))
        .orderBy("__u", as_col(key))
        .limit(n)
        .drop("__u")
    )


def threshold_features(corr: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Rows of a correlation table at or above the absolute threshold."""
    return corr.where(F.abs(F.col("corr")) >= threshold)


def align_schema(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Conform new rows to a training schema.

    Missing columns become null, extra ones are dropped, values that do not
    cast become null. Stateless, so it also applies to a streaming DataFrame.
    """
    def field(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if df.schema[f.name].dataType == f.dataType:
            return as_col(f.name).alias(f.name)
        return as_col(f.name).try_cast(f.dataType).alias(f.name)

    names = {f.name for f in schema}
    return df.select(*[as_col(c) for c in keep if c not in names], *[field(f) for f in schema])


def check_trainable(df: DataFrame, target: str, min_rows: int = 5, min_classes: int = 2) -> dict:
    """Row and class counts; raises when there is too little to fit on."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(as_col(target)).alias("classes")
    ).first()
    if row.n == 0:
        raise ValueError("no rows left to fit on")
    if row.classes < min_classes:
        raise ValueError(f"{row.classes} classes in {target!r}, need {min_classes}")
    if row.n < min_rows:
        raise ValueError(f"{row.n} rows, need {min_rows}")
    return row.asDict()
