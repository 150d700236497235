"""Preprocessing fitted on a training table and applied to any other.

Every fit reduces the table to a few numbers or category lists and returns built-in
``pyspark.ml`` stages (SQLTransformer, StringIndexerModel, ...), so a fitted
pipeline runs in generated code and can be saved and loaded anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, numeric_or_null
from cohortlens.operators.ranks import select_quantiles

# One-hot output column of a categorical input; stripped again in feature names.
ONE_HOT_SUFFIX = "__onehot"


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def replace_columns(exprs: Mapping[str, str]) -> SQLTransformer:
    """A stage that swaps columns for SQL expressions and keeps the others."""
    gone = ", ".join(f"`{c}`" for c in exprs)
    made = ", ".join(f"{e} AS `{c}`" for c, e in exprs.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {made} FROM __THIS__")


def numeric_sql(column: str) -> str:
    return f"nanvl(try_cast(`{column}` AS DOUBLE), NULL)"


def fit_medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float]:
    """Median of every column; columns without a value are left out.

    Exact ones take two or three aggregate passes over all columns together and shuffle
    no values; ``exact=False`` is a single sketch pass.
    """
    if not columns:
        return {}
    if exact:
        return select_quantiles(df, {c: numeric_or_null(c) for c in columns}, 0.5)
    row = df.agg(
        *[F.percentile_approx(numeric_or_null(c), 0.5).alias(f"m{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns) if row[f"m{i}"] is not None}


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, level, n) for all categorical columns in one grouped pass."""
    wide = df.select(*[as_col(c).cast("string").alias(c) for c in columns])
    return (
        wide.unpivot([], [as_col(c) for c in columns], "feature", "level")
        .where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value of every column; the smallest one on a tie."""
    if not columns:
        return {}
    best = level_counts(df, columns).groupBy("feature").agg(
        F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode")
    )
    return {r.feature: r.mode for r in best.collect()}


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted category list of every column.

    The lists become model columns, so they are read to the driver as they are, one level
    at a time; they have no limit.
    """
    out: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        for r in level_counts(df, columns).select("feature", "level").toLocalIterator():
            out[r.feature].append(r.level)
    return {c: sorted(levels) for c, levels in out.items()}


def impute_median(df: DataFrame, columns: Sequence[str], exact: bool = True) -> Transformer:
    medians = fit_medians(df, columns, exact)
    return replace_columns(
        {c: f"coalesce({numeric_sql(c)}, {sql_literal(m)})" for c, m in medians.items()}
    )


def impute_mode(df: DataFrame, columns: Sequence[str]) -> Transformer:
    modes = fit_modes(df, columns)
    return replace_columns({c: f"coalesce(`{c}`, {sql_literal(m)})" for c, m in modes.items()})


def fit_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, float, float]]:
    """(rows, known, mean, population variance) of every column from one aggregate."""
    stats = []
    for i, c in enumerate(columns):
        x = numeric_or_null(c)
        stats += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.var_pop(x).alias(f"v{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *stats).first()
    return {
        c: (row["rows"], row[f"n{i}"], row[f"m{i}"], row[f"v{i}"]) for i, c in enumerate(columns)
    }


def _scaled(expr: str, mean: float, variance: float) -> str:
    if variance <= 0:
        return f"({expr}) * 0D"
    return f"(({expr}) - {sql_literal(mean)}) / {sql_literal(variance ** 0.5)}"


def standard_scale(df: DataFrame, columns: Sequence[str]) -> Transformer:
    """Zero mean and unit population variance; a constant column becomes 0."""
    return replace_columns(
        {
            c: _scaled(numeric_sql(c), mean, variance)
            for c, (_, known, mean, variance) in fit_moments(df, columns).items()
            if known
        }
    )


def dummies_drop_first(df: DataFrame, columns: Sequence[str]) -> Transformer:
    """0/1 columns for all but the first sorted level; nulls are 0 everywhere."""
    made = {
        f"{c}_{level}": f"CAST(coalesce(CAST(`{c}` AS STRING) = {sql_literal(level)}, false) AS INT)"
        for c, levels in fit_levels(df, columns).items()
        for level in levels[1:]
    }
    gone = ", ".join(f"`{c}`" for c in columns)
    exprs = "".join(f", {e} AS `{name}`" for name, e in made.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}){exprs} FROM __THIS__")


def one_hot(df: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """One-hot vectors ``<column>__onehot`` with all levels; unseen values are all zero."""
    return PipelineModel(_one_hot_stages(df, fit_levels(df, columns)))


def _one_hot_stages(df: DataFrame, levels: Mapping[str, Iterable[str]]) -> list[Transformer]:
    columns = [c for c in levels if levels[c]]
    if not columns:
        return []
    indexed = [f"{c}__index" for c in columns]
    # One indexer per column: a joint one needs level lists of equal length.
    indexers = [
        StringIndexerModel.from_labels(
            list(levels[c]), inputCol=c, outputCol=out, handleInvalid="keep"
        )
        for c, out in zip(columns, indexed)
    ]
    # The unseen slot is the last index, and the encoder drops the last one. Its fit
    # reads the level lists from the column metadata and scans nothing.
    encoder = OneHotEncoder(
        inputCols=indexed,
        outputCols=[f"{c}{ONE_HOT_SUFFIX}" for c in columns],
        dropLast=True,
    )
    return [*indexers, encoder.fit(PipelineModel(indexers).transform(df))]


def label_encoder(df: DataFrame, column: str, out: str = "label") -> StringIndexerModel:
    """Class indices in alphabetical order."""
    levels = fit_levels(df, [column])[column]
    return StringIndexerModel.from_arrays_of_labels(
        [levels], inputCols=[column], outputCols=[out], handleInvalid="error"
    )


def label_decoder(labels: Sequence[str], column: str = "prediction", out: str = "predicted") -> Transformer:
    return IndexToString(inputCol=column, outputCol=out, labels=list(labels))


class Preprocessor(Estimator):
    """Impute, scale, one-hot and assemble, fitted on the training rows only.

    Numeric columns: median, then standard scaling. Categorical: most frequent value,
    then one-hot. ``passthrough`` columns enter the vector unchanged; all others are left out of it.
    A few aggregate passes over the training table, whatever the number of columns; its
    input columns are cached for them unless ``cache`` is off or the table already is.
    """

    def __init__(
        self,
        numeric: Sequence[str] = (),
        categorical: Sequence[str] = (),
        passthrough: Sequence[str] = (),
        scale: bool = True,
        exact: bool = True,
        output: str = "features",
        cache: bool = True,
    ) -> None:
        super().__init__()
        self.numeric = list(numeric)
        self.categorical = list(categorical)
        self.passthrough = list(passthrough)
        self.scale = scale
        self.exact = exact
        self.output = output
        self.cache = cache

    def consumed(self) -> list[str]:
        """Columns that only lead to the vector: categories and what is made of them, and scaled or imputed numbers."""
        return [*self.numeric, *self.categorical, *(f"{c}{s}" for c in self.categorical for s in ("__index", ONE_HOT_SUFFIX))]

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        inputs = dataset.select(*[as_col(c) for c in [*self.numeric, *self.categorical, *self.passthrough]])
        if not self.cache or dataset.storageLevel.useMemory:
            return self._fit_inputs(inputs)
        # The fit passes read only these columns, each time anew unless kept.
        inputs = inputs.persist()
        try:
            return self._fit_inputs(inputs)
        finally:
            inputs.unpersist()

    def _fit_inputs(self, dataset: DataFrame) -> PipelineModel:
        medians = fit_medians(dataset, self.numeric, self.exact)
        moments = fit_moments(dataset, list(medians)) if self.scale and medians else {}
        levels = fit_levels(dataset, self.categorical)
        modes = fit_modes(dataset, self.categorical)
        exprs = {}
        for c, median in medians.items():
            expr = f"coalesce({numeric_sql(c)}, {sql_literal(median)})"
            if self.scale:
                rows, known, mean, variance = moments[c]
                share = (rows - known) / rows
                gap = median - mean
                # Moments after imputation, without another pass.
                expr = _scaled(
                    expr, mean + share * gap, (1 - share) * variance + share * (1 - share) * gap * gap
                )
            exprs[c] = expr
        for c, mode in modes.items():
            exprs[c] = f"coalesce(CAST(`{c}` AS STRING), {sql_literal(mode)})"
        stages: list[Transformer] = [replace_columns(exprs)] if exprs else []
        prepared = PipelineModel(stages).transform(dataset)
        encoded = _one_hot_stages(prepared, levels)
        assembler = VectorAssembler(
            inputCols=[
                *medians,
                *self.passthrough,
                *[f"{c}{ONE_HOT_SUFFIX}" for c in modes],
            ],
            outputCol=self.output,
        )
        return PipelineModel([*stages, *encoded, assembler])


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, read from the column metadata."""
    attrs = df.schema[column].metadata["ml_attr"]
    named = {a["idx"]: a["name"] for group in attrs.get("attrs", {}).values() for a in group}
    return [
        named.get(i, f"feature_{i}").replace(ONE_HOT_SUFFIX, "")
        for i in range(attrs["num_attrs"])
    ]
