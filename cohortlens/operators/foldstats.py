"""Linear models over folds and grids from additive fold statistics.

One grouped aggregate takes the count, sums and products of every fold. The training rows of a fold are
then all sums without that fold's, so least squares, ridge, lasso and elastic net of any grid and all folds
cost that one scan; percentage errors, which do not follow from products, cost one more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import numeric_or_null
from cohortlens.operators.linear import PILOT_ROWS, LinearFit, Moments, descend, symmetric
from cohortlens.shipping import ship_package


@dataclass(frozen=True)
class Penalty:
    """The penalty of ``|y - Xb|^2 / 2n + l1 |b|_1 + l2 |b|^2 / 2``.

    ``total`` is a further ridge weight for the whole sum of squares (``|y - Xb|^2 + total |b|^2``), and
    ``label_scaled`` divides l2 by the label's deviation, as a label scaled to deviation one implies.
    """

    l1: float = 0.0
    l2: float = 0.0
    total: float = 0.0
    label_scaled: bool = False

    @staticmethod
    def elastic(alpha: float, l1_ratio: float, label_scaled: bool = False) -> Penalty:
        return Penalty(alpha * l1_ratio, alpha * (1 - l1_ratio), 0.0, label_scaled)

    def ridge(self, m: Moments) -> float:
        scale = math.sqrt(max(float(m.cov[-1, -1]), 0.0)) if self.label_scaled else 1.0
        return (self.l2 / scale if scale else 0.0) + self.total / m.n


def solve(m: Moments, penalty: Penalty, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Slopes and intercept from moments of features and (last) target; minimum norm without any penalty."""
    xx, xy = m.cov[:-1, :-1], m.cov[:-1, -1]
    l2 = penalty.ridge(m)
    if penalty.l1:
        slopes = descend(xx, xy, penalty.l1, l2, start)
    else:
        slopes = np.linalg.lstsq(xx + l2 * np.eye(len(xx)), xy, rcond=None)[0]
    return slopes, float(m.mean[-1] - m.mean[:-1] @ slopes)


@dataclass(frozen=True)
class FoldMoments:
    """Counts, sums and products of each fold about one common point."""

    pivot: np.ndarray
    counts: dict[int, float]
    sums: dict[int, np.ndarray]
    products: dict[int, np.ndarray]

    def _moments(self, folds: Sequence[int]) -> Moments | None:
        n = sum(self.counts[f] for f in folds)
        if not n:
            return None
        off = sum(self.sums[f] for f in folds) / n
        return Moments(int(n), self.pivot + off, sum(self.products[f] for f in folds) / n - np.outer(off, off))

    def of(self, fold: int) -> Moments | None:
        """The rows of a fold; None without any."""
        return self._moments([f for f in self.counts if f == fold])

    def without(self, fold: int) -> Moments | None:
        """The rows of all other folds."""
        return self._moments([f for f in self.counts if f != fold])

    def all(self) -> Moments | None:
        return self._moments(list(self.counts))


def _array(df: DataFrame, features: str | Sequence[str]) -> Column:
    """The features as an array: a vector or array column, or named columns."""
    if not isinstance(features, str):
        return F.array(*[numeric_or_null(c) for c in features])
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")


def _known(df: DataFrame, features: str | Sequence[str], target: str, fold_col: str) -> DataFrame:
    """Complete rows as ``fold``, ``x`` and ``y``."""
    rows = df.select(F.col(fold_col).cast("int").alias("fold"), _array(df, features).alias("x"), numeric_or_null(target).alias("y"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.where(F.col("fold").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & whole)


def _products(pivot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fold of a task's rows: their number, sums and products (upper half) about the pivot."""
    upper = np.triu_indices(len(pivot))
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        folds = batch.column(0).to_numpy()
        z = np.column_stack([batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(2).to_numpy()]) - pivot
        for fold in np.unique(folds).tolist():
            own = z[folds == fold]
            sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
            total[fold] = total[fold] + sums if fold in total else sums
    for fold, sums in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([fold], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["fold", "sums"]
        )


def _fold_sums(rows: DataFrame, pivot: np.ndarray) -> FoldMoments:
    ship_package(rows.sparkSession)
    p = len(pivot)
    parts = rows.select("fold", "x", "y").mapInArrow(lambda batches: _products(pivot, batches), "fold int, sums array<double>")
    vectors = parts.select("fold", array_to_vector("sums").alias("v"))
    found = {r.fold: r.s.toArray() for r in vectors.groupBy("fold").agg(Summarizer.sum(F.col("v")).alias("s")).collect()}
    return FoldMoments(
        pivot,
        {f: s[0] for f, s in found.items()},
        {f: s[1 : p + 1] for f, s in found.items()},
        {f: symmetric(s[p + 1 :], p) for f, s in found.items()},
    )


def _moments(rows: DataFrame) -> FoldMoments:
    """Moments of rows as ``_known`` gives them."""
    first = rows.select("x", "y").limit(PILOT_ROWS).collect()
    if not first:
        return FoldMoments(np.zeros(0), {}, {}, {})
    found = _fold_sums(rows, np.mean([[*r.x, r.y] for r in first], axis=0))
    whole = found.all()
    off = whole.mean - found.pivot
    if (off * off > 1e6 * np.diag(whole.cov)).any():
        found = _fold_sums(rows, whole.mean)
    return found


def fold_moments(df: DataFrame, features: str | Sequence[str], target: str, fold_col: str = "fold") -> FoldMoments:
    """Moments of features and target by fold, over complete rows, in one scan; the driver gets a row per fold.

    Sums are taken about the mean of the first rows. Should those lie many deviations off the mean
    (sorted or coded values), the sums are taken again about the mean itself.
    """
    return _moments(_known(df, features, target, fold_col))


@dataclass(frozen=True)
class LinearCandidate:
    """A linear model that folds, grids and boards may score from fold statistics.

    ``features`` is a vector column or a list of columns.
    """

    features: str | tuple[str, ...] = "features"
    penalty: Penalty = field(default_factory=Penalty)

    def scored(self, train: DataFrame, held: DataFrame, label: str) -> DataFrame:
        """The validation rows with a ``prediction``, for folds whose rows are preprocessed apart."""
        moments = fold_moments(train.withColumn("__fold", F.lit(0)), self.features, label, "__fold").all()
        slopes, intercept = solve(moments, self.penalty)
        return MomentRegressionModel(self.features, tuple(map(float, slopes)), intercept).transform(held)


def _fit_folds(moments: FoldMoments, penalties: Sequence[Penalty], folds: int) -> dict[int, np.ndarray]:
    """By fold with training and validation rows: a row (slopes, intercept) per penalty.

    Lasso paths start from the solution of the next stronger penalty.
    """
    out = {}
    order = sorted(range(len(penalties)), key=lambda i: -penalties[i].l1)
    for fold in range(folds):
        train = moments.without(fold)
        if train is None or moments.of(fold) is None:
            continue
        table, last = np.empty((len(penalties), len(train.mean))), None
        for i in order:
            slopes, intercept = solve(train, penalties[i], last)
            last = slopes if penalties[i].l1 else last
            table[i] = [*slopes, intercept]
        out[fold] = table
    return out


def _mse(held: Moments, row: np.ndarray) -> float:
    slopes, intercept = row[:-1], row[-1]
    cov = held.cov
    bias = held.mean[-1] - intercept - held.mean[:-1] @ slopes
    spread = cov[-1, -1] - 2 * slopes @ cov[:-1, -1] + slopes @ cov[:-1, :-1] @ slopes
    return float(bias * bias + max(spread, 0.0))


def _absolute_sums(tables: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fold and candidate of a task's rows: sums of |error|, of |error / y| where y is not 0, their count, the largest |prediction|."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        folds, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        for fold in np.unique(folds).tolist():
            if fold not in tables:
                continue
            rows = folds == fold
            actual, table = y[rows], tables[fold]
            shown = x[rows] @ table[:, :-1].T + table[:, -1]
            error = np.abs(actual[:, None] - shown)
            some = actual != 0
            shares = (error[some] / np.abs(actual[some])[:, None]).sum(axis=0)
            new = np.stack([error.sum(axis=0), shares, np.full(len(table), float(some.sum())), np.abs(shown).max(axis=0)])
            if fold in total:
                total[fold][:3] += new[:3]
                total[fold][3] = np.maximum(total[fold][3], new[3])
            else:
                total[fold] = new
    for fold, sums in total.items():
        many = sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(many, fold), pa.int32()), pa.array(np.arange(many), pa.int32()), *(pa.array(s) for s in sums)],
            names=["fold", "candidate", "error", "share", "nonzero", "largest"],
        )


def score_folds(
    df: DataFrame,
    features: str | Sequence[str],
    target: str,
    penalties: Sequence[Penalty],
    folds: int,
    fold_col: str = "fold",
    metrics: Sequence[str] = ("r2", "rmse", "mape"),
) -> dict[tuple[int, int], dict[str, float]]:
    """Metrics by (fold, penalty number) on the rows held out; folds without rows on one side are left out.

    ``mse``, ``rmse`` and ``r2`` follow from the moments; ``mape`` and ``mae`` read the rows once more,
    all folds and penalties together. Definitions are those of ``regression_metrics``.
    """
    return _scored(df, features, target, penalties, folds, fold_col, metrics)[0]


def _scored(
    df: DataFrame,
    features: str | Sequence[str],
    target: str,
    penalties: Sequence[Penalty],
    folds: int,
    fold_col: str,
    metrics: Sequence[str],
) -> tuple[dict[tuple[int, int], dict[str, float]], FoldMoments]:
    """The scores, and the moments they come from; rows that are read twice are cached between."""
    rows, absolute = _known(df, features, target, fold_col), bool({"mape", "mae"} & set(metrics))
    rows = rows.persist() if absolute else rows
    try:
        moments = _moments(rows)
        tables = _fit_folds(moments, penalties, folds)
        out: dict[tuple[int, int], dict[str, float]] = {}
        for fold, table in tables.items():
            held = moments.of(fold)
            for i, row in enumerate(table):
                mse = _mse(held, row)
                var = float(held.cov[-1, -1])
                r2 = 1 - mse / var if var > 0 else float(mse == 0)
                out[fold, i] = {"n": held.n, "mse": mse, "rmse": math.sqrt(mse), "r2": r2}
        if tables and absolute:
            ship_package(df.sparkSession)
            sent = df.sparkSession.sparkContext.broadcast(tables)
            sums = rows.mapInArrow(
                lambda batches: _absolute_sums(sent.value, batches),
                "fold int, candidate int, error double, share double, nonzero double, largest double",
            )
            added = [F.sum(c).alias(c) for c in ("error", "share", "nonzero")]
            for r in sums.groupBy("fold", "candidate").agg(*added, F.max("largest").alias("largest")).collect():
                found = out[r.fold, r.candidate]
                found["mae"] = r.error / found["n"]
                found["mape"] = 100 * r.share / r.nonzero if r.nonzero else (math.inf if r.largest > 0 else 0.0)
    finally:
        if absolute:
            rows.unpersist()
    return out, moments


class MomentRegression(Estimator):
    """A linear model fitted from moments; ``alpha`` and ``l1_ratio`` are grid parameters.

    Minimises ``|y - Xb|^2 / 2n + alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2)`` with a free
    intercept; see ``Penalty`` for ``label_scaled``. Grid search scores every grid point on all folds from
    one set of fold statistics, which also gives the final fit.
    """

    alpha = Param(Params._dummy(), "alpha", "strength of the penalty", TypeConverters.toFloat)
    l1_ratio = Param(Params._dummy(), "l1_ratio", "share of the absolute penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        alpha: float = 0.0,
        l1_ratio: float = 0.0,
        label_scaled: bool = False,
        features: str = "features",
        label: str = "label",
    ) -> None:
        super().__init__()
        self.label_scaled, self.features, self.label = label_scaled, features, label
        self._setDefault(alpha=0.0, l1_ratio=0.0)
        self._set(alpha=alpha, l1_ratio=l1_ratio)

    def penalty(self, params: Mapping | None = None) -> Penalty:
        given = dict(params or {})
        alpha, ratio = (float(given.get(p, self.getOrDefault(p))) for p in (self.alpha, self.l1_ratio))
        if alpha < 0 or not 0 <= ratio <= 1:
            raise ValueError(f"alpha {alpha} or l1_ratio {ratio} out of range")
        return Penalty.elastic(alpha, ratio, self.label_scaled)

    def _model(self, moments: Moments | None, penalty: Penalty) -> MomentRegressionModel:
        if moments is None:
            raise ValueError("no complete rows")
        slopes, intercept = solve(moments, penalty)
        return MomentRegressionModel(self.features, tuple(map(float, slopes)), intercept)

    def _fit(self, dataset: DataFrame) -> MomentRegressionModel:
        rows = dataset.withColumn("__fold", F.lit(0))
        return self._model(fold_moments(rows, self.features, self.label, "__fold").all(), self.penalty())

    def score_folds(
        self, df: DataFrame, maps: Sequence[Mapping], evaluator: Evaluator, folds: int, fold_col: str
    ) -> tuple[list[float], dict[int, str], Callable[[Mapping], Model]]:
        """Mean score of each parameter set over the folds, why sets were rejected, and the fit on all rows."""
        scores, rejected, valid = [math.nan] * len(maps), {}, {}
        for i, given in enumerate(maps):
            try:
                valid[i] = self.penalty(given)
            except ValueError as error:
                if len(maps) == 1:
                    raise
                rejected[i] = str(error)
        found, moments = _scored(df, self.features, self.label, list(valid.values()), folds, fold_col, [evaluator.metric])
        for at, i in enumerate(valid):
            own = [found[f, at][evaluator.metric] for f in range(folds) if (f, at) in found]
            # A fold without rows has no score, and so has the mean.
            scores[i] = sum(own) / folds if len(own) == folds else math.nan
        return scores, rejected, lambda given: self._model(moments.all(), self.penalty(given))


class MomentRegressionModel(Model):
    def __init__(self, features: str, coefficients: tuple[float, ...], intercept: float) -> None:
        super().__init__()
        self.features, self.coefficients, self.intercept = features, coefficients, intercept

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = _array(dataset, self.features)
        weights = F.array(*[F.lit(b) for b in self.coefficients])
        shown = F.aggregate(F.zip_with(x, weights, lambda v, b: v * b), F.lit(float(self.intercept)), lambda s, v: s + v)
        return dataset.withColumn("prediction", shown)


def linear_path(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    alphas: Sequence[float],
    l1_ratios: Sequence[float],
    folds: int,
    fold_col: str = "fold",
) -> DataFrame:
    """Cross-validated path: per alpha and l1_ratio the mean R2 and RMSE over folds, and the slopes of the fit on all rows.

    One scan for the whole path.
    """
    points = [(float(a), float(r)) for r in l1_ratios for a in alphas]
    penalties = [Penalty.elastic(a, r) for a, r in points]
    found, moments = _scored(df, features, target, penalties, folds, fold_col, ("r2", "rmse"))
    whole, rows = moments.all(), []
    for i, (alpha, ratio) in enumerate(points):
        own = [found[f, i] for f in range(folds) if (f, i) in found]
        mean = {m: sum(o[m] for o in own) / len(own) if own else None for m in ("r2", "rmse")}
        fit = None
        if whole is not None:
            slopes, intercept = solve(whole, penalties[i])
            fit = LinearFit(tuple(features), tuple(map(float, slopes)), intercept)
        rows.append(
            (
                alpha,
                ratio,
                mean["r2"],
                mean["rmse"],
                sum(b != 0 for b in fit.coefficients) if fit else None,
                dict(zip(fit.names, fit.coefficients)) if fit else None,
                fit.intercept if fit else None,
            )
        )
    schema = "alpha double, l1_ratio double, r2 double, rmse double, nonzero int, coefficients map<string,double>, intercept double"
    return df.sparkSession.createDataFrame(rows, schema)
