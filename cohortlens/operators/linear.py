"""Ordinary, penalised and robust linear models.

The table is reduced to first and second moments (or to weighted ones, per robust
pass) by one grouped aggregate; only the p x p system is solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, numeric_or_null
from cohortlens.functions.tails import f_sf, normal_two_sided, t_quantile, t_two_sided
from cohortlens.operators.ranks import select_near, select_quantiles

# Huber's tuning constant and the normal-consistency factor of the
# median absolute deviation.
HUBER_T = 1.345
MAD_FACTOR = 0.6744897501960817

# Rows read for the point about which sums are taken.
PILOT_ROWS = 1000

# Rows in one partition of a table that many passes read.
PASS_ROWS = 100_000
# Products up to which each is a sum of its own in generated code; more are summed as a vector.
PLAIN_PRODUCTS = 100

_ROUNDING = 1e-10  # shares of a variance below this are rounding


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # population covariance


@dataclass(frozen=True)
class LinearFit:
    names: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predicted(self) -> Column:
        """The prediction as a plain column expression."""
        out = F.lit(float(self.intercept))
        for name, b in zip(self.names, self.coefficients):
            out = out + F.lit(float(b)) * as_col(name)
        return out

    def transform(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        return df.withColumn(out, self.predicted())


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[numeric_or_null(c).alias(c) for c in columns]).dropna()


def vector_sums(rows: DataFrame, values: Column) -> np.ndarray | None:
    """Sum of an array column, element by element, in one map-side-combined aggregate; None without rows."""
    vectors = rows.select(array_to_vector(values).alias("__v"))
    # The summary cannot be of no rows, a group without rows is none.
    found = vectors.groupBy(F.lit(1)).agg(Summarizer.sum(F.col("__v")).alias("s")).first()
    return None if found is None else found.s.toArray()


def products(x: Column, size: int) -> Column:
    """All products ``x[i] * x[j]``, i <= j, of an array of known size, row by row."""
    def row(v: Column, i: Column) -> Column:
        return F.transform(F.slice(x, i + 1, F.lit(size) - i), lambda w: v * w)

    return F.flatten(F.transform(x, row))


def symmetric(upper: np.ndarray, size: int) -> np.ndarray:
    out = np.empty((size, size))
    out[np.triu_indices(size)] = upper
    return np.triu(out) + np.triu(out, 1).T


def _about(rows: DataFrame, columns: Sequence[str], pivot: np.ndarray) -> Moments:
    """Moments of complete rows from sums about a given point."""
    p = len(columns)
    shifted = F.array(*[as_col(c) - F.lit(float(m)) for c, m in zip(columns, pivot)])
    one = F.array(F.lit(1.0))
    sums = vector_sums(rows.select(shifted.alias("__x")), F.concat(one, F.col("__x"), products(F.col("__x"), p)))
    n, off = sums[0], sums[1 : p + 1] / sums[0]
    return Moments(int(n), pivot + off, symmetric(sums[p + 1 :], p) / n - np.outer(off, off))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Count, means and population covariances over complete rows.

    One aggregate for any number of columns, of sums and products about the mean of the first
    rows. Should that lie many deviations off the mean, sums are taken again about the mean.
    """
    rows = complete_rows(df, columns)
    first = rows.limit(PILOT_ROWS).collect()
    if not first:
        raise ValueError("no complete rows")
    found = _about(rows, columns, np.array(first, float).mean(axis=0))
    off = found.mean - np.array(first, float).mean(axis=0)
    if (off * off > 1e6 * np.diag(found.cov)).any():
        return _about(rows, columns, found.mean)
    return found


def descend(
    xx: np.ndarray, xy: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, tol: float = 1e-12, max_iter: int = 100_000
) -> np.ndarray:
    """Coordinate descent on covariances: minimises ``b'Cb / 2 - c'b + l1 |b|_1 + l2 |b|^2 / 2``.

    Constant features keep a slope of 0. Ends when no step moves the fit by more than ``tol`` of its scale.
    """
    slopes = np.zeros(len(xy)) if start is None else start.copy()
    spread = np.diag(xx).copy()
    moving = [j for j in range(len(xy)) if spread[j] > 0]
    scale = float(np.abs(xy).max()) if len(xy) else 0.0
    gradient = xy - xx @ slopes
    for _ in range(max_iter):
        step = 0.0
        for j in moving:
            old = slopes[j]
            pull = gradient[j] + spread[j] * old
            new = math.copysign(max(abs(pull) - l1, 0.0), pull) / (spread[j] + l2)
            if new != old:
                gradient -= xx[:, j] * (new - old)
                slopes[j] = new
                step = max(step, abs(new - old) * spread[j])
        if step <= tol * scale:
            break
    return slopes


def _solve(m: Moments, names: Sequence[str], ridge: float = 0.0) -> LinearFit:
    xx, xy = m.cov[:-1, :-1], m.cov[:-1, -1]
    beta = np.linalg.lstsq(xx + ridge / m.n * np.eye(len(xx)), xy, rcond=None)[0]
    return LinearFit(
        tuple(names), tuple(map(float, beta)), float(m.mean[-1] - m.mean[:-1] @ beta)
    )


def ols(df: DataFrame, features: Sequence[str], target: str) -> LinearFit:
    """Least squares with intercept; collinear features get the minimum-norm solution."""
    return _solve(moments(df, [*features, target]), features)


def ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> LinearFit:
    """Minimises ``|y - Xb|^2 + alpha |b|^2`` with a free intercept."""
    return _solve(moments(df, [*features, target]), features, alpha)


def elastic_net(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
    max_iter: int = 100_000,
    tol: float = 1e-12,
) -> LinearFit:
    """Minimises ``|y - Xb|^2 / 2n + alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2)`` from moments."""
    m = moments(df, [*features, target])
    beta = descend(m.cov[:-1, :-1], m.cov[:-1, -1], alpha * l1_ratio, alpha * (1 - l1_ratio), tol=tol, max_iter=max_iter)
    return LinearFit(tuple(features), tuple(map(float, beta)), float(m.mean[-1] - m.mean[:-1] @ beta))


def lasso(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, **kw) -> LinearFit:
    return elastic_net(df, features, target, alpha, 1.0, **kw)


def ols_inference(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[str] = (),
    level: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """Coefficient table (SE, t, p, interval) and fit summary of a least-squares model.

    The summary holds R2, adjusted R2, F, log-likelihood, AIC, BIC, skew, kurtosis and Jarque-Bera of
    the residuals, and Durbin-Watson when a row order is given. Two aggregate passes;
    Durbin-Watson adds a range-partitioned one.
    """
    data = (
        df.select(
            *[as_col(c) for c in order], *[numeric_or_null(c).alias(c) for c in [*features, target]]
        )
        .dropna(subset=[*features, target])
        .persist()
    )
    try:
        return _inference(data, features, target, order, level)
    finally:
        data.unpersist()


def _inference(
    data: DataFrame, features: Sequence[str], target: str, order: Sequence[str], level: float
) -> tuple[DataFrame, DataFrame]:
    m = moments(data, [*features, target])
    fit = _solve(m, features)
    n, p = m.n, len(features)
    dof = n - p - 1
    xx = m.cov[:-1, :-1]
    sst = n * float(m.cov[-1, -1])
    sse = max(sst - n * float(np.array(fit.coefficients) @ m.cov[:-1, -1]), 0.0)
    s2 = sse / dof if dof > 0 else math.nan
    inverse = np.linalg.pinv(n * xx)
    mean = m.mean[:-1]
    variances = [s2 * (1 / n + mean @ inverse @ mean), *(s2 * np.diag(inverse))]
    half = t_quantile((1 - level) / 2, dof) if dof > 0 else math.nan
    rows = []
    for name, b, v in zip(("const", *features), (fit.intercept, *fit.coefficients), variances):
        se = math.sqrt(v)
        t = b / se if se > 0 else math.inf
        rows.append((name, float(b), se, t, t_two_sided(t, dof), b - half * se, b + half * se))
    spark = data.sparkSession
    table = spark.createDataFrame(
        [tuple(float(v) if i else v for i, v in enumerate(r)) for r in rows],
        "term string, coef double, se double, t double, p_value double, ci_low double, ci_high double",
    )
    r2 = 1 - sse / sst if sst > 0 else 0.0
    f = (r2 / p) / ((1 - r2) / dof) if r2 < 1 and dof > 0 else math.inf
    llf = -n / 2 * (math.log(2 * math.pi * sse / n) + 1) if sse > 0 else math.inf
    residuals = data.withColumn("__r", as_col(target) - fit.predicted())
    shape = residuals.agg(F.skewness("__r").alias("skew"), F.kurtosis("__r").alias("kurt")).first()
    jb = n / 6 * (shape.skew**2 + shape.kurt**2 / 4) if shape.skew is not None else None
    summary = spark.createDataFrame(
        [
            (
                n,
                p,
                float(r2),
                float(1 - (1 - r2) * (n - 1) / dof) if dof > 0 else None,
                float(f),
                float(f_sf(f, p, dof)) if math.isfinite(f) and dof > 0 else 0.0,
                float(llf),
                float(2 * (p + 1) - 2 * llf),
                float((p + 1) * math.log(n) - 2 * llf),
                shape.skew,
                None if shape.kurt is None else shape.kurt + 3,
                jb,
                durbin_watson(residuals, "__r", order, sse) if order else None,
            )
        ],
        "n long, p int, r2 double, adj_r2 double, f double, f_p_value double, llf double, "
        "aic double, bic double, skew double, kurtosis double, jarque_bera double, "
        "durbin_watson double",
    )
    return table, summary


def durbin_watson(df: DataFrame, residual: str, order: Sequence[str], sse: float) -> float | None:
    """Sum of squared steps between neighbouring residuals over their sum of squares.

    Rows are cut into key ranges; steps are taken inside each range and the ends of
    neighbouring ranges are matched on the driver, one pair per range.
    """
    if not sse:
        return None
    keys = [as_col(c) for c in order]
    ranged = (
        df.select(*keys, as_col(residual).alias("__e"))
        .repartitionByRange(*keys)
        .withColumn("__range", F.spark_partition_id())
    )
    w = Window.partitionBy("__range").orderBy(*keys)
    ends = F.struct(*keys, "__e")
    per_range = (
        ranged.withColumn("__step", as_col("__e") - F.lag("__e").over(w))
        .groupBy("__range")
        .agg(
            F.sum(F.col("__step") * F.col("__step")).alias("steps"),
            F.min(ends)["__e"].alias("first"),
            F.max(ends)["__e"].alias("last"),
        )
        .orderBy("__range")
        .collect()
    )
    total = sum(r.steps or 0.0 for r in per_range)
    total += sum((b.first - a.last) ** 2 for a, b in zip(per_range, per_range[1:]))
    return total / sse


@dataclass(frozen=True)
class RobustFit(LinearFit):
    terms: tuple[str, ...]
    estimates: tuple[float, ...]
    standard_errors: tuple[float, ...]
    scale: float
    iterations: int
    n: int

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for term, b, se in zip(self.terms, self.estimates, self.standard_errors):
            z = b / se if se > 0 else math.inf
            rows.append((term, b, se, z, normal_two_sided(z), b - 1.959963984540054 * se, b + 1.959963984540054 * se))
        return spark.createDataFrame(
            rows,
            "term string, coef double, se double, z double, p_value double, ci_low double, ci_high double",
        )


def robust_lm(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    constant: bool = True,
    max_iter: int = 50,
    tol: float = 1e-8,
) -> RobustFit:
    """Huber regression by reweighted least squares, with or without a constant.

    Every pass re-estimates the scale as the median absolute residual, reweights by
    ``min(1, t / |r/s|)`` and refits; it stops when the Huber loss settles. The input
    is cached once, its plan never grows (only literal coefficients change), and the
    median is found without moving the residuals.
    """
    rows = _spread(complete_rows(df, [*features, target])).persist()
    try:
        return _reweight(rows, features, target, constant, max_iter, tol)
    finally:
        rows.unpersist()


def _spread(rows: DataFrame) -> DataFrame:
    """The rows in partitions of a bounded size, where the files they come from make fewer."""
    parts = -(-rows.count() // PASS_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def _huber_loss(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size <= HUBER_T, size * size / 2).otherwise(size * HUBER_T - HUBER_T**2 / 2)


def _huber_weight(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size <= HUBER_T, F.lit(1.0)).otherwise(HUBER_T / size)


def _weighted_system(
    rows: DataFrame,
    names: Sequence[str],
    target: str,
    z: Column | None,
    constant: bool,
    shift: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX and X'Wy (shifted by ``shift``) for the weights of residuals ``z``, and their loss.

    One aggregate; no residuals mean equal weights.
    """
    xs = [as_col(c) - F.lit(float(s)) for c, s in zip(names, shift)]
    if constant:
        xs = [F.lit(1.0), *xs]
    y = as_col(target) - F.lit(float(shift[-1]))
    size = len(xs) + 1
    weight = (F.lit(1.0) if z is None else _huber_weight(z)).alias("__w")
    rho = (F.lit(0.0) if z is None else _huber_loss(z)).alias("__rho")
    if size * (size + 1) // 2 <= PLAIN_PRODUCTS:
        named = [x.alias(f"__x{i}") for i, x in enumerate([*xs, y])]
        pairs = [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}") * F.col("__w")) for i in range(size) for j in range(i, size)]
        sums = np.array(rows.select(weight, rho, *named).agg(F.sum("__rho"), *pairs).first(), float)
    else:
        weighted = rows.select(weight, rho, F.array(*xs, y).alias("__x"))
        scaled = F.transform(products(F.col("__x"), size), lambda v: v * F.col("__w"))
        sums = vector_sums(weighted, F.concat(F.array("__rho"), scaled))
    system = symmetric(sums[1:], size)
    return system[:-1, :-1], system[:-1, -1], float(sums[0])


def _reweight(
    rows: DataFrame, features: Sequence[str], target: str, constant: bool, max_iter: int, tol: float
) -> RobustFit:
    names = list(features)
    means = [F.avg(as_col(c)).alias(f"m{i}") for i, c in enumerate([*names, target])]
    total, *center = rows.agg(F.count(F.lit(1)), *means).first()
    if not total:
        raise ValueError("no complete rows")
    # Centring needs the intercept to absorb it.
    shift = np.array(center, dtype=float) if constant else np.zeros(len(names) + 1)

    def solve(gram: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, float]:
        beta = np.linalg.lstsq(gram, rhs, rcond=None)[0]
        if not constant:
            return beta, 0.0
        slopes = beta[1:]
        return slopes, float(beta[0] + shift[-1] - slopes @ shift[:-1])

    def residual(slopes: np.ndarray, intercept: float) -> Column:
        return as_col(target) - LinearFit(tuple(names), tuple(slopes), intercept).predicted()

    def scale_of(r: Column, last: float = 0.0, moved: float = 0.0) -> float:
        """The scale of the residuals; looked for first within what the last one may have moved."""
        if last > 0:
            middle, reach = last * MAD_FACTOR, min(0.5, max(5 * moved, 1e-4))
            near = select_near(rows, F.abs(r), 0.5, int(total), middle * (1 - reach), middle * (1 + reach))
            if near is not None:
                return near / MAD_FACTOR
        return select_quantiles(rows, {"r": F.abs(r)}, 0.5)["r"] / MAD_FACTOR

    plain_gram, rhs, _ = _weighted_system(rows, names, target, None, constant, shift)
    slopes, intercept = solve(plain_gram, rhs)
    r = residual(slopes, intercept)
    s, moved = scale_of(r), 0.02
    previous, iterations = math.inf, 0
    while s > 0 and iterations <= max_iter:
        # The loss at the current fit and the system of the next come from one pass.
        gram, rhs, loss = _weighted_system(rows, names, target, r / s, constant, shift)
        if iterations == max_iter or (iterations and abs(loss - previous) < tol):
            break
        previous = loss if iterations else math.inf
        slopes, intercept = solve(gram, rhs)
        r = residual(slopes, intercept)
        last, s = s, scale_of(r, s, moved)
        moved = abs(s / last - 1)
        iterations += 1

    estimates = [intercept, *slopes] if constant else list(slopes)
    k_params = len(estimates)
    if s > 0:
        z = r / s
        inside = (F.abs(z) <= HUBER_T).cast("double")
        psi = F.greatest(F.least(z, F.lit(HUBER_T)), F.lit(-HUBER_T))
        a = rows.agg(
            F.avg(inside).alias("m"),
            F.var_pop(inside).alias("v"),
            F.sum(psi * psi).alias("psi2"),
        ).first()
        correction = 1 + k_params / total * a.v / a.m**2
        factor = correction**2 * (a.psi2 / (total - k_params) * s * s) / a.m**2
    else:
        factor = 0.0
    inverse = np.linalg.pinv(plain_gram)
    if constant:
        # Undo the centring for the intercept's variance.
        back = np.eye(k_params)
        back[0, 1:] = -shift[:-1]
        inverse = back @ inverse @ back.T
    errors = np.sqrt(np.maximum(factor * np.diag(inverse), 0.0))
    terms = ("const", *names) if constant else tuple(names)
    return RobustFit(
        names=tuple(names),
        coefficients=tuple(float(b) for b in slopes),
        intercept=float(intercept),
        terms=terms,
        estimates=tuple(float(b) for b in estimates),
        standard_errors=tuple(float(e) for e in errors),
        scale=float(s),
        iterations=iterations,
        n=int(total),
    )


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factor ``1 / (1 - R2)`` of every feature on the others.

    Infinite where the others determine the feature, null where it is constant (a constant
    feature explains nothing, so it is left out for the others).
    """
    m = moments(df, features)
    variance = np.diag(m.cov)
    varies = [i for i, c in enumerate(features) if variance[i] > _ROUNDING * (variance[i] + m.mean[i] ** 2)]
    sd = np.sqrt(variance[varies])
    corr = m.cov[np.ix_(varies, varies)] / np.outer(sd, sd)
    values: list[float | None] = [None] * len(features)
    for at, i in enumerate(varies):
        others = np.delete(np.arange(len(varies)), at)
        own, among = corr[others, at], corr[np.ix_(others, others)]
        # Directions among the others that rounding alone keeps from being collinear do not count.
        explained = float(own @ np.linalg.pinv(among, rcond=_ROUNDING, hermitian=True) @ own)
        values[i] = math.inf if 1 - explained < _ROUNDING else 1 / (1 - explained)
    return df.sparkSession.createDataFrame(list(zip(features, values)), "feature string, vif double").orderBy(
        F.desc_nulls_last("vif"), "feature"
    )


def coefficient_table(spark: SparkSession, fit: LinearFit, target: str | None = None) -> DataFrame:
    """Coefficients by absolute size, each with a sentence on its direction."""
    rows = [(c, float(b), abs(float(b))) for c, b in zip(fit.names, fit.coefficients)]
    table = spark.createDataFrame(rows, "feature string, coef double, abs_coef double")
    if target is not None:
        direction = F.when(F.col("coef") > 0, "increase").otherwise("decrease")
        table = table.withColumn(
            "reading",
            F.format_string(
                f"{target} is predicted to %s by about %.4f per unit of %s",
                direction, F.col("abs_coef"), F.col("feature"),
            ),
        )
    return table.orderBy(F.desc("abs_coef"), "feature")
