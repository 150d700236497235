"""Registered queries over models with a closed form, and over inputs with gaps, next to their SQL.

The large models of ``queries_models`` have no counterpart in SQL; these run the same library
functions (folds, grids, boards, scoring) over models that SQL can fit step by step.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import format_probabilities, hash_uniform, truncate_to_int
from cohortlens.operators import clean, describe, importance, linear, metrics, models, neighbors, split, tuning
from cohortlens.operators.foldstats import LinearCandidate, MomentRegression, Penalty, linear_path
from cohortlens.plans.standins import DIRTY, FLAT, U, R, cte, dirty_visits, flat, query, round_all, rounded, table

# --- inputs with gaps, constants, twins and bad text ---------------------------------------

_GAPPED = "CASE WHEN event_id % 97 = 0 THEN 'rare-' || event_id ELSE kind END"


@query(
    "drop_rare_classes_nulls",
    cte(DIRTY) + f"SELECT event_id, c FROM (SELECT event_id, {_GAPPED} AS c FROM dirty) WHERE c IS NULL OR c IN "
    f"(SELECT {_GAPPED} FROM dirty GROUP BY 1 HAVING count(*) >= 2)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rare = F.concat(F.lit("rare-"), F.col("event_id").cast("string"))
    df = dirty_visits(spark, sf).select("event_id", F.when(F.col("event_id") % 97 == 0, rare).otherwise(F.col("kind")).alias("c"))
    return clean.drop_rare_classes(df, "c")


@query("exclude_keys_nulls", cte(DIRTY) + "SELECT event_id, kind FROM dirty WHERE kind IS NULL OR kind NOT IN ('click', 'view')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.exclude_keys(dirty_visits(spark, sf).select("event_id", "kind"), ["click", "view", None], "kind")


_CLASSED = (
    "pos AS (SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(event_id::VARCHAR || '-42'), event_id) - 1 AS p, "
    "count(*) OVER (PARTITION BY kind) AS n FROM dirty)"
)


@query("stratified_kfold_nulls", cte(DIRTY, _CLASSED) + "SELECT event_id, kind, CAST(p % 5 AS INT) AS fold FROM pos")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_kfold(dirty_visits(spark, sf).select("event_id", "kind"), "kind", ["event_id"])


@query(
    "stratified_split_nulls",
    cte(DIRTY, _CLASSED) + "SELECT event_id, kind, p < CAST(round(n * 0.2) AS BIGINT) AS is_test FROM pos",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return split.mark_stratified(dirty_visits(spark, sf).select("event_id", "kind"), "kind", ["event_id"])


_HOLED = ("qty", "price", "twin", "one")


def _pair(a: str, b: str) -> str:
    if "one" in (a, b):
        return f"SELECT '{a}' AS feature, '{b}' AS other, CAST(NULL AS DOUBLE) AS corr"
    return f"SELECT '{a}' AS feature, '{b}' AS other, {R(f'corr({a}, {b})')} AS corr FROM holed"


@query(
    "corr_matrix_nulls",
    cte(FLAT) + f", holed AS (SELECT CASE WHEN {U('key', 'q')} >= 0.2 THEN qty END AS qty, CASE WHEN {U('key', 'p')} >= 0.3 THEN price END "
    "AS price, -3 * qty + 1 AS twin, 1.0::DOUBLE AS one FROM flat) " + " UNION ALL ".join(_pair(a, b) for a in _HOLED for b in _HOLED),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    holed = flat(spark, sf).select(
        F.when(hash_uniform("key", "q") >= 0.2, F.col("qty")).alias("qty"),
        F.when(hash_uniform("key", "p") >= 0.3, F.col("price")).alias("price"),
        (-3 * F.col("qty") + 1).alias("twin"),
        F.lit(1.0).alias("one"),
    )
    return round_all(describe.corr_matrix(holed, _HOLED))


@query(
    "truncate_dirty",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN CAST(event_id * 7 AS INT) "
    "ELSE CAST(-event_id AS INT) END AS n FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind, number = F.col("event_id") % 5, F.col("event_id").cast("string")
    text = (
        F.when(kind == 0, "abc").when(kind == 1, "1e12").when(kind == 2, F.lit(None))
        .when(kind == 3, F.concat((F.col("event_id") * 7).cast("string"), F.lit(".75")))
        .otherwise(F.concat(F.lit("-"), number, F.lit(".99")))
    )
    return table(spark, sf, "events").select("event_id", truncate_to_int(text).alias("n"))


@query(
    "vif_collinear",
    "SELECT feature, infinite, vif FROM (VALUES ('p_size', true, NULL::DOUBLE), ('twin', true, NULL), ('one', NULL, NULL)) t(feature, infinite, vif) "
    f"UNION ALL SELECT 'p_partkey', false, {R('1 / (1 - pow(corr(p_size, p_partkey), 2))')} FROM part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_size", "p_partkey", (F.col("p_size") * 2).alias("twin"), F.lit(1).alias("one"))
    found = linear.vif(part, ["p_size", "twin", "p_partkey", "one"])
    infinite = F.col("vif") == float("inf")
    return found.select("feature", infinite.alias("infinite"), rounded(F.when(~infinite, F.col("vif"))).alias("vif"))


# --- nearest neighbours over folds and grids -------------------------------------------------

_KNN_FOLDS = 3
_FOLDED = f"f AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, CAST(floor({U('vec_id', 42)} * {_KNN_FOLDS}) AS INT) AS fold FROM embeddings)"
_METRICS = {
    "euclidean": "list_distance(q.e, r.e)",
    "manhattan": "list_sum(list_transform(list_zip(q.e, r.e), lambda p: abs(p[1] - p[2])))",
}
KNN_K, KNN_WEIGHTS = (3, 7), ("uniform", "distance")


def _ranked(metric: str) -> str:
    return (
        f"near_{metric} AS (SELECT q.fold, q.vec_id, q.label AS actual, r.label, round({_METRICS[metric]}, 6) AS d, row_number() OVER "
        f"(PARTITION BY q.vec_id ORDER BY round({_METRICS[metric]}, 6), r.vec_id) AS rk FROM f q JOIN f r ON q.fold <> r.fold)"
    )


@query(
    "knn_grid",
    cte(_FOLDED, *map(_ranked, _METRICS)) + ", near AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM near_{m}" for m in _METRICS) + "), "
    "settings AS (SELECT * FROM (VALUES (3), (7)) a(k), (VALUES ('uniform'), ('distance')) b(weights)), "
    "votes AS (SELECT metric, k, weights, fold, vec_id, actual, label, sum(CASE WHEN weights = 'uniform' THEN 1.0 ELSE 1.0::DOUBLE / d END) AS v "
    "FROM near, settings WHERE rk <= k GROUP BY ALL), "
    "pred AS (SELECT metric, k, weights, fold, vec_id, actual, arg_min(label, (-v, label)) AS p FROM votes GROUP BY ALL), "
    "recall AS (SELECT metric, k, weights, fold, actual, avg((p = actual)::DOUBLE) AS r FROM pred GROUP BY ALL), "
    "scores AS (SELECT metric, k, weights, fold, avg(r) AS s FROM recall GROUP BY ALL) "
    f"SELECT metric, CAST(k AS VARCHAR) AS k, weights, {R('sum(s) / 3')} AS score FROM scores GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    folded = rows.withColumn("fold", split.kfold("vec_id", _KNN_FOLDS))
    knn = neighbors.NearestNeighbours("vec_id", features="embedding")
    grid = (
        ParamGridBuilder().addGrid(knn.k, KNN_K).addGrid(knn.weights, KNN_WEIGHTS).addGrid(knn.metric, list(_METRICS)).build()
    )
    _, _, scores, _ = tuning.grid_search(folded, knn, grid, tuning.BalancedAccuracy(), _KNN_FOLDS)
    found = tuning.params_table(spark, grid, scores)
    return found.select(*[F.col("params")[p].alias(p) for p in ("metric", "k", "weights")], rounded(F.col("score")).alias("score"))


@query(
    "knn_tuned",
    cte(f"q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE {U('vec_id', 42)} >= 0.8)",
        f"r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE {U('vec_id', 42)} < 0.8)")
    + "SELECT vec_id, label, arg_min(other, (-v, other)) AS prediction FROM (SELECT vec_id, label, other, count(*) AS v FROM (SELECT q.vec_id, "
    "q.label::DOUBLE AS label, r.label::DOUBLE AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, r.e), 6), "
    "r.vec_id) AS rk FROM q, r) WHERE rk <= 5 GROUP BY ALL) GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    train, test = split.train_test_split(rows, "vec_id")
    model = tuning.fit_with_preprocessing(train, neighbors.NearestNeighbours("vec_id", 5, features="embedding"))
    return model.transform(test).select("vec_id", "label", "prediction")


# --- least squares and ridge through folds, grids and boards ------------------------------

_FOLDS = 3
_SPLIT = f"rows AS (SELECT key, qty, discount, y, {U('key', 42)} AS u, CAST(floor({U('key', 42)} * {_FOLDS}) AS INT) AS fold FROM flat)"
_LAMBDAS = (0.1, 50.0)


def _fit_sql(name: str, where: str, penalty: str) -> str:
    """One-feature fit with a penalty on the slope, as a one-row relation (a, b)."""
    slope = f"covar_pop(qty, y) / (var_pop(qty) + {penalty})"
    return f"{name} AS (SELECT {slope} AS b, avg(y) - {slope} * avg(qty) AS a FROM rows WHERE {where})"


# The library divides the label by its deviation before it applies the penalty.
def _lib(penalty: float) -> str:
    return f"{penalty!r} / stddev_pop(y)"


_MAPE = "avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100"
_R2 = "1 - avg((y - p) * (y - p)) / var_pop(y)"
_RMSE = "sqrt(avg((y - p) * (y - p)))"


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with a one-feature vector, the label and a fold."""
    rows = flat(spark, sf).select("key", "qty", "discount", F.col("y").alias("label"))
    assembled = VectorAssembler(inputCols=["qty"], outputCol="features").transform(rows)
    return split.train_test_split(assembled.withColumn("fold", split.kfold("key", _FOLDS)), "key")


_CV_FITS = [
    _fit_sql(f"{name}{f}", f"u < 0.8 AND fold <> {f}", penalty)
    for f in range(_FOLDS)
    for name, penalty in (("linear", "0"), ("ridge", "10000.0 / count(*)"))
]
_CV_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS model, {f} AS f, y, a + b * qty AS p FROM rows, {name}{f} WHERE u < 0.8 AND fold = {f}"
    for f in range(_FOLDS)
    for name in ("linear", "ridge")
)


@query(
    "cv_scores_linear",
    cte(FLAT, _SPLIT, *_CV_FITS) + f", folds AS (SELECT model, f, {_R2} AS r2, {_RMSE} AS rmse, {_MAPE} AS mape FROM ({_CV_ROWS}) GROUP BY ALL) "
    f"SELECT model, {R('avg(r2)')} AS r2, {R('avg(rmse)')} AS rmse, {R('avg(mape)')} AS mape FROM folds GROUP BY model",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _two(spark, sf)
    candidates = {"linear": LinearCandidate(("qty",)), "ridge": LinearCandidate(("qty",), Penalty(total=10000.0))}
    return round_all(tuning.cv_scores(train, candidates, _FOLDS))


@query(
    "out_of_fold_r2_linear",
    cte(FLAT, _SPLIT, *_CV_FITS) + f"SELECT {R(_R2)} AS r2 FROM ({_CV_ROWS}) WHERE model = 'linear'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _two(spark, sf)
    r2 = tuning.out_of_fold_r2(train, LinearRegression(solver="normal"), _FOLDS)
    return round_all(spark.createDataFrame([(float(r2),)], "r2 double"))


_GRID_FITS = [_fit_sql(f"g{i}_{f}", f"u < 0.8 AND fold <> {f}", _lib(v)) for i, v in enumerate(_LAMBDAS) for f in range(_FOLDS)]
_GRID_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS i, {f} AS f, y, a + b * qty AS p FROM rows, g{i}_{f} WHERE u < 0.8 AND fold = {f}"
    for i in range(len(_LAMBDAS))
    for f in range(_FOLDS)
)
_GRID_SCORES = f"scores AS (SELECT i, avg(s) AS score FROM (SELECT i, f, {_MAPE} AS s FROM ({_GRID_ROWS}) GROUP BY ALL) GROUP BY i)"


def _ridge() -> LinearRegression:
    return LinearRegression(solver="normal", standardization=False)


def _ridge_grid(est: LinearRegression) -> list:
    return ParamGridBuilder().addGrid(est.regParam, list(_LAMBDAS)).build()


@query(
    "grid_search_ridge",
    cte(FLAT, _SPLIT, *_GRID_FITS, _GRID_SCORES)
    + f"SELECT CASE i {' '.join(f'WHEN {i} THEN {v!r}' for i, v in enumerate(_LAMBDAS))} END::DOUBLE AS reg, {R('score')} AS score FROM scores",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _two(spark, sf)
    est = MomentRegression(label_scaled=True)
    grid = ParamGridBuilder().addGrid(est.alpha, list(_LAMBDAS)).build()
    _, _, scores, _ = tuning.grid_search(train, est, grid, tuning.RegressionScore("mape"), _FOLDS)
    found = tuning.params_table(spark, grid, scores)
    return round_all(found.select(F.col("params")["alpha"].cast("double").alias("reg"), "score"))


# --- an elastic net path over folds ---------------------------------------------------------

_ALPHAS, _RATIOS, _SWEEPS = (0.05, 0.5, 2.0), (0.0, 0.5, 1.0), 60


def _pulled(own: str, other: str, slope: str) -> str:
    """One coordinate step: the new slope of `own` where the other has `slope`."""
    pull = f"(s{own}y - s12 * {slope})"
    return f"sign({pull}) * greatest(abs({pull}) - alpha * ratio, 0) / (s{own}{own} + alpha * (1 - ratio))"


_PATH = [
    f"rows AS (SELECT qty, 100 * discount AS d, y, CAST(floor({U('key', 42)} * {_FOLDS}) AS INT) AS fold FROM flat)",
    # Fold -1 stands for the fit on all rows.
    "mom AS (SELECT f.fold, count(*) AS n, avg(qty) AS m1, avg(d) AS m2, avg(y) AS my, var_pop(qty) AS s11, var_pop(d) AS s22, covar_pop(qty, d) AS s12, "
    f"covar_pop(qty, y) AS s1y, covar_pop(d, y) AS s2y FROM rows JOIN (SELECT unnest(generate_series(-1, {_FOLDS - 1})) AS fold) f ON rows.fold <> f.fold GROUP BY f.fold)",
    f"points AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE)' for a in _ALPHAS)}) a(alpha), (VALUES {', '.join(f'({r}::DOUBLE)' for r in _RATIOS)}) r(ratio))",
    "steps AS (SELECT mom.*, alpha, ratio, 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM mom, points UNION ALL "
    f"SELECT fold, n, m1, m2, my, s11, s22, s12, s1y, s2y, alpha, ratio, i + 1, c1, {_pulled('2', '1', 'c1')} FROM "
    f"(SELECT *, {_pulled('1', '2', 'b2')} AS c1 FROM steps WHERE i < {_SWEEPS}))",
    f"fits AS (SELECT fold, alpha, ratio, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM steps WHERE i = {_SWEEPS})",
    "held AS (SELECT rows.fold, alpha, ratio, 1 - avg(pow(y - b0 - b1 * qty - b2 * d, 2)) / var_pop(y) AS r2, sqrt(avg(pow(y - b0 - b1 * qty - b2 * d, 2))) AS rmse "
    "FROM rows JOIN fits ON rows.fold = fits.fold GROUP BY ALL)",
    "scores AS (SELECT alpha, ratio, avg(r2) AS r2, avg(rmse) AS rmse FROM held GROUP BY ALL)",
]


@query(
    "enet_path",
    cte(FLAT, *_PATH).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT alpha, ratio AS l1_ratio, {R('r2')} AS r2, {R('rmse')} AS rmse, (b1 <> 0)::INT + (b2 <> 0)::INT AS nonzero, {R('b1')} AS b_qty, "
    f"{R('b2')} AS b_d, {R('b0')} AS intercept FROM scores JOIN fits USING (alpha, ratio) WHERE fold = -1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = flat(spark, sf).select("key", "qty", (100 * F.col("discount")).alias("d"), "y")
    folded = rows.withColumn("fold", split.kfold("key", _FOLDS))
    path = linear_path(folded, ["qty", "d"], "y", _ALPHAS, _RATIOS, _FOLDS)
    slopes = [F.col("coefficients")[c].alias(f"b_{c}") for c in ("qty", "d")]
    return round_all(path.select("alpha", "l1_ratio", "r2", "rmse", "nonzero", *slopes, "intercept"))


_BOARD = [
    *_GRID_FITS,
    _GRID_SCORES,
    *[_fit_sql(f"final{i}", "u < 0.8", _lib(v)) for i, v in enumerate(_LAMBDAS)],
    _fit_sql("plain", "u < 0.8", "0"),
    "board AS (" + " UNION ALL ".join(
        [
            f"SELECT 'ridge' AS model, y, a + b * qty AS p FROM rows, final{i} WHERE u >= 0.8 AND (SELECT arg_min(i, score) FROM scores) = {i}"
            for i in range(len(_LAMBDAS))
        ]
        + ["SELECT 'linear', y, a + b * qty FROM rows, plain WHERE u >= 0.8"]
    ) + ")",
    f"ranked AS (SELECT model, {R(_R2)} AS r2, {R(_RMSE)} AS rmse, {R(_MAPE)} AS mape FROM board GROUP BY model)",
]


def _linear_board(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _two(spark, sf)
    est = _ridge()
    candidates = {"ridge": (est, _ridge_grid(est)), "linear": (LinearRegression(solver="normal"), [])}
    return tuning.tuned_leaderboard(train, test, candidates, _FOLDS)[0].select("model", "r2", "rmse", "mape")


@query("tuned_leaderboard_linear", cte(FLAT, _SPLIT, *_BOARD) + "SELECT * FROM ranked")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(_linear_board(spark, sf))


@query("best_model_linear", cte(FLAT, _SPLIT, *_BOARD) + "SELECT * FROM ranked ORDER BY mape, model LIMIT 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(tuning.best_model(_linear_board(spark, sf)))


_PLAIN = _fit_sql("plain", "u < 0.8", "0")
_TEST = "t AS (SELECT key, y AS actual, a + b * qty AS predicted FROM rows, plain WHERE u >= 0.8)"


def _test_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _two(spark, sf)
    fit = linear.ols(train, ["qty"], "label")
    return fit.transform(test).select("key", F.col("label").alias("actual"), "predicted")


@query(
    "evaluate_dataset_linear",
    cte(FLAT, _SPLIT, _PLAIN, _TEST) + f"SELECT count(*) AS n, {R('sqrt(avg(pow(actual - predicted, 2)))')} AS rmse, "
    f"{R('avg(abs(actual - predicted))')} AS mae, {R('max(abs(actual - predicted))')} AS max_abs_error, "
    "arg_min(key, (-round(abs(actual - predicted), 9), key)) AS worst_key FROM t",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    report, _ = importance.evaluate_dataset(_test_scores(spark, sf), "key")
    return round_all(report.select("n", "rmse", "mae", "max_abs_error", "worst_key"))


@query(
    "actual_vs_predicted_linear",
    cte(FLAT, _SPLIT, _PLAIN, _TEST) + f"SELECT key, {R('actual', 4)} AS actual, {R('predicted', 4)} AS predicted, "
    f"{R('abs(predicted - actual)', 4)} AS abs_error, abs(predicted - actual) < 1 AS within_tolerance FROM t",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = importance.actual_vs_predicted(_test_scores(spark, sf), ["key"])
    return round_all(rows.select("key", "actual", "predicted", "abs_error", "within_tolerance"), 4)


_TWO_MOMENTS = (
    "mom AS (SELECT var_pop(qty) AS s11, var_pop(discount) AS s22, covar_pop(qty, discount) AS s12, covar_pop(qty, y) AS s1y, "
    "covar_pop(discount, y) AS s2y FROM rows WHERE u < 0.8)"
)
_DET = "(s11 * s22 - s12 * s12)"


@query(
    "importances_ols",
    cte(FLAT, _SPLIT, _TWO_MOMENTS) + f"SELECT 'discount' AS feature, {R(f'abs(s2y * s11 - s1y * s12) / {_DET}')} AS importance, 1 AS rank FROM mom "
    f"UNION ALL SELECT 'qty', {R(f'abs(s1y * s22 - s2y * s12) / {_DET}')}, 2 FROM mom",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _two(spark, sf)
    both = VectorAssembler(inputCols=["qty", "discount"], outputCol="features").transform(train.drop("features"))
    model = models.fit_cached(LinearRegression(solver="normal"), both)
    return round_all(importance.importance_table(spark, model, ["qty", "discount"]))


# --- logistic regression by Newton steps ---------------------------------------------------

_HIGH = "rows AS (SELECT key, qty / 50 AS x, CASE WHEN rating > 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS y, " + f"{U('key', 42)} AS u FROM flat)"


def _newton(steps: int = 12) -> list[str]:
    """Penalised one-feature logistic regression, strength C = 1, unrolled."""
    out = ["w0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE / count(*) AS l FROM rows WHERE u < 0.8)"]
    for i in range(steps):
        out.append(
            f"h{i} AS (SELECT a, b, l, avg(p - y) AS ga, avg((p - y) * x) + max(l * b) AS gb, avg(p * (1 - p)) AS haa, avg(p * (1 - p) * x) AS hab, "
            f"avg(p * (1 - p) * x * x) + max(l) AS hbb FROM (SELECT x, y, a, b, l, 1 / (1 + exp(-(a + b * x))) AS p FROM rows, w{i} WHERE u < 0.8) "
            "GROUP BY a, b, l)"
        )
        out.append(
            f"w{i + 1} AS MATERIALIZED (SELECT a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, "
            f"b - (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b, l FROM h{i})"
        )
    return out


_LOGIT = cte(FLAT, _HIGH, *_newton()) + ", t AS (SELECT key, y, 1 / (1 + exp(-(a + b * x))) AS p FROM rows, w12 WHERE u >= 0.8) "


def _logit(spark: SparkSession, sf: str):
    rows = flat(spark, sf).select("key", (F.col("qty") / 50).alias("x"), (F.col("rating") > 6).cast("double").alias("label"))
    train, test = split.train_test_split(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows), "key")
    return models.fit_cached(models.logistic(1.0, tol=1e-12, max_iter=200), train), test


@query(
    "logistic_one_feature",
    _LOGIT + f", r AS (SELECT y, count(*) AS n, sum(((p > 0.5) = (y = 1))::INT) AS hit FROM t GROUP BY y) SELECT sum(n)::BIGINT AS n, "
    f"{R('sum(hit)::DOUBLE / sum(n)')} AS accuracy, {R('avg(hit::DOUBLE / n)')} AS balanced_accuracy FROM r",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _logit(spark, sf)
    return round_all(metrics.accuracy_metrics(model.transform(test), "label", "prediction"))


@query("predict_proba_one_feature", _LOGIT + f"SELECT key, {R('p', 4)} AS p FROM t")
def _(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _logit(spark, sf)
    p = vector_to_array("probability")[1]
    return model.transform(test).select("key", rounded(p, 4).alias("p"))


@query(
    "format_proba_one_feature",
    _LOGIT + "SELECT key, 'low=' || printf('%.1f', 100 * (1 - p)) || '%, high=' || printf('%.1f', 100 * p) || '%' AS shown FROM t "
    "ORDER BY p, key LIMIT 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _logit(spark, sf)
    scored = model.transform(test).withColumn("p", vector_to_array("probability"))
    first = scored.orderBy(F.round(F.col("p")[1], 9), "key").limit(20)
    return first.select("key", format_probabilities(F.col("p"), ["low", "high"]).alias("shown"))


# --- trees of one split on a feature with few values --------------------------------------

_STUMPS = f"rows AS (SELECT key, discount AS x, y, (rating > 4)::INT AS c, {U('key', 42)} AS u FROM flat)"


def _stump_sql(name: str, source: str, target: str) -> str:
    """Best split of ``target`` on x by squared error: cut, mean up to it and mean beyond."""
    return (
        f"{name}_v AS (SELECT x, count(*)::DOUBLE AS n, sum({target}) AS s FROM {source} WHERE u < 0.8 GROUP BY x), "
        f"{name}_c AS (SELECT x, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM {name}_v "
        "WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)), "
        f"{name} AS MATERIALIZED (SELECT x AS cut, sl / nl AS lo, (st - sl) / (nt - nl) AS hi FROM {name}_c WHERE nl < nt "
        "ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1)"
    )


def _few(spark: SparkSession, sf: str, label: str) -> tuple[DataFrame, DataFrame]:
    rows = flat(spark, sf).withColumn("c", (F.col("rating") > 4).cast("double"))
    assembled = VectorAssembler(inputCols=["discount"], outputCol="features").transform(rows)
    return split.train_test_split(assembled.select("key", "features", F.col(label).alias("label")), "key")


_T1 = _stump_sql("t1", "rows", "y")
_F1 = "f1 AS (SELECT *, CASE WHEN x <= (SELECT cut FROM t1) THEN (SELECT lo FROM t1) ELSE (SELECT hi FROM t1) END AS p1 FROM rows)"


@query("random_forest_stump", cte(FLAT, _STUMPS, _T1, _F1) + f"SELECT key, {R('p1')} AS prediction FROM f1 WHERE u >= 0.8")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _few(spark, sf, "y")
    model = models.fit_cached(models.random_forest_reg(1, 1).setBootstrap(False), train)
    return round_all(model.transform(test).select("key", "prediction"))


_T2 = _stump_sql("t2", "f1", "2 * (y - p1)")


@query(
    "gbt_reg_two_stumps",
    cte(FLAT, _STUMPS, _T1, _F1, _T2) + f"SELECT key, {R('p1 + 0.5 * CASE WHEN x <= cut THEN lo ELSE hi END')} AS prediction FROM f1, t2 WHERE u >= 0.8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _few(spark, sf, "y")
    model = models.fit_cached(models.gbt_reg(2, 0.5, 1), train)
    return round_all(model.transform(test).select("key", "prediction"))


_C1 = _stump_sql("t1", "rows", "(2 * c - 1)")


@query(
    "gbt_clf_stump",
    cte(FLAT, _STUMPS, _C1) + "SELECT key, CASE WHEN CASE WHEN x <= cut THEN lo ELSE hi END > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction "
    "FROM rows, t1 WHERE u >= 0.8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _few(spark, sf, "c")
    model = models.fit_cached(models.gbt_clf(1, 0.5, 1), train)
    return model.transform(test).select("key", "prediction")


@query(
    "random_forest_clf_stump",
    # With two classes the Gini gain is the squared-error gain of the 0/1 label. The library
    # merges leaves that predict the same class.
    cte(FLAT, _STUMPS, _stump_sql("t1", "rows", "c"))
    + f"SELECT key, {R('CASE WHEN (lo > 0.5) = (hi > 0.5) THEN (SELECT avg(c) FROM rows WHERE u < 0.8) WHEN x <= cut THEN lo ELSE hi END')} AS p "
    "FROM rows, t1 WHERE u >= 0.8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _few(spark, sf, "c")
    model = models.fit_cached(models.random_forest_clf(1, 1).setBootstrap(False), train)
    return model.transform(test).select("key", rounded(vector_to_array("probability")[1]).alias("p"))


# --- importances, selection and fallback on stumps and one feature ---------------------------

_TWO_X = f"rows AS (SELECT key, discount, tax, y, {U('key', 42)} AS u FROM flat)"


def _gain_sql(feature: str) -> str:
    """The best cut of a feature: its name, cut, gain and the two means."""
    return (
        f"{feature}_v AS (SELECT {feature} AS x, count(*)::DOUBLE AS n, sum(y) AS s FROM rows WHERE u < 0.8 GROUP BY 1), "
        f"{feature}_c AS (SELECT x, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM {feature}_v "
        "WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)), "
        f"{feature}_b AS MATERIALIZED (SELECT '{feature}' AS feature, x AS cut, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain, "
        f"sl / nl AS lo, (st - sl) / (nt - nl) AS hi FROM {feature}_c WHERE nl < nt ORDER BY gain DESC LIMIT 1)"
    )


_STUMP_OF_TWO = [
    _TWO_X,
    _gain_sql("discount"),
    _gain_sql("tax"),
    "found AS (SELECT * FROM discount_b UNION ALL SELECT * FROM tax_b), best AS MATERIALIZED (SELECT * FROM found ORDER BY gain DESC LIMIT 1)",
]


def _of_two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = flat(spark, sf).select("key", "discount", "tax", F.col("y").alias("label"))
    return split.train_test_split(VectorAssembler(inputCols=["discount", "tax"], outputCol="features").transform(rows), "key")


@query(
    "importances_stump",
    cte(FLAT, *_STUMP_OF_TWO) + "SELECT feature, (gain = (SELECT gain FROM best))::INT::DOUBLE AS importance, "
    "CAST(row_number() OVER (ORDER BY gain DESC) AS INT) AS rank FROM found",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _of_two(spark, sf)
    model = models.fit_cached(models.random_forest_reg(1, 1).setBootstrap(False), train)
    return round_all(importance.importance_table(spark, model, ["discount", "tax"]))


@query(
    "importance_select_refit_stump",
    cte(FLAT, *_STUMP_OF_TWO) + f"SELECT key, {R('CASE WHEN CASE feature WHEN $$tax$$ THEN tax ELSE discount END <= cut THEN lo ELSE hi END')} AS prediction "
    "FROM rows, best WHERE u >= 0.8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _of_two(spark, sf)
    model, _ = importance.importance_select_refit(train, models.random_forest_reg(1, 1).setBootstrap(False), 1)
    return round_all(model.transform(test).select("key", "prediction"))


@query("fallback_base_model", cte(FLAT, _SPLIT, _PLAIN, _TEST) + f"SELECT key, {R('predicted')} AS prediction FROM t")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Too few rows of a class for the folds: the grid is passed over and the base model fitted."""
    train, test = _two(spark, sf)
    est = LinearRegression(solver="normal")
    grid = ParamGridBuilder().addGrid(est.regParam, list(_LAMBDAS)).build()
    model, params = tuning.fit_or_fallback(train, est, grid, tuning.RegressionScore("mape"), _FOLDS, _FOLDS - 1)
    if params:
        raise AssertionError("the base model has no tuned parameters")
    return round_all(model.transform(test).select("key", "prediction"))
