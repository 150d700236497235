"""Registered queries: imputation, scaling, encoding, splits, linear models, neighbours."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import describe, features, linear, neighbors, split
from cohortlens.plans import flows
from cohortlens.plans.standins import (
    COLUMNS,
    DIRTY,
    FLAT,
    GUESSED,
    MEASURES,
    U,
    R,
    cte,
    dirty_visits,
    flat,
    guessed,
    query,
    round_all,
    rounded,
    table,
    visits,
)

_TRAIN = f"{U('event_id', 42)} < 0.8"


def _dirty_train(df: DataFrame) -> DataFrame:
    return split.train_test_split(df, "event_id")[0]


@query(
    "impute_median",
    cte(DIRTY) + f"SELECT event_id, coalesce(value, (SELECT median(value) FROM dirty WHERE {_TRAIN})) AS value FROM dirty",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "value")
    return features.impute_median(_dirty_train(df), ["value"]).transform(df)


_MODE = f"(SELECT kind FROM dirty WHERE {_TRAIN} AND kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"


@query("impute_mode", cte(DIRTY) + f"SELECT event_id, coalesce(kind, {_MODE}) AS kind FROM dirty")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "kind")
    return features.impute_mode(_dirty_train(df), ["kind"]).transform(df)


@query(
    "standard_scale",
    cte(FLAT) + f", s AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(tax) AS mt, stddev_pop(tax) AS st FROM flat "
    f"WHERE {U('key', 42)} < 0.8) SELECT key, {R('(qty - mq) / sq')} AS qty, {R('(tax - mt) / st')} AS tax FROM flat, s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = flat(spark, sf).select("key", "qty", "tax")
    train, _ = split.train_test_split(df, "key")
    return round_all(features.standard_scale(train, ["qty", "tax"]).transform(df))


@query(
    "one_hot",
    cte(DIRTY) + "SELECT event_id, " + ", ".join(
        f"CASE WHEN kind = '{m}' THEN 1.0::DOUBLE ELSE 0.0 END AS k_{m}" for m in MEASURES
    ) + " FROM dirty",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "kind")
    encoded = features.one_hot(_dirty_train(df), ["kind"]).transform(df)
    named = describe.vector_columns(encoded, "kind__onehot", [f"k_{m}" for m in MEASURES])
    return named.drop("kind", "kind__index", "kind__onehot")


@query(
    "dummies_drop_first",
    cte(DIRTY) + "SELECT event_id, " + ", ".join(
        f"CASE WHEN kind = '{m}' THEN 1 ELSE 0 END AS kind_{m}" for m in MEASURES[1:]
    ) + " FROM dirty",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "kind")
    return features.dummies_drop_first(df, ["kind"]).transform(df)


_PREP = (
    f", med AS (SELECT median(value) AS m FROM dirty WHERE {_TRAIN}), filled AS (SELECT event_id, coalesce(value, m) AS value, "
    f"coalesce(kind, {_MODE}) AS kind FROM dirty, med), s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM filled "
    f"WHERE {_TRAIN})"
)


@query(
    "column_transformer",
    cte(DIRTY) + _PREP + f" SELECT event_id, {R('(value - mu) / sd')} AS value, " + ", ".join(
        f"CASE WHEN kind = '{m}' THEN 1.0::DOUBLE ELSE 0.0 END AS kind_{m}" for m in MEASURES
    ) + " FROM filled, s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "value", "kind")
    prepared = features.Preprocessor(["value"], ["kind"]).fit(_dirty_train(df)).transform(df)
    names = features.feature_names(prepared)
    return round_all(
        describe.vector_columns(prepared.select("event_id", "features"), "features", names).drop("features")
    )


@query(
    "feature_names",
    cte(DIRTY) + f"SELECT 0 AS slot, 'value' AS feature UNION ALL SELECT CAST(row_number() OVER (ORDER BY kind) AS INT), "
    f"'kind_' || kind FROM (SELECT DISTINCT kind FROM dirty WHERE {_TRAIN} AND kind IS NOT NULL)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "value", "kind")
    prepared = features.Preprocessor(["value"], ["kind"]).fit(_dirty_train(df)).transform(df)
    return spark.createDataFrame(list(enumerate(features.feature_names(prepared))), "slot int, feature string")


@query(
    "label_encode",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label, c_mktsegment AS decoded FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    encoder = features.label_encoder(df, "c_mktsegment")
    decoder = features.label_decoder(encoder.labelsArray[0], "label", "decoded")
    return PipelineModel([encoder, decoder]).transform(df).drop("c_mktsegment")


@query(
    "train_test_split",
    f"SELECT c_custkey, CASE WHEN {U('c_custkey', 42)} >= 0.8 THEN 'test' ELSE 'train' END AS part FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split.train_test_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_POSITION = (
    "pos AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
    "md5(c_custkey::VARCHAR || '-42'), c_custkey) - 1 AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)"
)


@query(
    "stratified_split",
    cte(_POSITION) + "SELECT c_custkey, c_mktsegment, p < CAST(round(n * 0.2) AS BIGINT) AS is_test FROM pos",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return split.mark_stratified(df, "c_mktsegment", ["c_custkey"])


@query("kfold", f"SELECT c_custkey, CAST(floor({U('c_custkey', 42)} * 5) AS INT) AS fold FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", split.kfold("c_custkey").alias("fold"))


@query("stratified_kfold", cte(_POSITION) + "SELECT c_custkey, c_mktsegment, CAST(p % 5 AS INT) AS fold FROM pos")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return split.stratified_kfold(df, "c_mktsegment", ["c_custkey"])


@query(
    "balanced_weights",
    cte(FLAT) + f", c AS (SELECT rating, count(*) AS n FROM flat GROUP BY 1) SELECT key, rating, "
    f"{R('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c)::DOUBLE * n)')} AS class_weight FROM flat JOIN c USING (rating)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(split.balanced_weights(flat(spark, sf).select("key", "rating"), "rating"))


# Two-feature least squares by Cramer's rule on population moments.
_SYSTEM = (
    "mom AS (SELECT count(*)::DOUBLE AS n, avg(p_size) AS m1, avg(p_partkey) AS m2, avg(p_retailprice) AS my, "
    "var_pop(p_size) AS s11, var_pop(p_partkey) AS s22, covar_pop(p_size, p_partkey) AS s12, "
    "covar_pop(p_size, p_retailprice) AS s1y, covar_pop(p_partkey, p_retailprice) AS s2y, "
    "var_pop(p_retailprice) AS syy FROM part)"
)


def _cramer(extra: str = "0") -> str:
    a, b = f"(s11 + {extra})", f"(s22 + {extra})"
    return (
        f"beta AS (SELECT *, (s1y * {b} - s2y * s12) / ({a} * {b} - s12 * s12) AS b1, "
        f"(s2y * {a} - s1y * s12) / ({a} * {b} - s12 * s12) AS b2 FROM mom)"
    )


_FIT_SQL = (
    f"SELECT 'const' AS term, {R('my - b1 * m1 - b2 * m2')} AS coef FROM beta UNION ALL SELECT 'p_size', {R('b1')} FROM beta "
    f"UNION ALL SELECT 'p_partkey', {R('b2')} FROM beta"
)
_PART = ["p_size", "p_partkey"]


def _terms(spark: SparkSession, fit: linear.LinearFit) -> DataFrame:
    rows = [("const", fit.intercept), *zip(fit.names, map(float, fit.coefficients))]
    return round_all(spark.createDataFrame(rows, "term string, coef double"))


@query("ols", cte(_SYSTEM, _cramer()) + _FIT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, linear.ols(table(spark, sf, "part"), _PART, "p_retailprice"))


@query("ridge", cte(_SYSTEM, _cramer("100 / n")) + _FIT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, linear.ridge(table(spark, sf, "part"), _PART, "p_retailprice", 100.0))


_ONE = "one AS (SELECT avg(qty) AS mx, avg(y) AS my, var_pop(qty) AS sxx, covar_pop(qty, y) AS sxy FROM flat)"


@query(
    "lasso",
    cte(FLAT, _ONE) + ", b AS (SELECT *, sign(sxy) * greatest(abs(sxy) - 1.0, 0) / sxx AS b1 FROM one) "
    f"SELECT 'const' AS term, {R('my - b1 * mx', 4)} AS coef FROM b UNION ALL SELECT 'qty', {R('b1', 4)} FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear.lasso(flat(spark, sf), ["qty"], "y", 1.0)
    rows = [("const", fit.intercept), ("qty", float(fit.coefficients[0]))]
    return round_all(spark.createDataFrame(rows, "term string, coef double"), 4)


@query(
    "elastic_net",
    cte(FLAT, _ONE) + ", b AS (SELECT *, sign(sxy) * greatest(abs(sxy) - 0.5, 0) / (sxx + 0.5) AS b1 FROM one) "
    f"SELECT 'const' AS term, {R('my - b1 * mx', 4)} AS coef FROM b UNION ALL SELECT 'qty', {R('b1', 4)} FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear.elastic_net(flat(spark, sf), ["qty"], "y", 1.0, 0.5)
    rows = [("const", fit.intercept), ("qty", float(fit.coefficients[0]))]
    return round_all(spark.createDataFrame(rows, "term string, coef double"), 4)


_SUMMARY = (
    "x AS (SELECT count(*)::DOUBLE AS n, covar_pop(qty, y) / var_pop(qty) AS b, avg(y) - avg(qty) * covar_pop(qty, y) / "
    "var_pop(qty) AS a, avg(qty) AS mx, count(*) * var_pop(qty) AS sxx FROM flat), "
    "e AS (SELECT key, y - a - b * qty AS r FROM flat, x), "
    "o AS (SELECT r - lag(r) OVER (ORDER BY key) AS step, r FROM e), "
    "t AS (SELECT sum(r * r) AS sse, avg(r * r) AS m2, avg(r * r * r) AS m3, avg(r * r * r * r) AS m4, sum(step * step) AS steps FROM o), "
    "v AS (SELECT x.*, t.*, 1 - sse / (SELECT count(*) * var_pop(y) FROM flat) AS r2, sse / (n - 2) AS s2, "
    "-n / 2 * (ln(2 * pi() * sse / n) + 1) AS llf FROM x, t)"
)


@query(
    "ols_inference",
    cte(FLAT, _SUMMARY) + f"SELECT 'const' AS term, {R('a')} AS coef, {R('sqrt(s2 * (1 / n + mx * mx / sxx))')} AS se, "
    f"{R('a / sqrt(s2 * (1 / n + mx * mx / sxx))', 3)} AS t FROM v UNION ALL SELECT 'qty', {R('b')}, {R('sqrt(s2 / sxx)')}, "
    f"{R('b / sqrt(s2 / sxx)', 3)} FROM v",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    coef, _ = linear.ols_inference(flat(spark, sf), ["qty"], "y")
    return coef.select("term", rounded(F.col("coef")).alias("coef"), rounded(F.col("se")).alias("se"), rounded(F.col("t"), 3).alias("t"))


@query(
    "ols_summary",
    cte(FLAT, _SUMMARY) + f"SELECT n::BIGINT AS n, {R('r2')} AS r2, {R('1 - (1 - r2) * (n - 1) / (n - 2)')} AS adj_r2, "
    f"{R('r2 / (1 - r2) * (n - 2)', 2)} AS f, {R('llf', 3)} AS llf, {R('4 - 2 * llf', 3)} AS aic, {R('2 * ln(n) - 2 * llf', 3)} AS bic, "
    f"{R('m3 / pow(m2, 1.5)')} AS skew, {R('m4 / (m2 * m2)')} AS kurtosis, "
    f"{R('n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)', 3)} AS jarque_bera, {R('steps / sse')} AS durbin_watson FROM v",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, s = linear.ols_inference(flat(spark, sf), ["qty"], "y", order=["key"])
    digits = {"f": 2, "llf": 3, "aic": 3, "bic": 3, "jarque_bera": 3}
    names = ("r2", "adj_r2", "f", "llf", "aic", "bic", "skew", "kurtosis", "jarque_bera", "durbin_watson")
    return s.select("n", *[rounded(F.col(c), digits.get(c, 6)).alias(c) for c in names])


def _irls(passes: int = 40) -> str:
    """Huber reweighting of ``actual ~ predicted`` unrolled in SQL."""
    steps = [
        "b0 AS MATERIALIZED (SELECT covar_pop(actual, predicted) / var_pop(predicted) AS b, avg(actual) - avg(predicted) * "
        "covar_pop(actual, predicted) / var_pop(predicted) AS a FROM guessed)"
    ]
    for i in range(passes):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT median(abs(actual - a - b * predicted)) / 0.6744897501960817 AS s FROM guessed, b{i})"
        )
        steps.append(
            f"w{i} AS (SELECT actual AS y, predicted AS x, least(1.0, 1.345 * s / nullif(abs(actual - a - b * predicted), 0)) AS w "
            f"FROM guessed, b{i}, s{i})"
        )
        steps.append(
            f"c{i} AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM (SELECT x, y, coalesce(w, 1.0) AS w FROM w{i}))"
        )
        steps.append(
            f"b{i + 1} AS MATERIALIZED (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, "
            f"max(my) - max(mx) * sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS a "
            f"FROM (SELECT x, y, coalesce(w, 1.0) AS w FROM w{i}), c{i})"
        )
    return ", ".join(steps)


@query(
    "robust_lm",
    cte(GUESSED, _irls()) + f"SELECT 'const' AS term, {R('a', 3)} AS coef FROM b40 UNION ALL SELECT 'predicted', {R('b', 3)} FROM b40",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear.robust_lm(guessed(spark, sf), ["predicted"], "actual")
    return fit.table(spark).select("term", rounded(F.col("coef"), 3).alias("coef"))


def _irls_pair(passes: int = 40) -> str:
    """Huber reweighting of ``actual ~ predicted + size`` without a constant, unrolled in SQL."""
    solve = (
        "SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM "
        "(SELECT sum(w * x1 * x1) AS s11, sum(w * x1 * x2) AS s12, sum(w * x2 * x2) AS s22, sum(w * x1 * y) AS s1y, sum(w * x2 * y) AS s2y FROM {rows})"
    )
    steps = [
        "d AS MATERIALIZED (SELECT actual AS y, predicted AS x1, size AS x2, 1.0::DOUBLE AS w FROM guessed)",
        f"b0 AS MATERIALIZED ({solve.format(rows='d')})",
    ]
    for i in range(passes + 1):
        steps.append(f"s{i} AS MATERIALIZED (SELECT median(abs(y - b1 * x1 - b2 * x2)) / 0.6744897501960817 AS s FROM d, b{i})")
        if i < passes:
            steps.append(
                f"w{i} AS (SELECT y, x1, x2, coalesce(least(1.0, 1.345 * s / nullif(abs(y - b1 * x1 - b2 * x2), 0)), 1.0) AS w FROM d, b{i}, s{i})"
            )
            steps.append(f"b{i + 1} AS MATERIALIZED ({solve.format(rows=f'w{i}')})")
    steps.append(
        f"z AS (SELECT (y - b1 * x1 - b2 * x2) / s AS z, x1, x2 FROM d, b{passes}, s{passes}), "
        "q AS (SELECT count(*)::DOUBLE AS n, avg((abs(z) <= 1.345)::INT) AS m, var_pop((abs(z) <= 1.345)::INT) AS v, "
        "sum(pow(greatest(least(z, 1.345), -1.345), 2)) AS psi2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22 FROM z), "
        f"f AS (SELECT q.*, b1, b2, pow(1 + 2 / n * v / (m * m), 2) * (psi2 / (n - 2) * s * s) / (m * m) / (s11 * s22 - s12 * s12) AS f FROM q, b{passes}, s{passes})"
    )
    return ", ".join(steps)


@query(
    "robust_lm_no_constant",
    cte(GUESSED, _irls_pair()) + f"SELECT 'predicted' AS term, {R('b1', 4)} AS coef, {R('sqrt(f * s22)', 5)} AS se, {R('b1 / sqrt(f * s22) / 1000', 2)} AS kilo_z "
    f"FROM f UNION ALL SELECT 'size', {R('b2', 4)}, {R('sqrt(f * s11)', 5)}, {R('b2 / sqrt(f * s11) / 1000', 2)} FROM f",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = linear.robust_lm(guessed(spark, sf), ["predicted", "size"], "actual", constant=False)
    found = fit.table(spark)
    kilo = rounded(F.col("z") / 1000, 2).alias("kilo_z")
    return found.select("term", rounded(F.col("coef"), 4).alias("coef"), rounded(F.col("se"), 5).alias("se"), kilo)


@query(
    "vif",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {R('1 / (1 - pow(corr(p_size, p_partkey), 2))')} AS vif FROM part" for c in _PART
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(linear.vif(table(spark, sf, "part"), _PART))


@query(
    "coefficient_table",
    cte(_SYSTEM, _cramer()) + f"SELECT 'p_size' AS feature, {R('b1')} AS coef, {R('abs(b1)')} AS abs_coef FROM beta UNION ALL "
    f"SELECT 'p_partkey', {R('b2')}, {R('abs(b2)')} FROM beta",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(linear.coefficient_table(spark, linear.ols(table(spark, sf, "part"), _PART, "p_retailprice")))


@query(
    "fit_line",
    cte(_SYSTEM, _cramer()) + f"SELECT p_partkey, {R('my + b1 * (p_size - m1) + b2 * (p_partkey - m2)')} AS predicted FROM part, beta",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part")
    fit = linear.ols(df, _PART, "p_retailprice")
    return round_all(fit.transform(df).select("p_partkey", "predicted"))


_SIDES = (
    "q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE " + U("vec_id", 42) + " >= 0.8), "
    "r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE " + U("vec_id", 42) + " < 0.8)"
)


def _near(distance: str, k: int = 5) -> str:
    return (
        f"near AS (SELECT * FROM (SELECT vec_id, neighbor, label, distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY "
        f"distance, neighbor) AS INT) AS \"rank\" FROM (SELECT q.vec_id, r.vec_id AS neighbor, r.label, round({distance}, 6) AS distance "
        f"FROM q, r)) WHERE \"rank\" <= {k})"
    )


_EUCLID = "list_distance(q.e, r.e)"
_MANHATTAN = "list_sum(list_transform(list_zip(q.e, r.e), lambda p: abs(p[1] - p[2])))"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    reference, asked = split.train_test_split(table(spark, sf, "embeddings"), "vec_id")
    return asked, reference


@query("knn_join", cte(_SIDES, _near(_EUCLID)) + f"SELECT vec_id, neighbor, {R('distance')} AS distance, \"rank\" FROM near")
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked, reference = _sides(spark, sf)
    return round_all(neighbors.knn_join(asked, reference, 5, "vec_id", "vec_id", "embedding"))


@query(
    "knn_join_cells",
    cte(_SIDES, _near(_EUCLID)) + f"SELECT vec_id, neighbor, {R('distance')} AS distance, \"rank\" FROM near",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked, reference = _sides(spark, sf)
    # The route for reference sets too large to ship, forced by a zero size limit.
    return round_all(
        neighbors.knn_join(asked, reference, 5, "vec_id", "vec_id", "embedding", pivots=8)
    )


_VOTE = (
    ", votes AS (SELECT vec_id, label, sum(vote) AS v FROM near GROUP BY 1, 2) SELECT vec_id, "
    "arg_min(label, (-v, label)) AS predicted, {share} AS share FROM votes GROUP BY 1"
)


@query(
    "knn_classify",
    cte(_SIDES, _near(_EUCLID)).replace("SELECT * FROM (SELECT vec_id", "SELECT *, 1.0::DOUBLE AS vote FROM (SELECT vec_id")
    + _VOTE.replace("{share}", R("max(v) / sum(v)")),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked, reference = _sides(spark, sf)
    return round_all(
        neighbors.knn_classify(asked, reference, "label", 5, "vec_id", "vec_id", "embedding")
    )


@query(
    "knn_classify_distance",
    cte(_SIDES, _near(_MANHATTAN)).replace("SELECT * FROM (SELECT vec_id", "SELECT *, 1.0::DOUBLE / distance AS vote FROM (SELECT vec_id")
    + _VOTE.replace("{share}", R("max(v) / sum(v)")),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked, reference = _sides(spark, sf)
    return round_all(
        neighbors.knn_classify(
            asked, reference, "label", 5, "vec_id", "vec_id", "embedding", "manhattan", "distance"
        )
    )


@query(
    "knn_regress",
    cte(_SIDES, _near(_EUCLID)) + f"SELECT vec_id, {R('avg(label)')} AS predicted FROM near GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked, reference = _sides(spark, sf)
    return round_all(neighbors.knn_regress(asked, reference, "label", 5, "vec_id", "vec_id", "embedding"))


_TRAINED = (
    "mom AS (SELECT avg(qty) AS m1, avg(discount) AS m2, avg(y) AS my, var_pop(qty) AS s11, var_pop(discount) AS s22, "
    "covar_pop(qty, discount) AS s12, covar_pop(qty, y) AS s1y, covar_pop(discount, y) AS s2y FROM flat "
    f"WHERE {U('key', 42)} < 0.8)"
)
_ERR = "avg((y - p) * (y - p))"


@query(
    "threshold_regression",
    cte(FLAT, _TRAINED, _cramer()) + f", pred AS (SELECT CASE WHEN {U('key', 42)} < 0.8 THEN 'train' ELSE 'test' END AS part, y, "
    f"my + b1 * (qty - m1) + b2 * (discount - m2) AS p FROM flat, beta) SELECT part, count(*) AS n, {R(f'sqrt({_ERR})')} AS rmse, "
    f"{R(f'1 - {_ERR} / var_pop(y)')} AS r2, {R(f'1 - {_ERR} / var_pop(y) * (count(*) - 1) / (count(*) - 3)')} AS adj_r2 "
    "FROM pred GROUP BY part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, scores = flows.threshold_regression(flat(spark, sf), ["qty", "price", "discount", "tax"], "y", "key")
    return round_all(scores.select("part", "n", "rmse", "r2", "adj_r2"))


@query("change_regression")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return flows.change_regression(visits(spark, sf), COLUMNS[1:], COLUMNS[0])["metrics"]


@query("change_regression_errors")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return flows.change_regression(visits(spark, sf), COLUMNS[1:], COLUMNS[0])["rows"]
