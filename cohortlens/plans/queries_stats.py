"""Registered queries: aggregates, correlations, rank tests, plot tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import clean, describe, hypothesis, metrics, plotdata, ranks
from cohortlens.plans import flows
from cohortlens.plans.standins import (
    COLUMNS,
    ERFC,
    FLAT,
    GRADED,
    GUESSED,
    KOLMOGOROV,
    TALL,
    VISITS,
    R,
    cte,
    flat,
    graded,
    guessed,
    query,
    round_all,
    rounded,
    table,
    visits,
)

TIMEPOINTS = ("T0", "T2")
NUMERIC = ("qty", "price", "discount", "tax")


def _two(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).where(F.col("timepoint").isin(*TIMEPOINTS))


_TWO_TALL = cte(VISITS, TALL, "two AS (SELECT * FROM tall WHERE timepoint IN ('T0', 'T2'))")


@query("count_rows", cte(VISITS) + "SELECT timepoint, count(*) AS n FROM visits GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return describe.count_rows(visits(spark, sf), ["timepoint"])


@query(
    "describe",
    _TWO_TALL
    + f"SELECT timepoint, measure, count(value) AS n, {R('avg(value)')} AS mean, "
    f"{R('stddev_samp(value)')} AS sd, {R('min(value)')} AS min, {R('quantile_cont(value, 0.25)')} AS q25, "
    f"{R('quantile_cont(value, 0.5)')} AS q50, {R('quantile_cont(value, 0.75)')} AS q75, "
    f"{R('max(value)')} AS max FROM two GROUP BY 1, 2",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(describe.describe(_two(spark, sf), COLUMNS, ["timepoint"], few_groups=True))


@query(
    "group_median",
    cte(FLAT)
    + " UNION ALL ".join(
        f"SELECT flag, '{c}' AS measure, {R(f'median({c})')} AS median FROM flat GROUP BY flag" for c in NUMERIC
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(describe.group_median(flat(spark, sf), NUMERIC, ["flag"]))


@query(
    "average_ranks",
    "SELECT p_size::DOUBLE AS value, count(*) AS n, "
    "min(rk) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank "
    "FROM (SELECT p_size, rank() OVER (ORDER BY p_size) AS rk FROM part) GROUP BY p_size",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tall = ranks.long_measures(table(spark, sf, "part"), ["p_size"])
    ranked = ranks.average_ranks(tall, "value", ["measure"], few_groups=True)
    return ranked.select("value", "n", "avg_rank")


@query(
    "value_counts",
    cte(VISITS)
    + "SELECT c.pain_class, c.ordinal, coalesce(n, 0) AS n FROM (VALUES ('0-1', 0), ('2-9', 1), ('10', 2), "
    "('11+', 3)) c(pain_class, ordinal) LEFT JOIN (SELECT CASE WHEN rating <= 1 THEN '0-1' WHEN rating <= 9 "
    "THEN '2-9' ELSE '10' END AS pain_class, count(*) AS n FROM visits GROUP BY 1) v USING (pain_class)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("rating")
    binned = visits(spark, sf).withColumn(
        "pain_class", F.when(r <= 1, "0-1").when(r <= 9, "2-9").otherwise("10")
    )
    return describe.value_counts(binned, "pain_class", ["0-1", "2-9", "10", "11+"])


@query(
    "distinct_counts",
    cte(VISITS) + "SELECT timepoint, count(DISTINCT subject_id) AS subjects, count(DISTINCT rating) AS ratings "
    "FROM visits GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).groupBy("timepoint").agg(
        F.count_distinct("subject_id").alias("subjects"), F.count_distinct("rating").alias("ratings")
    )


@query(
    "min_class_count",
    cte(VISITS) + "SELECT min(n) AS smallest FROM (SELECT rating, count(*) AS n FROM visits GROUP BY 1)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.class_counts(visits(spark, sf), "rating").agg(F.min("n").alias("smallest"))


@query("corr_pair", cte(FLAT) + f"SELECT {R('corr(qty, y)')} AS corr FROM flat")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(describe.corr_pair(flat(spark, sf), "qty", "y"))


@query(
    "corr_with_target",
    cte(FLAT)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {R(f'corr({c}, y)')} AS corr, {R(f'abs(corr({c}, y))')} AS abs_corr FROM flat"
        for c in NUMERIC
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(describe.corr_with_target(flat(spark, sf), NUMERIC, "y"))


_MATRIX = ("qty", "discount", "y")


@query(
    "corr_matrix",
    cte(FLAT)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, {R(f'corr({a}, {b})')} AS corr FROM flat"
        for a in _MATRIX
        for b in _MATRIX
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(describe.corr_matrix(flat(spark, sf), _MATRIX))


@query(
    "max_error_row",
    cte(GUESSED)
    + f"SELECT key, {R('actual')} AS actual, {R('predicted')} AS predicted, {R('abs(actual - predicted)')} AS abs_error "
    "FROM guessed ORDER BY abs(actual - predicted) DESC, key LIMIT 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(metrics.max_error_row(guessed(spark, sf), "key"))


@query(
    "pct_within",
    cte(GUESSED)
    + "SELECT count(*) AS n, count(*) FILTER (abs(predicted - actual) < 5) AS n_within, "
    f"{R('avg(CASE WHEN abs(predicted - actual) < 5 THEN 100.0 ELSE 0 END)')} AS pct_within FROM guessed",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(metrics.pct_within(guessed(spark, sf), 5.0))


_MAPE = "avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100"
_MSE = "avg((actual - predicted) * (actual - predicted))"


@query(
    "regression_metrics",
    cte(GUESSED)
    + f"SELECT count(*) AS n, {R(_MSE, 4)} AS mse, {R(f'sqrt({_MSE})')} AS rmse, "
    f"{R('avg(abs(actual - predicted))')} AS mae, {R(f'1 - {_MSE} / var_pop(actual)')} AS r2, "
    f"{R(f'1 - ({_MSE} / var_pop(actual)) * (count(*) - 1) / (count(*) - 3)')} AS adj_r2, {R(_MAPE)} AS mape "
    "FROM guessed",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.regression_metrics(guessed(spark, sf), n_features=2)
    return m.select("n", rounded(F.col("mse"), 4).alias("mse"), *[rounded(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "adj_r2", "mape")])


@query(
    "target_met",
    cte(GUESSED)
    + f"SELECT bucket, CASE WHEN {_MAPE} <= 0.5 THEN 'mape' WHEN sqrt({_MSE}) <= 100 THEN 'rmse' ELSE 'missed' END "
    "AS goal FROM (SELECT *, CAST(size AS INT) // 10 AS bucket FROM guessed) GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = guessed(spark, sf).withColumn("bucket", F.floor(F.col("size") / 10).cast("int"))
    m = metrics.regression_metrics(df, by=["bucket"])
    return m.select("bucket", metrics.target_verdict(F.col("mape"), F.col("rmse"), 0.5, 100.0).alias("goal"))


@query(
    "sort_by_abs",
    cte(GUESSED) + f"SELECT key, {R('actual - predicted')} AS residual FROM guessed",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    return guessed(spark, sf).select("key", error.alias("e")).orderBy(
        F.desc_nulls_last(F.abs("e")), "key"
    ).select("key", rounded(F.col("e")).alias("residual"))


@query(
    "top_k",
    cte(GUESSED) + f"SELECT key, {R('abs(actual - predicted)')} AS abs_error FROM guessed "
    "ORDER BY abs(actual - predicted) DESC, key LIMIT 15",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    error = F.abs(F.col("actual") - F.col("predicted"))
    return round_all(
        guessed(spark, sf).select("key", error.alias("abs_error")).orderBy(F.desc("abs_error"), "key").limit(15)
    )


@query("scalar_math", f"SELECT event_id, {R('sqrt(abs(value - 50))')} AS root FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", rounded(F.sqrt(F.abs(F.col("value") - 50))).alias("root")
    )


# Rank statistics by the textbook route: rank() windows, tie groups and empirical steps.
_RANKED = _TWO_TALL + (
    ", r AS (SELECT measure, timepoint, value, rank() OVER (PARTITION BY measure ORDER BY value) + "
    "(count(*) OVER (PARTITION BY measure, value) - 1) / 2.0 AS rk, "
    "count(*) OVER (PARTITION BY measure, value) AS t FROM two), "
    "s AS (SELECT measure, count(*) FILTER (timepoint = 'T0') AS n1, count(*) FILTER (timepoint = 'T2') AS n2, "
    "sum(rk) FILTER (timepoint = 'T0') AS r1, sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM r GROUP BY 1), "
    "u AS (SELECT measure, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 * n2 / 2.0 AS mu, "
    "sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS sd FROM s)"
)
_STEPS = (
    ", steps AS (SELECT measure, value, (sum(count(*) FILTER (timepoint = 'T0')) OVER w)::DOUBLE AS c1, "
    "(sum(count(*) FILTER (timepoint = 'T2')) OVER w)::DOUBLE AS c2 FROM two GROUP BY measure, value "
    "WINDOW w AS (PARTITION BY measure ORDER BY value)), "
    "d AS (SELECT measure, max(abs(c1 / n1 - c2 / n2)) AS ks_d FROM steps JOIN u USING (measure) GROUP BY 1)"
)
_Z = "((greatest(u1, 2 * mu - u1) - mu - 0.5) / sd)"
_P2 = f"least(1.0, {ERFC(f'{_Z} / {math.sqrt(2)!r}')})"
_Z_GREATER = "((u1 - mu - 0.5) / sd)"
_P1 = f"({ERFC(f'{_Z_GREATER} / {math.sqrt(2)!r}')}) / 2"
_LAM = "(ks_d * sqrt(n1 * n2 / (n1 + n2)::DOUBLE))"


@query(
    "mann_whitney",
    _RANKED + f" SELECT measure, n1, n2, {R('u1')} AS u1, {R(_P2)} AS p_value FROM u",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(hypothesis.mann_whitney(visits(spark, sf), COLUMNS))


@query(
    "mann_whitney_greater",
    _RANKED + f" SELECT measure, n1, n2, {R('u1')} AS u1, {R(_P1)} AS p_value, "
    f"CASE WHEN {_P1} < 0.001 THEN 'p < 0.001' WHEN {_P1} < 0.05 THEN 'p < 0.05' ELSE 'none' END AS verdict FROM u",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tested = hypothesis.mann_whitney(visits(spark, sf), COLUMNS, alternative="greater")
    return round_all(tested.withColumn("verdict", hypothesis.decrease_verdict(F.col("p_value"))))


@query(
    "ks_2sample",
    _RANKED + _STEPS + f" SELECT measure, n1, n2, {R('ks_d')} AS ks_d, {R(KOLMOGOROV(_LAM))} AS p_value FROM u JOIN d USING (measure)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(hypothesis.ks_2sample(visits(spark, sf), COLUMNS))


_SCREEN = (
    _RANKED + _STEPS + ", m AS (SELECT measure, median(value) FILTER (timepoint = 'T0') AS median_a, "
    "median(value) FILTER (timepoint = 'T2') AS median_b FROM two GROUP BY 1), "
    f"p AS (SELECT *, {_P2} AS p_median, {KOLMOGOROV(_LAM)} AS p_distribution FROM u JOIN d USING (measure) "
    "JOIN m USING (measure))"
)
_VERDICT = (
    "CASE WHEN p_median < 0.05 AND p_distribution < 0.05 THEN 'both' WHEN p_median < 0.05 THEN 'median' "
    "WHEN p_distribution < 0.05 THEN 'distribution' ELSE 'none' END"
)


@query(
    "biomarker_screen",
    _SCREEN + f" SELECT measure, n1, n2, {R('median_a')} AS median_a, {R('median_b')} AS median_b, {R('u1')} AS u1, "
    f"{R('p_median')} AS p_median, {R('ks_d')} AS ks_d, {R('p_distribution')} AS p_distribution, {_VERDICT} AS verdict FROM p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(hypothesis.biomarker_screen(visits(spark, sf), COLUMNS))


_LI_UNPIVOT = (
    "two AS (" + " UNION ALL ".join(f"SELECT '{c}' AS measure, status AS timepoint, {c} AS value FROM flat" for c in ("qty", "price", "discount", "tax", "y")) + ")"
)


@query(
    "biomarker_screen_flat",
    (_SCREEN.replace("'T0'", "'F'").replace("'T2'", "'O'").replace(
        _TWO_TALL.replace("'T0'", "'F'").replace("'T2'", "'O'"), cte(FLAT, _LI_UNPIVOT))
    ) + f" SELECT measure, n1, n2, {R('median_a')} AS median_a, {R('median_b')} AS median_b, {R('u1', 2)} AS u1, "
    f"{R('p_median')} AS p_median, {R('ks_d')} AS ks_d, {R('p_distribution')} AS p_distribution, {_VERDICT} AS verdict FROM p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    screened = hypothesis.biomarker_screen(flat(spark, sf), [*NUMERIC, "y"], "status", "F", "O")
    return screened.select(*[
        rounded(F.col(c), 2 if c == "u1" else 6).alias(c) if t == "double" else F.col(c)
        for c, t in screened.dtypes
    ])


_PAIRED2 = (
    "paired AS (SELECT subject_id, avg(v_view) FILTER (timepoint = 'T0') AS a0, avg(v_view) FILTER (timepoint = 'T2') AS a2, "
    "avg(v_click) FILTER (timepoint = 'T0') AS b0, avg(v_click) FILTER (timepoint = 'T2') AS b2 FROM visits GROUP BY 1), "
    "ch AS (SELECT a2 - a0 AS v_view_Change, b2 - b0 AS v_click_Change FROM paired WHERE a0 IS NOT NULL AND a2 IS NOT NULL "
    "AND b0 IS NOT NULL AND b2 IS NOT NULL)"
)


@query(
    "paired_change_report",
    cte(VISITS, _PAIRED2)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count({c}) AS n, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS sd, "
        f"{R(f'min({c})')} AS min, {R(f'quantile_cont({c}, 0.25)')} AS q25, {R(f'median({c})')} AS q50, "
        f"{R(f'quantile_cont({c}, 0.75)')} AS q75, {R(f'max({c})')} AS max FROM ch"
        for c in ("v_view_Change", "v_click_Change")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(flows.paired_change_report(visits(spark, sf), ["v_view"], "v_click")[0])


@query(
    "paired_change_corr",
    cte(VISITS, _PAIRED2) + f"SELECT count(*) AS n, {R('corr(v_view_Change, v_click_Change)')} AS corr_v_view FROM ch",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(flows.paired_change_report(visits(spark, sf), ["v_view"], "v_click")[1])


@query(
    "histogram_table",
    _TWO_TALL
    + ", e AS (SELECT timepoint, measure, count(*) AS ng, min(value) AS lo, max(value) AS hi FROM two GROUP BY 1, 2), "
    "c AS (SELECT timepoint, measure, CAST(least(19, floor((value - lo) / (hi - lo) * 20)) AS INT) AS bin, count(*) AS n "
    "FROM two JOIN e USING (timepoint, measure) GROUP BY 1, 2, 3) "
    f"SELECT timepoint, measure, g.bin::INT AS bin, {R('lo + g.bin * (hi - lo) / 20')} AS bin_lo, "
    f"{R('lo + (g.bin + 1) * (hi - lo) / 20')} AS bin_hi, coalesce(n, 0) AS n, "
    f"{R('coalesce(n, 0) / (ng * (hi - lo) / 20)')} AS density "
    "FROM e CROSS JOIN (SELECT unnest(range(20)) AS bin) g LEFT JOIN c USING (timepoint, measure, bin)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(plotdata.histogram_table(_two(spark, sf), COLUMNS, ["timepoint"], 20, few_groups=True))


@query(
    "kde_table",
    _TWO_TALL
    + ", e AS (SELECT timepoint, measure, count(*) AS ng, min(value) AS lo, max(value) AS hi, "
    "stddev_samp(value) * pow(count(*), -0.2) AS bw FROM two GROUP BY 1, 2), "
    "v AS (SELECT timepoint, measure, value, count(*) AS n FROM two GROUP BY 1, 2, 3) "
    f"SELECT timepoint, measure, g.point::INT AS point, {R('max(lo + g.point * (hi - lo) / 49)')} AS x, "
    f"{R(f'sum(n * exp(-0.5 * pow((lo + g.point * (hi - lo) / 49 - value) / bw, 2)) / (ng * bw * {math.sqrt(2 * math.pi)!r}))', 8)} AS density "
    "FROM v JOIN e USING (timepoint, measure) CROSS JOIN (SELECT unnest(range(50)) AS point) g GROUP BY 1, 2, 3",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = plotdata.kde_table(_two(spark, sf), COLUMNS, ["timepoint"], 50, few_groups=True)
    return k.withColumns({"x": rounded(F.col("x")), "density": rounded(F.col("density"), 8)})


_FENCED = _TWO_TALL + (
    ", q AS (SELECT timepoint, measure, quantile_cont(value, 0.25) AS q25, median(value) AS q50, "
    "quantile_cont(value, 0.75) AS q75 FROM two GROUP BY 1, 2), f AS (SELECT two.*, q25, q50, q75, "
    "value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM two JOIN q USING (timepoint, measure))"
)


@query(
    "boxplot_table",
    _FENCED + f" SELECT timepoint, measure, count(*) AS n, {R('max(q25)')} AS q25, {R('max(q50)')} AS q50, "
    f"{R('max(q75)')} AS q75, {R('min(value) FILTER (inside)')} AS whisker_lo, {R('max(value) FILTER (inside)')} AS whisker_hi, "
    "count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY 1, 2",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(plotdata.boxplot_table(_two(spark, sf), COLUMNS, ["timepoint"], few_groups=True))


@query("boxplot_outliers", _FENCED + " SELECT event_id, timepoint, measure, value FROM f WHERE NOT inside")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return plotdata.boxplot_outliers(_two(spark, sf), COLUMNS, ["event_id"], ["timepoint"], few_groups=True)


@query(
    "scatter_table",
    cte(VISITS, _PAIRED2) + f"SELECT {R('v_view_Change')} AS x, {R('v_click_Change')} AS y FROM ch",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ch = flows.paired_changes(visits(spark, sf), ["v_view", "v_click"])
    return round_all(plotdata.scatter_table(ch, "v_view_Change", "v_click_Change"))


@query(
    "error_vs_feature",
    cte(GUESSED)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {R(f'corr({c}, actual - predicted)')} AS corr, "
        f"{R(f'abs(corr({c}, actual - predicted))')} AS abs_corr FROM guessed"
        for c in ("size", "key")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(describe.error_vs_feature(guessed(spark, sf), ["size", "key"], "actual", "predicted"))


_CONF = ", conf AS (SELECT actual, predicted, count(*) AS n FROM graded GROUP BY 1, 2)"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEG = "(VALUES " + ", ".join(f"('{s}')" for s in SEGMENTS) + ")"


@query(
    "confusion_matrix",
    cte(GRADED) + _CONF + f" SELECT a.l AS actual, p.l AS predicted, coalesce(n, 0) AS n FROM {_SEG} a(l) CROSS JOIN "
    f"{_SEG} p(l) LEFT JOIN conf ON conf.actual = a.l AND conf.predicted = p.l",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(graded(spark, sf), SEGMENTS)


_CLASS = _CONF + (
    f", k AS (SELECT l AS label, (SELECT coalesce(sum(n), 0) FROM conf WHERE actual = l AND predicted = l)::DOUBLE AS tp, "
    "(SELECT coalesce(sum(n), 0) FROM conf WHERE actual = l)::DOUBLE AS na, "
    f"(SELECT coalesce(sum(n), 0) FROM conf WHERE predicted = l)::DOUBLE AS np FROM {_SEG} s(l)), "
    "pr AS (SELECT label, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN na > 0 THEN tp / na ELSE 0 END "
    "AS recall, CASE WHEN na + np > 0 THEN 2 * tp / (na + np) ELSE 0 END AS f1, na FROM k)"
)


@query(
    "accuracy_metrics",
    cte(GRADED) + _CLASS + f" SELECT (SELECT count(*) FROM graded) AS n, "
    f"{R('(SELECT sum(tp) / sum(na) FROM k)')} AS accuracy, {R('(SELECT avg(recall) FROM pr WHERE na > 0)')} AS balanced_accuracy",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(metrics.accuracy_metrics(graded(spark, sf)))


@query(
    "classification_report",
    cte(GRADED) + _CLASS
    + f" SELECT label, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1, na::BIGINT AS support FROM pr "
    f"UNION ALL SELECT 'accuracy', {R('sum(tp) / sum(na)')}, {R('sum(tp) / sum(na)')}, {R('sum(tp) / sum(na)')}, sum(na)::BIGINT FROM k "
    f"UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, sum(na)::BIGINT FROM pr "
    f"UNION ALL SELECT 'weighted avg', {R('sum(precision * na) / sum(na)')}, {R('sum(recall * na) / sum(na)')}, "
    f"{R('sum(f1 * na) / sum(na)')}, sum(na)::BIGINT FROM pr",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(metrics.classification_report(graded(spark, sf), SEGMENTS))


@query(
    "roc_auc",
    cte(GRADED)
    + ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM graded), "
    "s AS (SELECT sum(label) AS n1, sum(1 - label) AS n0, sum(rk) FILTER (label = 1) AS r1 FROM r) "
    f"SELECT n1::BIGINT AS n_positive, n0::BIGINT AS n_negative, {R('(r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0)')} AS roc_auc FROM s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(metrics.roc_auc(graded(spark, sf), "label", "score"))


@query(
    "mape",
    cte(GUESSED)
    + "SELECT CASE WHEN actual = 0 THEN 'zero' ELSE 'known' END AS grp, CASE WHEN count(*) FILTER (actual <> 0) > 0 "
    f"THEN {R(_MAPE)} WHEN max(abs(predicted)) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS mape FROM guessed GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = guessed(spark, sf).withColumn("grp", F.when(F.col("actual") == 0, "zero").otherwise("known"))
    m = df.groupBy("grp").agg(metrics.mape_column(F.col("actual"), F.col("predicted")).alias("mape"))
    return m.withColumn("mape", F.when(F.col("mape") == math.inf, F.col("mape")).otherwise(rounded(F.col("mape"))))
