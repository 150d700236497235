import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import describe, hypothesis, metrics, pairing, plotdata, ranks


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("T0", float(v)) for v in (1, 2, 2, 3)] + [("T2", float(v)) for v in (2, 3, 4, 5)]
    return spark.createDataFrame(rows + [("T1", 100.0), ("T0", None)], "timepoint string, m double")


def test_rank_test_values(samples):
    r = hypothesis.mann_whitney(samples, ["m"]).first()
    assert (r.n1, r.n2, r.u1) == (4, 4, 2.5) and r.p_value == pytest.approx(0.1366582, abs=1e-6)
    g = hypothesis.mann_whitney(samples, ["m"], alternative="greater").first()
    assert g.p_value == pytest.approx(0.9629521, abs=1e-6)
    less = hypothesis.mann_whitney(samples, ["m"], alternative="less").first()
    assert less.p_value == pytest.approx(0.1366582 / 2, abs=1e-6)


def test_distribution_test_values(samples):
    r = hypothesis.ks_2sample(samples, ["m"]).first()
    assert r.ks_d == 0.5 and r.p_value == pytest.approx(0.6993742, abs=1e-6)


def test_measure_without_a_group_is_left_out(spark):
    df = spark.createDataFrame([("T0", 1.0, 1.0), ("T2", 2.0, None)], "timepoint string, a double, b double")
    assert [r.measure for r in hypothesis.biomarker_screen(df, ["a", "b"]).collect()] == ["a"]


def test_constant_measure_gives_p_one(spark):
    df = spark.createDataFrame([("T0", 1.0), ("T2", 1.0), ("T2", 1.0)], "timepoint string, a double")
    r = hypothesis.biomarker_screen(df, ["a"]).first()
    assert (r.p_median, r.ks_d, r.verdict) == (1.0, 0.0, "none")


def test_shift_is_found(spark):
    rng = random.Random(1)
    rows = [("T0" if i % 2 else "T2", rng.gauss(0.0 if i % 2 else 1.0, 1)) for i in range(600)]
    r = hypothesis.biomarker_screen(spark.createDataFrame(rows, "timepoint string, a double"), ["a"]).first()
    assert r.verdict == "both" and r.p_median < 1e-6


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_rank_test_against_brute_force_with_a_hot_value(spark, hot):
    rng = random.Random(7)
    rows = [
        (rng.choice(["T0", "T2"]), 0.25 if rng.random() < hot else round(rng.random(), 2)) for _ in range(1500)
    ]
    r = hypothesis.mann_whitney(spark.createDataFrame(rows, "timepoint string, a double"), ["a"]).first()
    a, b = ([v for t, v in rows if t == tp] for tp in ("T0", "T2"))
    assert r.u1 == brute_u(a, b) and (r.n1, r.n2) == (len(a), len(b))


def test_running_counts_many_groups_without_broadcast(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), float(rng.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double")
    cum = ranks.cumulative_counts(df, "v", ["g"], {"n": F.lit(1)})
    for r in cum.where("g < 5").collect():
        below = sum(1 for g, v in rows if g == r.g and v < r.value)
        assert (r.n_before, r.n_total) == (below, sum(1 for g, _ in rows if g == r.g))


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, v double")
    got = {r.value: r.avg_rank for r in ranks.average_ranks(df, "v", ["g"]).collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


@pytest.mark.parametrize("n,ties", [(1, False), (7, False), (5000, False), (5001, True)])
def test_select_quantiles(spark, n, ties):
    rng = random.Random(n)
    vals = [float(rng.randint(0, 3)) if ties else rng.random() for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for keep in (20, 60, ranks.KEEP_VALUES):
        got = ranks.select_quantiles(
            df, {"m": F.col("v"), "neg": -F.col("v"), "none": F.lit(None)}, 0.5, accuracy=200, keep=keep
        )
        assert got == {"m": statistics.median(vals), "neg": -statistics.median(vals)}


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    r = describe.describe(df, ["v"]).first()
    assert (r.n, r.mean, r["min"], r["max"], r.q25, r.q50, r.q75) == (4, 2.5, 1.0, 4.0, 1.75, 2.5, 3.25)
    assert r.sd == pytest.approx(1.2909944487)
    assert describe.group_median(df, ["v"], exact=False).first().median in (2.0, 3.0)


def test_constant_and_missing_in_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0)], "y double, c double, x double")
    rows = describe.corr_with_target(df, ["c", "x"], "y").collect()
    assert [(r.feature, r.corr) for r in rows] == [("x", pytest.approx(1.0)), ("c", None)]


def test_value_counts_keep_empty_classes(spark):
    df = spark.createDataFrame([("b",), ("b",), ("z",)], "c string")
    got = [(r.c, r.n) for r in describe.value_counts(df, "c", ["a", "b"]).collect()]
    assert got == [("a", 0), ("b", 2)]
    assert [(r.c, r.n) for r in describe.value_counts(df, "c").collect()] == [("b", 2), ("z", 1)]


def test_pairing_rules(spark):
    rows = [(1, "T0", 2.0), (1, "T0", 4.0), (1, "T2", 5.0), (2, "T0", 1.0), (3, "T2", None), (1, "T1", 9.0)]
    df = spark.createDataFrame(rows, "subject_id long, timepoint string, m double")
    got = pairing.with_changes(pairing.pair_timepoints(df, ["m"]), ["m"]).orderBy("subject_id").collect()
    assert [tuple(r) for r in got] == [(1, 3.0, 5.0, 2.0), (2, 1.0, None, None)]


def test_pairing_needs_every_measure(spark):
    rows = [(1, "T0", 1.0, None), (2, "T0", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "subject_id long, timepoint string, a double, b double")
    assert [r.subject_id for r in pairing.pair_timepoints(df, ["a", "b"]).collect()] == [2]
    assert pairing.pair_timepoints(df, ["a", "b"], require="any").count() == 2


def test_histogram_counts_and_density(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "v double")
    rows = plotdata.histogram_table(df, ["v"], bins=5).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 2, 0, 0, 1]
    assert sum(r.density * (r.bin_hi - r.bin_lo) for r in rows) == pytest.approx(1.0)
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert sum(r.n for r in plotdata.histogram_table(flat, ["v"], bins=4).collect()) == 2


def test_histogram_auto_bins(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    # Even data: the Freedman-Diaconis width 2*IQR/10 gives ten bins, Sturges eleven.
    assert plotdata.histogram_table(df, ["v"], bins="auto").count() == 11


def test_density_integrates_to_one(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(400)], "v double")
    rows = plotdata.kde_table(df, ["v"], points=100).orderBy("point").collect()
    step = rows[1].x - rows[0].x
    assert sum(r.density for r in rows) * step == pytest.approx(1.0, abs=0.03)


def test_boxplot(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    r = plotdata.boxplot_table(df, ["v"]).first()
    assert (r.whisker_lo, r.whisker_hi, r.outliers) == (1.0, 4.0, 1)


REG = [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0), (5.0, 7.0)]


def test_regression_metrics(spark):
    df = spark.createDataFrame(REG, "actual double, predicted double")
    r = metrics.regression_metrics(df).first()
    assert (r.n, r.mse, r.mae) == (4, 1.5, 1.0)
    assert (r.rmse, r.r2, r.adj_r2, r.mape) == tuple(
        pytest.approx(v, abs=1e-6) for v in (1.2247449, 0.5932203, 0.3898305, 21.6666667)
    )
    assert metrics.regression_metrics(df, n_features=3).first().adj_r2 is None


@pytest.mark.parametrize("pred,want", [(0.0, 0.0), (1.0, math.inf)])
def test_mape_without_nonzero_actuals(spark, pred, want):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, pred)], "actual double, predicted double")
    assert metrics.regression_metrics(df).first().mape == want


def test_classification(spark):
    df = spark.createDataFrame(list(zip("AAABBC", "AABBCC")), "actual string, predicted string")
    a = metrics.accuracy_metrics(df).first()
    assert (a.accuracy, a.balanced_accuracy) == (pytest.approx(4 / 6), pytest.approx(0.7222222, abs=1e-6))
    report = {r.label: r for r in metrics.classification_report(df, list("ABCD")).collect()}
    third = pytest.approx(2 / 3)
    assert [report["A"][c] for c in ("precision", "recall", "f1")] == [1.0, third, pytest.approx(0.8)]
    assert [report["C"][c] for c in ("precision", "recall", "f1")] == [0.5, 1.0, third]
    assert report["D"].support == 0 and report["D"].f1 == 0.0
    assert metrics.classification_report(df).count() == 6
    grid = metrics.confusion_matrix(df, list("ABC"))
    assert grid.count() == 9 and grid.agg(F.sum("n")).first()[0] == 6


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "label int, score double")
    assert metrics.roc_auc(df, "label", "score").first().roc_auc == 0.875
    one = df.where("label = 1")
    assert metrics.roc_auc(one, "label", "score").first().roc_auc is None


def test_error_helpers(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(REG)], "key int, actual double, predicted double")
    assert metrics.max_error_row(df, "key").first().key == 3
    w = metrics.pct_within(df, 1.0).first()
    assert (w.n_within, w.pct_within) == (1, 25.0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_value_rows_are_not_exchanged_on_the_group_alone(spark):
    """Without a broadcast a hot group's values are dealt by a salt as well."""
    from cohortlens.operators import plotdata

    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS g", "CAST(id AS DOUBLE) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (
            describe.group_median(df, ["v"], ["g"]),
            describe.describe(df, ["v"], ["g"]),
            plotdata.boxplot_table(df, ["v"], ["g"]),
            plotdata.histogram_table(df, ["v"], ["g"]),
        ):
            joins = [line for line in _plan(made).splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
            attached = [line for line in joins if "__bucket" not in line and "bin" not in line]
            assert attached and all("__salt" in line for line in attached), attached
            assert made.where("g = 'hot'").count() >= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_groups_are_groups(spark):
    from cohortlens.operators import plotdata

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0)], "g string, v double")
    for few in (False, True):
        rows = {r.g: r for r in describe.describe(df, ["v"], ["g"], few_groups=few).collect()}
        assert rows[None].n == 2 and rows[None].mean == 6.0 and rows[None].q50 == 6.0 and rows[None].sd == pytest.approx(2**0.5)
        assert {r.g for r in describe.group_median(df, ["v"], ["g"], few_groups=few).collect()} == {"a", None}
        assert {r.g for r in plotdata.boxplot_table(df, ["v"], ["g"], few_groups=few).collect()} == {"a", None}
        hist = plotdata.histogram_table(df, ["v"], ["g"], 2, few_groups=few).collect()
        assert sorted((str(r.g), r.n) for r in hist) == [("None", 1), ("None", 1), ("a", 1), ("a", 1)]


def test_salted_groups_give_the_same_numbers(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 2 AS g", "CAST(id * id % 977 AS DOUBLE) AS v")
    plain = describe.describe(df, ["v"], ["g"]).orderBy("g").collect()
    monkeypatch.setattr(ranks, "HOT_ROWS", 100)
    assert describe.describe(df, ["v"], ["g"]).orderBy("g").collect() == plain


def test_spread_of_large_values(spark):
    df = spark.range(1000).selectExpr("1e9 + id % 7 AS v")
    r = describe.describe(df, ["v"]).first()
    want = [1e9 + i % 7 for i in range(1000)]
    assert r.sd == pytest.approx(statistics.stdev(want), rel=1e-9) and r.mean == pytest.approx(statistics.fmean(want), rel=1e-12)


def test_buckets_follow_the_rows(spark, monkeypatch):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(900)] + [0.5] * 400 + [rng.expovariate(1.0) ** 8 for _ in range(300)]
    values += [math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, g int").repartition(3)

    def counted():
        found = ranks.cumulative_counts(df, "v", ["g"], {"n": F.lit(1)}, bits=2)
        return sorted((r.g, str(r.value), r.n, r.n_before, r.n_total) for r in found.collect())

    plain = counted()
    monkeypatch.setattr(ranks, "PART_ROWS", 20)
    assert counted() == plain
    own = sorted(v for i, v in enumerate(values) if i % 2 == 0 and not math.isnan(v))
    before = {(g, v): below for g, v, _, below, _ in plain}
    assert before[0, str(own[100])] == sum(v < own[100] for v in own) and before[0, "nan"] == len(own)
    # Every bucket is cut into as many parts as the group's rows ask for, in the order of the values.
    rows = [(v / 250, [0.5, 1.0, 2.0], 0.0, 4.0, 20.0) for v in range(1000)]
    placed = ranks._place(spark.createDataFrame(rows, "value double, __bounds array<double>, __lo double, __hi double, __parts double"), 2)
    buckets = [r["__bucket"] for r in placed.orderBy("value").collect()]
    assert buckets == sorted(buckets) and 75 <= len(set(buckets)) <= 81
