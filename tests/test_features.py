import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import features, split


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_median_and_mode_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (4.0, "a"), (None, None)], "v double, c string")
    assert column(features.impute_median(df, ["v"]).transform(df), "v")[-1] == 2.5
    assert column(features.impute_mode(df, ["c"]).transform(df), "c")[-1] == "a"
    assert features.fit_modes(df, ["c"]) == {"c": "a"}


def test_scaling(spark):
    df = spark.createDataFrame([(float(v), 7.0) for v in (1, 2, 3, 4)], "v double, k double")
    out = features.standard_scale(df, ["v", "k"]).transform(df)
    assert column(out, "v") == pytest.approx([-1.34164079, -0.4472136, 0.4472136, 1.34164079])
    assert column(out, "k") == [0.0] * 4


def test_one_hot_unseen_and_uneven_levels(spark):
    fit = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "c string, d string")
    new = spark.createDataFrame([("b", "y"), ("zzz", "x")], "c string, d string")
    out = features.one_hot(fit, ["c", "d"]).transform(new)
    got = [tuple(r) for r in out.select(vector_to_array("c__onehot"), vector_to_array("d__onehot")).collect()]
    assert got == [([0.0, 1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 0.0])]


def test_dummies(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "c string")
    out = features.dummies_drop_first(df, ["c"]).transform(df)
    assert [tuple(r) for r in out.collect()] == [(0, 0), (1, 0), (0, 1), (0, 0)]


def test_preprocessor_matches_step_by_step_and_survives_saving(spark, tmp_path):
    rows = [(1.0, "a"), (2.0, None), (None, "o'k"), (9.0, "a"), (None, "b\\c")]
    df = spark.createDataFrame(rows, "v double, c string")
    model = Pipeline(stages=[features.Preprocessor(["v"], ["c"])]).fit(df)
    out = model.transform(df)
    names = features.feature_names(out)
    assert names == ["v", "c_a", "c_b\\c", "c_o'k"]
    filled = [1.0, 2.0, 2.0, 9.0, 2.0]
    mean = sum(filled) / 5
    sd = math.sqrt(sum((x - mean) ** 2 for x in filled) / 5)
    got = [r[0] for r in out.select(vector_to_array("features")).collect()]
    assert [g[0] for g in got] == pytest.approx([(x - mean) / sd for x in filled])
    assert [g[1:] for g in got] == [[1, 0, 0], [1, 0, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0]]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df)
    assert [r[0] for r in again.select(vector_to_array("features")).collect()] == got


def test_unscaled_with_passthrough(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 6)], "v double, k int")
    out = features.Preprocessor(["v"], passthrough=["k"], scale=False).fit(df).transform(df)
    assert [r[0] for r in out.select(vector_to_array("features")).collect()] == [[1.0, 5.0], [1.0, 6.0]]


def test_fit_does_not_see_test_rows(spark):
    df = spark.range(500).selectExpr("id", "CAST(id AS DOUBLE) AS v")
    train, test = split.train_test_split(df, "id")
    changed = train.unionByName(test.withColumn("v", F.col("v") * 1000))
    before = features.fit_medians(train, ["v"])
    assert before == features.fit_medians(split.train_test_split(changed, "id")[0], ["v"])


def test_levels_have_no_limit(spark):
    df = spark.range(120_000).selectExpr("CAST(id AS STRING) AS c", "if(id < 2, 'x', 'y') AS d")
    levels = features.fit_levels(df, ["c", "d"])
    assert len(levels["c"]) == 120_000 and levels["c"] == sorted(levels["c"]) and levels["d"] == ["x", "y"]
    assert features.fit_modes(df, ["c", "d"]) == {"c": "0", "d": "y"}


def test_rows_without_a_class_are_split_too(spark):
    df = spark.range(100).selectExpr("id", "if(id < 40, NULL, 'a') AS c")
    train, test = split.stratified_split(df, "c", ["id"])
    assert test.where("c IS NULL").count() == 8 and train.count() + test.count() == 100
    folds = split.stratified_kfold(df, "c", ["id"], 4).groupBy("c", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [10] * 4 + [15] * 4


def test_label_round_trip(spark):
    df = spark.createDataFrame([("High",), ("Not High",)], "c string")
    enc = features.label_encoder(df, "c")
    out = features.label_decoder(enc.labelsArray[0], "label", "back").transform(enc.transform(df))
    assert [tuple(r) for r in out.collect()] == [("High", 0.0, "High"), ("Not High", 1.0, "Not High")]


def test_split_is_complete_and_stable(spark):
    df = spark.range(2000)
    train, test = split.train_test_split(df, "id")
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    again = split.train_test_split(df.repartition(9), "id")[1]
    assert {r.id for r in again.collect()} == {r.id for r in test.collect()}
    assert 330 < test.count() < 470


def test_stratified_shares_are_exact_with_a_dominant_class(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 'big', 'small') AS c")
    train, test = split.stratified_split(df, "c", ["id"])
    assert {r.c: r["count"] for r in test.groupBy("c").count().collect()} == {"big": 180, "small": 20}
    assert train.count() == 800
    folds = split.stratified_kfold(df, "c", ["id"], 5).groupBy("c", "fold").count().collect()
    assert {(r.c, r["count"]) for r in folds} == {("big", 180), ("small", 20)}


def test_subject_stays_in_one_fold(spark):
    df = spark.range(1000).selectExpr("id", "id % 50 AS subject")
    folded = df.withColumn("f", split.kfold("subject", 5))
    assert folded.groupBy("subject").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0


def test_fold_rules():
    assert [split.choose_folds(n) for n in (1, 2, 3, 4, 5, 99)] == [2, 2, 3, 3, 5, 5]
    assert [split.choose_folds(n, "capped3") for n in (1, 2, 9)] == [2, 2, 3]
    assert [split.choose_folds(n, "capped5") for n in (1, 4, 9)] == [2, 4, 5]


def test_balanced_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(c,) for c in "aaab"], "c string")
    rows = split.balanced_weights(df, "c").collect()
    assert sum(r.class_weight for r in rows) == pytest.approx(4.0)
    assert {r.c: r.class_weight for r in rows} == {"a": pytest.approx(4 / 6), "b": 2.0}
