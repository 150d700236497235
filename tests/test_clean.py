import pytest
from pyspark.sql import types as T

from cohortlens.operators import clean
from cohortlens.sources import visits as src


def test_csv_timepoints_stay_text(spark, tmp_path):
    (tmp_path / "v.csv").write_text(
        "Number,Timepoint,Pain rating,CD4%,H/S-ratio\n1,T0,5,40.5,1.8\n1,T2,n/a,,2\n"
    )
    df = src.read_visits(spark, str(tmp_path / "v.csv"))
    assert {t for _, t in df.dtypes} == {"string"}
    named = src.rename_columns(df, src.VISIT_COLUMNS)
    assert named.columns == ["subject_id", "timepoint", "pain_rating", "cd4_percent", "hs_ratio"]
    rows = clean.coerce_numeric(named, ["pain_rating", "cd4_percent", "absent"]).collect()
    assert [(r.timepoint, r.pain_rating, r.cd4_percent) for r in rows] == [("T0", 5.0, 40.5), ("T2", None, None)]
    schema = src.visit_schema(df.columns)
    assert src.read_visits(spark, str(tmp_path / "v.csv"), schema).count() == 2


def test_missing_source(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_visits(spark, "/nowhere/at/all.csv")


def test_inline_records_and_profile(spark):
    schema = T.StructType().add("a", "double").add("b", "string")
    df = src.inline_records(spark, [{"a": 1.0}, {"a": float("nan"), "b": "x"}], schema)
    assert [tuple(r) for r in df.collect()] == [(1.0, None), (None, "x")]
    assert [tuple(r)[1:] for r in src.profile_table(df).orderBy("position").collect()] == [
        ("a", "double", 1, 1), ("b", "string", 1, 1),
    ]


def test_write_result_round_trip(spark, tmp_path):
    src.write_result(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sparse_columns_are_dropped_strictly_above_half(spark):
    df = spark.createDataFrame([(1, None, 1, i, None) for i in range(50)] + [(None, 2, 1, i, None) for i in range(50)],
                               "half int, other int, full int, k int, gone int")
    assert clean.drop_sparse_columns(df).columns == ["half", "other", "full", "k"]
    assert "gone" in clean.drop_sparse_columns(df, keep=["gone"]).columns


def test_rare_classes(spark):
    df = spark.createDataFrame([(c,) for c in "aaaaabbc"], "c string")
    assert {r.c for r in clean.drop_rare_classes(df, "c").collect()} == {"a", "b"}


def test_rows_without_a_class_stay(spark):
    for classes in (["a", "a", "b", None, None], ["a", "a", None, None], [None]):
        df = spark.createDataFrame([(c,) for c in classes], "c string")
        kept = sorted((r.c for r in clean.drop_rare_classes(df, "c").collect()), key=str)
        assert kept == sorted((c for c in classes if c != "b"), key=str)


def test_many_rare_classes(spark):
    df = spark.range(30_000).selectExpr("if(id < 10000, id, -1) AS c")
    assert clean.drop_rare_classes(df, "c").select("c").distinct().count() == 1


def test_excluded_keys_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    listed = spark.createDataFrame([(1,), (None,)], "k int")
    for keys in ([1], [1, None], listed):
        assert sorted((r.k for r in clean.exclude_keys(df, keys, "k").collect()), key=str) == [2, None]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, None)], "x double, n int")
    assert {r.feature: r.n_null for r in clean.null_fractions(df).collect()} == {"x": 1, "n": 1}


def test_strict_mapping(spark):
    df = spark.createDataFrame([("N", "Y"), ("Y", "?")], "p string, q string")
    df = clean.map_values_strict(clean.map_values_strict(df, "p", {"N": 0, "Y": 1}), "q", {"N": 0, "Y": 1})
    assert [tuple(r) for r in df.collect()] == [(0, "Y"), (1, "?")]


def test_strict_mapping_counts_null_as_unmapped(spark):
    df = spark.createDataFrame([("N",), (None,)], "p string")
    assert clean.map_values_strict(df, "p", {"N": 0}).schema["p"].dataType == T.StringType()


def test_dedupe_with_a_hot_subject(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) AS s", "3000 - id AS o", "id AS v")
    got = clean.dedupe_first(df, "s", ["o"])
    assert got.columns == ["s", "o", "v"] and got.count() == df.select("s").distinct().count()
    assert got.where("s = 0").first().v == 2997


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = [r.id for r in clean.sample_n(df, "id", 10, 1).collect()]
    b = [r.id for r in clean.sample_n(df.repartition(5), "id", 10, 1).collect()]
    assert a == b and len(set(a)) == 10


def test_align_schema(spark):
    schema = T.StructType().add("age", "double").add("iron", "double").add("sex", "string")
    rows = spark.createDataFrame([("r1", "40", "M", 1), ("r2", "old", None, 2)], "ref string, age string, sex string, extra int")
    got = clean.align_schema(rows, schema, keep=["ref"])
    assert got.columns == ["ref", "age", "iron", "sex"]
    assert [tuple(r) for r in got.collect()] == [("r1", 40.0, None, "M"), ("r2", None, None, None)]


def test_guards(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(6)], "v int, c string")
    assert clean.check_trainable(df, "c") == {"n": 6, "classes": 2}
    for bad in (df.limit(0), df.where("c = 'a'"), df.where("v < 3")):
        with pytest.raises(ValueError):
            clean.check_trainable(bad, "c")


def test_column_lists_and_sets(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert clean.numeric_columns(df, ["a"]) == ["c"] and clean.text_columns(df) == ["b"]
    assert clean.select_existing(df, ["c", "z"]).columns == ["c"]
    assert clean.drop_columns(df, ["b", "z"]).columns == ["a", "c"]
    keys = spark.createDataFrame([(1,)], "a int")
    assert clean.lookup_rows(df, keys, "a").count() == 1 and clean.exclude_keys(df, [1], "a").count() == 0
    assert clean.stack_groups({"T0": df, "T2": df}).groupBy("timepoint").count().count() == 2
