import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import columns as C
from cohortlens.functions.tails import f_sf, t_quantile, t_two_sided
from cohortlens.sources import visits
from cohortlens.plans.flows import (
    FIVE_GROUP_EDGES,
    FIVE_GROUP_LABELS,
    TWO_GROUP_EDGES,
    TWO_GROUP_LABELS,
)


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_five_groups(spark):
    df = spark.createDataFrame([(v,) for v in [*range(12), -1, None]], "v int")
    got = values(df, C.cut_bins("v", FIVE_GROUP_EDGES, FIVE_GROUP_LABELS))
    assert [g and g[0] for g in got] == list("EEEDDCCBBAA") + [None, None, None]


def test_two_groups(spark):
    df = spark.createDataFrame([(v,) for v in (0, 6, 7, 10, 11)], "v int")
    low, high = TWO_GROUP_LABELS
    assert values(df, C.cut_bins("v", TWO_GROUP_EDGES, TWO_GROUP_LABELS)) == [low, low, high, high, None]


def test_cut_excluding_lowest_and_bad_labels(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    assert values(df, C.cut_bins("v", (0, 1), ("a",), include_lowest=False)) == [None, "a"]
    with pytest.raises(ValueError):
        C.cut_bins("v", (0, 1), ("a", "b"))


def test_text_to_number_and_truncation(spark):
    df = spark.createDataFrame([("7.9",), ("-0.5",), ("abc",), (None,), ("NaN",)], "v string")
    assert values(df, C.numeric_or_null("v")) == [7.9, -0.5, None, None, None]
    assert values(df, C.truncate_to_int(C.numeric_or_null("v"))) == [7, 0, None, None, None]


def test_map_values(spark):
    df = spark.createDataFrame([("M",), ("F",), ("x",), (None,)], "g string")
    assert values(df, C.map_values("g", {"M": 0, "F": 1})) == [0, 1, None, None]


def test_hash_uniform_is_stable_and_even(spark):
    df = spark.range(20_000).withColumn("u", C.hash_uniform("id", 42))
    row = df.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(row.m - 0.5) < 0.01 and 0 <= row.lo and row.hi < 1
    moved = df.repartition(7).withColumn("u2", C.hash_uniform("id", 42))
    assert moved.where("u <> u2").count() == 0


def test_erfc_against_stdlib(spark):
    xs = [-5 + 0.37 * i for i in range(50)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in zip(xs, values(df, C.erfc(F.col("x")))):
        assert got == pytest.approx(math.erfc(x), rel=2e-7)


def test_kolmogorov_tail_is_continuous(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.1799, 1.1801, 3.0)], "x double")
    tiny, mid, left, right, far = values(df, C.kolmogorov_sf(F.col("x")))
    assert tiny == 1.0 and mid == pytest.approx(0.9639452436, abs=1e-8)
    assert left == pytest.approx(right, abs=1e-3) and far < 1e-7


def test_probability_text(spark):
    df = spark.createDataFrame([([0.125, 0.875],)], "p array<double>")
    assert values(df, C.format_probabilities(F.col("p"), ["A", "B"])) == ["A=12.5%, B=87.5%"]


def test_percent_error(spark):
    df = spark.createDataFrame([(2.0, 3.0), (0.0, 1.0)], "a double, p double")
    assert values(df, C.percent_error(F.col("p") - F.col("a"), F.col("a"))) == [50.0, None]


def test_driver_tails():
    # Student t with one degree of freedom is Cauchy; F(1, n) is a squared t.
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert t_two_sided(3.0, 1e7) == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-4)
    assert t_quantile(0.025, 10) == pytest.approx(2.2281388520, rel=1e-8)
    assert f_sf(4.0, 1, 12) == pytest.approx(t_two_sided(2.0, 12))


def test_truncate_dirty_values(spark):
    df = spark.createDataFrame([("abc",), ("1e12",), ("-2.9",), (None,), ("NaN",)], "x string")
    assert [r[0] for r in df.select(C.truncate_to_int("x")).collect()] == [None, None, -2, None, None]


def test_csv_schema_goes_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nbad,y\n")
    got = visits.read_visits(spark, str(tmp_path / "t.csv"), "b string, a int, c double").collect()
    assert [tuple(r) for r in got] == [("x", 1, None), ("y", None, None)]
