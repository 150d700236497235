"""What a step costs must not outgrow its table."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import linear, models, split
from tests.test_queries import plan_of


@pytest.mark.parametrize("size", [0.0, 0.2, 0.333, 1.0])
def test_parts_of_a_stratified_split_are_those_of_the_positions(spark, size):
    # Keys repeat and are null, so a cut falls between rows of one hash.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 11 > 0, F.col("id") % 100).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("c")
    )
    marked = split.mark_stratified(rows, "c", ["k"], size)
    train, test = split.stratified_split(rows, "c", ["k"], size)
    assert train.columns == test.columns == rows.columns
    for part, wanted in ((train, ~F.col("is_test")), (test, F.col("is_test"))):
        assert sorted(map(str, part.collect())) == sorted(map(str, marked.where(wanted).drop("is_test").collect()))


def test_a_stratified_split_shuffles_no_table(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    for part in split.stratified_split(rows, "c", ["k"]):
        assert "Exchange hashpartitioning" not in plan_of(part) and "SortMergeJoin" not in plan_of(part)


def test_partitions_of_a_fixed_order_are_bounded(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    ordered = models.stable_order(rows, ["k"], partition_rows=2)
    assert ordered.rdd.getNumPartitions() == models.MOST_PARTITIONS and ordered.count() == 1000
    assert models.stable_order(rows, ["k"], partition_rows=500).rdd.getNumPartitions() == 2


def test_fits_of_a_small_table_run_side_by_side(spark, monkeypatch):
    rows = spark.range(10)
    meet = threading.Barrier(3, timeout=20)

    def run(i):
        meet.wait()
        return i * i

    assert models.side_by_side(rows, run, range(3)) == [0, 1, 4]
    monkeypatch.setattr(models, "SIDE_ROWS", 9)
    assert models.side_by_side(rows, lambda i: threading.current_thread().name, range(2)) == [threading.current_thread().name] * 2


def test_robust_rows_are_spread_and_sums_agree(spark, monkeypatch):
    rows = spark.range(0, 300, 1, 1).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 23).cast("double").alias("y"))
    plain = linear.robust_lm(rows, ["a", "b"], "y", constant=False)
    monkeypatch.setattr(linear, "PASS_ROWS", 100)
    assert linear._spread(rows).rdd.getNumPartitions() == 3
    monkeypatch.setattr(linear, "PLAIN_PRODUCTS", 0)
    summed = linear.robust_lm(rows, ["a", "b"], "y", constant=False)
    assert summed.estimates == pytest.approx(plain.estimates, rel=1e-9) and summed.iterations == plain.iterations
