"""Rows of a key that very many rows share do not go to one task."""

import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import crowds, models, neighbors


def sizes(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_a_fixed_order_spreads_the_rows_of_few_keys(spark):
    rows = spark.range(0, 4000, 1, 4).select(
        (F.col("id") % 3).alias("key"), array_to_vector(F.array((F.col("id") * 0.5))).alias("features"), F.col("id").alias("label")
    )
    ordered = models.stable_order(rows, ["key"], partition_rows=200)
    assert ordered.columns == rows.columns and ordered.rdd.getNumPartitions() == 20
    assert max(sizes(ordered)) < 400 and sum(sizes(ordered)) == 4000
    # The same partitions and order, however the rows arrive.
    again = models.stable_order(rows.orderBy(F.desc("label")), ["key"], partition_rows=200)
    assert [r.label for r in ordered.collect()] == [r.label for r in again.collect()]


def test_a_fixed_order_of_distinct_keys_goes_by_the_key_alone(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("key"))
    ordered = models.stable_order(rows, ["key"], partition_rows=200)
    assert [r.key for r in ordered.collect()] == [r.key for r in rows.repartition(20, "key").sortWithinPartitions("key").collect()]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_crowds_are_those_of_all_rows(spark, how):
    many = spark.range(2000).select(F.when(F.col("id") % 5 > 0, F.least(F.col("id") % 7, F.lit(3))).alias("key"), F.col("id").alias("v"))
    few = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (9, "d"), (None, "e")], "k long, x string")
    found = crowds.crowds(many, "key", 150)
    assert set(found.keys) == {None, 0, 1, 2, 3} and found.copies == 7
    joined = crowds.spread_join(many, few, "key", "k", found, how)
    assert joined.columns == ["key", "v", "x"]
    plain = many.join(few, F.col("key") == F.col("k"), how).drop("k")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_distinct_keys_are_no_crowds(spark):
    assert crowds.crowds(spark.range(20_000), "id", 10).keys == ()


@pytest.mark.parametrize("key_rows", [20, 100_000])
def test_neighbours_of_repeated_keys(spark, monkeypatch, key_rows):
    """The nearest of a key are those of all its rows; a neighbour's payload is that of all rows of its key."""
    monkeypatch.setattr(crowds, "KEY_ROWS", key_rows)
    rng = np.random.default_rng(6)
    vecs, keys, labels = rng.normal(size=(300, 2)), rng.integers(0, 3, 300), rng.normal(size=300)
    df = spark.createDataFrame([(int(k), v.tolist(), float(y)) for k, v, y in zip(keys, vecs, labels)], "key long, features array<double>, label double")
    asked, refs = df.where("key = 2"), df.where("key < 2")
    pairs = itertools.product(vecs[keys == 2], zip(keys[keys < 2], vecs[keys < 2]))
    near = sorted((round(float(np.sqrt(((q - v) ** 2).sum())), 6), k) for q, (k, v) in pairs)[:4]
    wanted = np.concatenate([labels[keys == k] for _, k in near]).mean()
    scored = neighbors.NearestNeighbours("key", 4, task="regress").fit(refs).transform(asked).collect()
    assert len(scored) == (keys == 2).sum() and {round(r.prediction, 9) for r in scored} == {round(float(wanted), 9)}


def test_queries_of_one_key_are_dealt_over_chunks(spark):
    """Neither rows nor queries of a shelf follow their key alone."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(1, v.tolist()) for v in rng.normal(size=(600, 2))], "key long, vec array<double>")
    found = neighbors._search(df, df, 1, "euclidean", 1, 100)
    # Each of at least six chunks of the one cell answers each query.
    assert found.count() > 600 * 3
