"""What is read, cached and shuffled follows the rows: steps run once, caches are narrow, no class is put in one task."""

import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import descent, importance, models, neighbors, split, tuning
from cohortlens.operators.features import Preprocessor
from cohortlens.operators.foldstats import LinearCandidate
from tests.test_queries import plan_of

ROWS = 240


@pytest.fixture
def counted(spark):
    """Rows behind a step that counts those it handles, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    base = spark.range(ROWS, numPartitions=2).select(
        F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")
    )
    passed = base.mapInPandas(count, base.schema)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(passed)
    rows = rows.withColumns({"fold": (F.col("key") % 2).cast("int"), "label": F.col("a") * 2 + F.col("b") + 1})
    return rows, seen


def search(rows):
    est = models.random_forest_reg(2, 2)
    tuning.grid_search(rows, est, [{est.maxDepth: d} for d in (1, 2)], tuning.RegressionScore("rmse"), 2)


def scores(rows):
    tuning.cv_scores(rows, {"linear": LinearCandidate(), "forest": models.random_forest_reg(2, 2)}, 2).collect()


def board(rows):
    est = models.random_forest_clf(2, 2)
    two = rows.withColumn("label", (F.col("label") > 8).cast("double"))
    tuning.classifier_board(two, two.limit(40), {"forest": (est, []), "logistic": (models.logistic(max_iter=5), [])}, tuning.BalancedAccuracy(), 2)


def leaders(rows):
    est = models.random_forest_reg(2, 2)
    tuning.tuned_leaderboard(rows, rows, {"forest": (est, [])}, 2)


def selected(rows):
    importance.importance_select_refit(rows, models.random_forest_reg(2, 2), 1)


@pytest.mark.parametrize("run", [search, scores, board, leaders, selected])
def test_what_leads_to_the_rows_runs_once(counted, run):
    rows, seen = counted
    run(rows)
    # A board's test rows are a table of their own.
    assert seen.value <= ROWS * (2 if run in (board, leaders) else 1)
    assert not rows.storageLevel.useMemory


def joins(df) -> list[str]:
    return re.findall(r"\w+Join(?= )", plan_of(df).split("== Initial Plan ==")[0])


def test_no_join_by_class(spark):
    df = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 3).alias("c"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Positions are joined by class and sub-bucket; the class sizes come along.
        assert joins(split.mark_stratified(df, "c", ["key"])) == ["SortMergeJoin"]
        assert joins(split.balanced_weights(df, "c")) == ["BroadcastHashJoin"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_kernel_features_are_not_cached_twice(spark, monkeypatch):
    def never(*_):
        raise AssertionError("the library caches its own blocks")

    monkeypatch.setattr(models, "fit_cached", never)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = [(r.tolist(), float((r @ r) > 1.2)) for r in x]
    df = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    scored = models.svm_rbf(components=20, max_iter=30).fit(df).transform(df)
    assert scored.where("label = prediction").count() > 170


def test_columns_that_led_to_the_vector_are_dropped(spark):
    df = spark.createDataFrame([(i, float(i % 9), "ab"[i % 2], 1.0 * (i % 2)) for i in range(40)], "key long, a double, c string, label double")
    prep = Preprocessor(["a"], ["c"])
    made = prep.fit(df).transform(df)
    left = models.without_inputs(made, prep, models.logistic()).columns
    assert left == ["key", "label", "features"]
    named = models.without_inputs(made, prep, models.logistic(weight_col="a", one_vs_rest=True))
    assert "a" in named.columns
    knn = models.without_inputs(made, Preprocessor(["key", "a"], ["c"]), neighbors.NearestNeighbours("key"))
    assert "key" in knn.columns and "a" not in knn.columns


def test_blocks_hold_all_rows(spark):
    rows = spark.range(25_000, numPartitions=2).select(
        F.array(F.col("id").cast("double"), F.lit(2.0)).alias("x"), (F.col("id") * 3).cast("double").alias("y"), F.lit(0.5).alias("weight")
    )
    packed = descent.blocks(rows)
    assert packed.count() <= 4
    sums = descent.summed(packed, lambda x, y, w: np.concatenate([[len(y)], x.sum(axis=0), [y.sum(), w.sum()]]))
    total = 25_000 * 24_999 / 2
    assert sums.tolist() == [25_000, total, 50_000, 3 * total, 12_500]
    assert descent.summed(descent.blocks(rows.limit(0)), lambda x, y, w: np.zeros(1)) is None
