import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from cohortlens.functions.columns import hash_uniform
from cohortlens.operators import importance, metrics, models, neighbors, split, tuning
from cohortlens.operators.features import Preprocessor, feature_names
from cohortlens.plans import flows
from cohortlens.sources.visits import inline_records


@pytest.fixture(scope="module")
def cohort(spark):
    """600 visits; the rating follows ``a``, weakly ``g``; ``noise`` is noise."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        a, g = rng.random(), rng.choice(["M", "F", None])
        rating = min(10, int(9 * a + (1.5 if g == "F" else 0)))
        rows.append((i, f"T{2 * (i % 2)}", a if i % 17 else None, rng.random(), g, str(rating) if i % 23 else "n/a"))
    return spark.createDataFrame(
        rows, "subject_id int, timepoint string, a double, noise double, g string, rating string"
    ).cache()


@pytest.fixture(scope="module")
def groups(cohort):
    return flows.label_ratings(cohort, "rating", flows.TWO_GROUP_EDGES, flows.TWO_GROUP_LABELS).cache()


PREP = dict(numeric=["a", "noise"], categorical=["g"])
LOW, HIGH = flows.TWO_GROUP_LABELS


@pytest.fixture(scope="module")
def run(groups):
    base = models.logistic(10.0)
    grid = ParamGridBuilder().addGrid(base.C, [2.0, 1e-4]).build()
    return flows.tuned_classifier(
        groups, "group", ["subject_id"], base, Preprocessor(**PREP), grid, tuning.RocAuc(), 0.25, "capped3"
    )


def test_unrated_rows_are_removed(cohort, groups):
    assert groups.count() == cohort.where("rating <> 'n/a'").count()


def test_tuned_classifier_recovers_the_signal(run):
    assert run.classes == (HIGH, LOW) and run.params == {"C": 2.0}
    scored = run.scored()
    acc = metrics.accuracy_metrics(scored, "group", "predicted").first()
    assert acc.balanced_accuracy > 0.85
    out = flows.classification_outcome(scored, "group", flows.TWO_GROUP_LABELS)
    assert out["confusion"].agg(F.sum("n")).first()[0] == run.test.count()
    assert out["report"].count() == 5


def test_positive_class_of_two(run):
    # Alphabetical codes: "High ..." is 0, so index 1 is the probability of not high.
    p = tuning.RocAuc(positive=1).evaluate(run.model.transform(run.test))
    assert p > 0.9
    assert tuning.RocAuc(positive=0).evaluate(run.model.transform(run.test)) == pytest.approx(p)


def test_shuffled_labels_give_no_signal(groups):
    mixed = groups.withColumn("group", F.when(hash_uniform("subject_id", "z") < 0.5, LOW).otherwise(HIGH))
    r = flows.tuned_classifier(mixed, "group", ["subject_id"], models.logistic(1.0), Preprocessor(**PREP))
    assert abs(tuning.RocAuc().evaluate(r.model.transform(r.test)) - 0.5) < 0.2


def test_new_rows_are_scored_whatever_their_shape(spark, run):
    schema = run.train.select("a", "noise", "g").schema
    rows = inline_records(spark, [{"a": 0.95, "g": "unseen"}, {"noise": 0.1}], schema)
    rows = rows.withColumn("ref", F.concat(F.lit("r"), F.monotonically_increasing_id())).withColumn("x", F.lit(1))
    got = flows.score_new_rows(rows, run, ["a", "noise", "g"], ["ref"]).collect()
    assert len(got) == 2 and got[0].predicted == HIGH
    assert got[0].probabilities.startswith(f"{HIGH}=") and got[0].probabilities.endswith("%")


def test_streamed_rows_are_scored(spark, run, tmp_path):
    run.test.select("subject_id", "a", "g").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject_id int, a double, g string").parquet(str(tmp_path / "in"))
    scored = flows.score_new_rows(stream, run, ["a", "noise", "g"], ["subject_id"])
    q = (
        scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == run.test.count()


def test_five_groups_one_against_the_rest(cohort):
    df = flows.label_ratings(cohort, "rating")
    for est in (
        models.logistic(1.0, "l2", "w", one_vs_rest=True),
        models.svm_linear(1.0, "w", max_iter=10),
        models.gbt_clf(3, 0.3, 3, one_vs_rest=True),
    ):
        r = flows.tuned_classifier(df, "group", ["subject_id"], est, Preprocessor(**PREP), weight_col="w")
        scored = r.scored()
        assert metrics.accuracy_metrics(scored, "group", "predicted").first().balanced_accuracy > 0.4
        total = scored.select(F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)).first()[0]
        assert total == pytest.approx(1.0)
        names = feature_names(r.model.transform(r.test))
        top = importance.importance_table(r.train.sparkSession, r.model.stages[-1], names)
        assert top.first().feature == "a"


@pytest.fixture(scope="module")
def vectors(cohort):
    df = cohort.dropna(subset=["a"]).withColumn("label", F.col("a") * 5 + F.col("noise") * 0.2 + 1)
    prep = Preprocessor(["a", "noise"], ["g"]).fit(df)
    return models.stable_order(prep.transform(df).select("subject_id", "label", "features"), ["subject_id"]).cache()


def test_boosting_improves_with_trees(vectors):
    def rmse(trees):
        m = models.gbt_reg(trees, 0.3, 3).fit(vectors)
        return metrics.regression_metrics(m.transform(vectors), "label", "prediction").first().rmse

    assert rmse(12) < rmse(2)


def test_forest_is_repeatable_and_ranks_the_signal_first(spark, vectors):
    est = models.random_forest_reg(8, 4)
    a, b = est.fit(vectors), est.fit(vectors)
    assert a.featureImportances == b.featureImportances
    assert importance.importance_table(spark, a, feature_names(vectors)).first().feature == "a"


def test_two_stage_refit(vectors):
    model, ranking = importance.importance_select_refit(vectors, models.random_forest_reg(8, 4), 2)
    scored = model.transform(vectors)
    assert feature_names(scored, "features_top") == [r.feature for r in ranking.limit(2).collect()]
    report, rows = importance.evaluate_dataset(
        scored.select("subject_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted")),
        "subject_id",
    )
    r, first = report.first(), rows.first()
    assert r.r2 > 0.9 and first.subject_id == r.worst_key and first.abs_error == r.max_abs_error


def test_early_stop_keeps_fewer_trees(vectors):
    flagged = vectors.withColumn("held", split.is_test("subject_id", 0.3, 123))
    m = models.gbt_reg(40, 0.5, 4, 0.8, 0.9, validation_col="held", validation_tol=0.05).fit(flagged)
    assert m.getNumTrees < 40


def test_out_of_fold(vectors):
    folded = vectors.withColumn("fold", split.kfold("subject_id", 3))
    assert tuning.out_of_fold_r2(folded, models.random_forest_reg(5, 4), 3) > 0.8


def test_leaderboard_and_cv(spark, vectors):
    folded = vectors.withColumn("fold", split.kfold("subject_id", 2))
    forest = models.random_forest_reg(4, 2)
    boost = models.gbt_reg(4, 0.5, 3)
    board, fitted = tuning.tuned_leaderboard(
        folded, vectors,
        {
            "forest": (forest, ParamGridBuilder().addGrid(forest.maxDepth, [1, 5]).build()),
            "boost": (boost, []),
        },
        2,
    )
    rows = board.collect()
    assert [r.mape for r in rows] == sorted(r.mape for r in rows) and set(fitted) == {"forest", "boost"}
    assert {r.model: r.params for r in rows}["forest"] == {"maxDepth": "5"}
    assert tuning.best_model(board).first().model == rows[0].model
    assert tuning.best_model(spark.createDataFrame([("x", math.nan)], "model string, mape double")).count() == 0
    cv = tuning.cv_scores(folded, {"forest": forest, "boost": boost}, 2)
    assert cv.count() == 2 and cv.first().r2 is not None


def test_failing_grid_points_are_skipped(vectors):
    folded = vectors.withColumn("fold", split.kfold("subject_id", 2))
    est = models.random_forest_reg(2, 2)
    grid = [{est.maxBins: 2}, {est.labelCol: "absent"}]
    _, params, scores, why = tuning.grid_search(folded, est, grid, tuning.RegressionScore("r2"), 2)
    assert params == {"maxBins": 2} and math.isnan(scores[1]) and "absent" in why[1]


def test_small_classes_fall_back_to_a_plain_fit(groups):
    base = models.logistic(1.0)
    enc = Preprocessor(**PREP)
    labelled = groups.withColumn("label", (F.col("group") == HIGH).cast("double"))
    _, params = tuning.fit_or_fallback(labelled, base, [{base.C: 5.0}], tuning.BalancedAccuracy(), 5, 3, prep=enc)
    assert params == {}


def test_random_features_approximate_the_kernel(spark):
    x = [[0.1, 0.5], [0.4, -0.2], [1.0, 1.0]]
    df = spark.createDataFrame([(Vectors.dense(v),) for v in x], ["features"])
    z = [r.kernel_features.toArray() for r in models.RandomFourierFeatures(gamma=0.7, components=4000).transform(df).collect()]
    for i in range(3):
        for j in range(3):
            want = math.exp(-0.7 * sum((a - b) ** 2 for a, b in zip(x[i], x[j])))
            assert z[i] @ z[j] == pytest.approx(want, abs=0.06)


def test_kernel_width_rules(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.dense([3.0, 6.0]),)], ["features"])
    assert models.kernel_gamma(df, rule="auto") == 0.5
    assert models.kernel_gamma(df) == pytest.approx(1 / (2 * 3.5))


@pytest.mark.parametrize("make", [
    lambda: models.svm_rbf(1.0, 1.0, 40, max_iter=30),
    lambda: models.svm_poly(2, 1.0, max_iter=30),
])
def test_kernel_svm_separates_a_ring(spark, make):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a, b = rng.uniform(-2, 2), rng.uniform(-2, 2)
        rows.append((a, b, float(a * a + b * b < 1.5)))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, b double, label double")
    )
    m = make().fit(df)
    assert tuning.BalancedAccuracy().evaluate(m.transform(df)) > 0.85


def test_svm_margins_become_probabilities(vectors):
    df = vectors.withColumn("label", (F.col("label") > 3.5).cast("double"))
    est = models.svm_linear(1.0, one_vs_rest=False)
    curves = models.platt_out_of_fold(df.withColumn("fold", split.kfold("subject_id", 3)), est, 3)
    p = est.fit(df).transform(df).select("label", curves.probability()[1].alias("p"))
    assert p.where("p < 0 OR p > 1").count() == 0
    assert metrics.roc_auc(p, "label", "p", 1.0).first().roc_auc > 0.95


def test_svr(vectors):
    for est in (models.svr("linear", c=100.0), models.svr("rbf", gamma=0.2, c=100.0, components=60)):
        m = est.fit(vectors)
        assert metrics.regression_metrics(m.transform(vectors), "label", "prediction").first().r2 > 0.8
    assert models.depth_for_leaves(31) == 5


def test_checkpoint_folder_is_set_once(spark):
    from cohortlens.session import ensure_checkpoint_dir

    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first


def test_change_regression(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        a0, b0 = rng.random(), rng.random()
        a2, b2 = rng.random(), rng.random()
        rows.append((i, "T0", a0, b0, 5.0))
        rows.append((i, "T2", a2, b2, 5.0 + 3 * (a2 - a0) - (b2 - b0) + rng.gauss(0, 0.05)))
    df = spark.createDataFrame(rows, "subject_id int, timepoint string, a double, b double, pain double")
    out = flows.change_regression(df, ["a", "b"], "pain")
    scores = {r.model: r.r2 for r in out["metrics"].collect()}
    assert set(scores) == {"robust", "least squares"} and min(scores.values()) > 0.98
    terms = {r.term: r.coef for r in out["coefficients"].collect()}
    assert terms["a_Change"] == pytest.approx(3, abs=0.1) and terms["b_Change"] == pytest.approx(-1, abs=0.1)
    assert out["within"].first().pct_within == 100.0 and out["error_corr"].count() == 2
    with pytest.raises(ValueError):
        flows.change_regression(df.where("subject_id < 5"), ["a"], "pain")


def test_threshold_regression_without_signal(spark):
    df = spark.range(300).withColumn("x", hash_uniform("id", 1)).withColumn("y", hash_uniform("id", 2))
    with pytest.raises(ValueError):
        flows.threshold_regression(df, ["x"], "y", "id", threshold=0.5)


def test_strength_does_not_depend_on_the_number_of_rows(vectors):
    df = vectors.withColumn("label", (F.col("label") > 3.5).cast("double"))
    once = models.logistic(1.0, tol=1e-10).fit(df)
    twice = models.logistic(0.5, tol=1e-10).fit(df.unionByName(df))
    assert once.coefficients.toArray() == pytest.approx(twice.coefficients.toArray(), rel=1e-4)


def test_calibrated_classes_sum_to_one(vectors):
    df = vectors.withColumn("label", F.floor(F.pmod("label", F.lit(3))).cast("double")).withColumn("fold", split.kfold("subject_id", 2))
    est = models.svm_linear(1.0, max_iter=20)
    curves = models.platt_out_of_fold(df, est, 2, 3)
    p = est.fit(df).transform(df).select(F.aggregate(curves.probability(), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in p.collect())


def test_neighbours_are_a_tunable_model(vectors):
    from cohortlens.operators.neighbors import NearestNeighbours

    folded = vectors.withColumn("fold", split.kfold("subject_id", 2))
    knn = NearestNeighbours("subject_id", task="regress")
    grid = [{knn.k: k, knn.metric: m} for k in (1, 5) for m in ("euclidean", "manhattan")]
    model, params, scores, _ = tuning.grid_search(folded, knn, grid, tuning.RegressionScore("rmse"), 2)
    assert params["k"] in (1, 5) and len(scores) == 4 and not any(map(math.isnan, scores))
    one = tuning.RegressionScore("rmse").evaluate(knn.copy(grid[0]).fit(folded.where("fold = 1")).transform(folded.where("fold = 0")))
    two = tuning.RegressionScore("rmse").evaluate(knn.copy(grid[0]).fit(folded.where("fold = 0")).transform(folded.where("fold = 1")))
    assert scores[0] == pytest.approx((one + two) / 2)
    assert model.transform(vectors).where("prediction IS NULL").count() == 0


def test_five_class_probabilities_are_registered(spark, sf):
    from cohortlens.plans import registry

    row = registry.QUERIES["svm_probability_groups"](spark, sf).first().asDict()
    assert set(row) == {f"{kind}{i}" for kind in ("p", "share") for i in range(5)}
    assert sum(row[f"p{i}"] for i in range(5)) == pytest.approx(1)


def test_classifier_board_compares_kernels(spark, sf, monkeypatch):
    from cohortlens.plans import registry
    from cohortlens.plans.queries_models import tuning

    seen = {}

    def board(train, test, candidates, *rest):
        seen.update(candidates)
        return train.limit(0).withColumn("params", train["key"]), None

    monkeypatch.setattr(tuning, "classifier_board", board)
    registry.QUERIES["classifier_board"](spark, sf)
    svm, grid = seen["svm"]
    assert {point.get(svm.kernel) for point in grid} == {"linear", "rbf"}
    assert {point[svm.C] for point in grid if svm.C in point} == {0.1, 1.0}


def node_rows(forest):
    """Rows of every node that is split, and the number of leaves."""
    found, leaves = [], 0
    waiting = [t.rootNode() for t in forest._java_obj.trees()]
    while waiting:
        node = waiting.pop()
        if node.subtreeDepth() == 0:
            leaves += 1
        else:
            found.append(node.impurityStats().rawCount())
            waiting += [node.leftChild(), node.rightChild()]
    return found, leaves


def test_small_nodes_of_a_forest_are_not_split(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random()) for _ in range(80)]
    df = spark.createDataFrame([(a, b, float(rng.random() < a)) for a, b in rows], "a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
    whole, cut = models.random_forest_clf(3, 8).fit(df), models.random_forest_clf(3, 8, min_split=12).fit(df)
    (before, many), (after, few) = node_rows(whole), node_rows(cut)
    assert min(before) < 12 and sorted(after) == sorted(n for n in before if n >= 12) and few < many
    assert cut.transform(df).where("prediction = label").count() > 50 and cut.getNumTrees == 3
    est = models.random_forest_clf(3, 8)
    assert len(node_rows(est.fit(df, {est.minSplit: 12}))[0]) == len(after)


def test_all_strengths_of_a_grid_are_scored(vectors):
    df = vectors.withColumns({"label": (F.col("label") > 3.5).cast("double"), "fold": split.kfold("subject_id", 2)})
    est = models.svm_linear(1.0, one_vs_rest=False, max_iter=20)
    grid = [{est.C: 1e-4}, {est.C: 1.0}]
    _, params, scores, _ = tuning.grid_search(df, est, grid, tuning.BalancedAccuracy(), 2)
    assert params == {"C": 1.0} and scores[1] > 0.9 > scores[0]


def test_queries_run_the_whole_method(spark, sf, monkeypatch):
    from cohortlens.plans.registry import QUERIES

    report = {r.dataset: r for r in QUERIES["evaluate_dataset"](spark, sf).collect()}
    assert set(report) == {"train", "test"} and report["train"].n > 3 * report["test"].n
    asked = []

    def fit(df, target, key, estimator, prep, **kw):
        asked.append((estimator, kw))
        raise StopIteration

    monkeypatch.setattr(flows, "tuned_classifier", fit)
    for name in ("svm_linear", "random_forest_clf"):
        with pytest.raises(StopIteration):
            QUERIES[name](spark, sf)
    (_, linear), (forest, _) = asked
    assert [list(m.values()) for m in linear["grid"]] == [[0.1], [1.0], [10.0], [50.0]] and linear["fold_rule"] == "capped3"
    assert forest.getOrDefault("minSplit") == 5


def test_copies_for_a_search_hold_no_keys_or_class_names(groups, monkeypatch):
    seen = []

    def searched(rows, *a, **kw):
        seen.append(set(rows.columns))
        raise StopIteration

    monkeypatch.setattr(flows, "fit_or_fallback", searched)
    base = models.logistic()
    for est in (base, neighbors.NearestNeighbours("subject_id", label="label")):
        with pytest.raises(StopIteration):
            flows.tuned_classifier(groups, "group", ["subject_id"], est, Preprocessor(**PREP), [{base.C: 1.0}])
    plain, keyed = seen
    assert not {"group", "subject_id"} & plain and {"label", "fold", "a"} <= plain and "subject_id" in keyed and "group" not in keyed
