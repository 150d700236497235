"""Registered queries: classifiers, regressors, tuning, importances, scoring.

Grids and ensembles are small here on purpose: the size of a search is the user's choice.
All of them read the whole table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import cut_bins, hash_uniform
from cohortlens.operators import importance, metrics, models, neighbors, split, tuning
from cohortlens.operators.clean import sample_n
from cohortlens.operators.features import Preprocessor, feature_names
from cohortlens.operators.foldstats import LinearCandidate, Penalty
from cohortlens.operators.kernels import PairwiseProbability, TubeRegression
from cohortlens.plans import flows
from cohortlens.plans.standins import U, R, flat, query, round_all, table
from cohortlens.sources.visits import inline_records

NUMERIC = ["qty", "price", "discount", "tax"]
CATEGORICAL = ["flag", "status"]
KEY = ["key"]


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table with missing values and both pain groupings."""
    df = flat(spark, sf)
    return df.withColumns(
        {
            "tax": F.when(hash_uniform("key", "x") >= 0.1, F.col("tax")),
            "flag": F.when(hash_uniform("key", "f") >= 0.1, F.col("flag")),
            "pain_class": cut_bins("rating", flows.TWO_GROUP_EDGES, flows.TWO_GROUP_LABELS),
            "pain_group": cut_bins("rating", flows.FIVE_GROUP_EDGES, flows.FIVE_GROUP_LABELS),
        }
    )


def _prep() -> Preprocessor:
    return Preprocessor(NUMERIC, CATEGORICAL)


def _fit(spark: SparkSession, sf: str, target: str, estimator, **kw) -> flows.ClassifierRun:
    df = messy(spark, sf).select(*KEY, *NUMERIC, *CATEGORICAL, target)
    return flows.tuned_classifier(df, target, KEY, estimator, _prep(), **kw)


def _summary(run: flows.ClassifierRun, target: str) -> DataFrame:
    return metrics.accuracy_metrics(run.scored(), target, "predicted")


def _regression(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with a feature vector and a numeric label, in a fixed order."""
    df = messy(spark, sf).withColumn("label", F.col("y"))
    train, test = split.train_test_split(df, "key")
    prep = _prep().fit(train)
    keep = ["key", "label", "features"]
    return models.stable_order(prep.transform(train).select(*keep), KEY), prep.transform(test).select(*keep)


def _scored(estimator, spark: SparkSession, sf: str) -> DataFrame:
    train, test = _regression(spark, sf)
    scored = models.fit_cached(estimator, train).transform(test)
    return metrics.regression_metrics(scored, "label", "prediction", n_features=9)


@query("logistic")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_fit(spark, sf, "pain_class", models.logistic(1.0)), "pain_class")


@query("logistic_balanced_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    est = models.logistic(1.0, "l1", "class_weight", one_vs_rest=True)
    run = _fit(spark, sf, "pain_group", est, weight_col="class_weight")
    return _summary(run, "pain_group")


@query("svm_linear")
def _(spark: SparkSession, sf: str) -> DataFrame:
    est = models.svm_linear(1.0, "class_weight")
    grid = [{est.C: c} for c in (0.1, 1.0, 10.0, 50.0)]
    run = _fit(spark, sf, "pain_group", est, grid=grid, fold_rule="capped3", weight_col="class_weight")
    return _summary(run, "pain_group")


@query("svm_rbf")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_fit(spark, sf, "pain_class", models.svm_rbf()), "pain_class")


@query("svm_poly")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_fit(spark, sf, "pain_class", models.svm_poly(2)), "pain_class")


@query("svm_grid")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Kernel, width, degree and strength chosen by stratified folds; gamma follows each fold."""
    est = models.KernelSvm(components=50)
    grid = [
        {est.kernel: "linear", est.C: 1.0},
        {est.kernel: "rbf", est.gamma: "scale", est.C: 1.0},
        {est.kernel: "poly", est.gamma: "scale", est.degree: 2, est.C: 0.1},
    ]
    run = _fit(spark, sf, "pain_class", est, grid=grid, fold_rule="capped3")
    return _summary(run, "pain_class").withColumn("kernel", F.lit(run.params["kernel"]))


@query("svm_probability")
def _(spark: SparkSession, sf: str) -> DataFrame:
    est = models.svm_linear(1.0, one_vs_rest=False)
    run = _fit(spark, sf, "pain_class", est)
    folded = split.stratified_kfold(run.train, "label", KEY, 3)
    curves = models.platt_out_of_fold(folded, est, 3, prep=_prep())
    scored = run.model.transform(run.test).withColumn("p", curves.probability()[1])
    return metrics.roc_auc(scored, "label", "p")


@query("svm_probability_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Five calibrated classes: mean probability and frequency of each on the test rows."""
    est = models.svm_linear(1.0)
    run = _fit(spark, sf, "pain_group", est)
    folded = split.stratified_kfold(run.train, "label", KEY, 3)
    curves = models.platt_out_of_fold(folded, est, 3, len(run.classes), prep=_prep())
    scored = run.model.transform(run.test).withColumn("p", curves.probability())
    means = [F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(len(run.classes))]
    shares = [F.avg((F.col("label") == i).cast("double")).alias(f"share{i}") for i in range(len(run.classes))]
    return scored.agg(*means, *shares)


@query("svm_pairwise_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes by one-against-one machines with coupled probabilities: mean probability and frequency of each on the test rows."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"), F.length("p_name").alias("name_length"),
        F.col("p_size").cast("double").alias("size"), F.least(F.lit(2), F.floor(F.col("p_size") / 17)).cast("double").alias("label"),
    )
    names = ["price", "name_length", "size"]
    train, test = split.stratified_split(rows, "label", ["key"])
    prep = Preprocessor(names).fit(train)
    folded = split.stratified_kfold(prep.transform(train).select("key", "label", "features"), "label", ["key"], 3)
    model = PairwiseProbability(lambda: models.svm_linear(1.0, one_vs_rest=False, max_iter=30), 3).fit(folded)
    scored = model.transform(prep.transform(test)).withColumn("p", vector_to_array("probability"))
    means = [F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)]
    shares = [F.avg((F.col("label") == i).cast("double")).alias(f"share{i}") for i in range(3)]
    return scored.agg(*means, *shares, F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


@query("svr_linear")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(TubeRegression("linear", epsilon=0.5), spark, sf)


@query("svr_rbf")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(TubeRegression("rbf", epsilon=0.5, gamma=0.1, components=50), spark, sf)


@query("random_forest_reg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(models.random_forest_reg(20, 4), spark, sf)


@query("random_forest_clf")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_fit(spark, sf, "pain_class", models.random_forest_clf(20, 4, min_split=5)), "pain_class")


@query("out_of_fold_r2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _regression(spark, sf)
    folded = train.withColumn("fold", split.kfold("key", 3))
    r2 = tuning.out_of_fold_r2(folded, models.random_forest_reg(10, 4), 3)
    return spark.createDataFrame([(float(r2),)], "r2 double")


@query("gbt_clf")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_fit(spark, sf, "pain_class", models.gbt_clf(8, 0.1, 4, 0.8, 3)), "pain_class")


@query("gbt_clf_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    est = models.gbt_clf(3, 0.3, 3, 0.8, 3, one_vs_rest=True)
    return _summary(_fit(spark, sf, "pain_group", est), "pain_group")


@query("gbt_reg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(models.gbt_reg(10, 0.2, 3), spark, sf)


@query("gbt_early_stop")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _regression(spark, sf)
    flagged = train.withColumn("held", split.is_test("key", 0.2, 123))
    est = models.gbt_reg(
        15, 0.2, models.depth_for_leaves(8), 0.8, 0.8, validation_col="held", validation_tol=0.01
    )
    model = models.fit_cached(est, flagged)
    scored = metrics.regression_metrics(model.transform(test), "label", "prediction")
    return scored.withColumn("trees", F.lit(model.getNumTrees))


@query("predict_proba")
def _(spark: SparkSession, sf: str) -> DataFrame:
    run = _fit(spark, sf, "pain_group", models.logistic(1.0, one_vs_rest=True))
    return run.scored().select("key", "pain_group", "predicted", "probabilities")


@query("score_new_rows")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = messy(spark, sf)
    run = _fit(spark, sf, "pain_group", models.logistic(1.0, one_vs_rest=True))
    columns = [*NUMERIC, *CATEGORICAL]
    schema = df.select("key", *columns).schema
    records = [{"key": "new-1", "qty": 45, "discount": 0.09, "flag": "A"}, {"key": "new-2", "qty": 2.0, "status": "?"}]
    fresh = inline_records(spark, [{k: float(v) if k in NUMERIC else v for k, v in r.items()} for r in records], schema)
    rows = sample_n(df.select("key", *columns), "key", 50).unionByName(fresh)
    return flows.score_new_rows(rows, run, columns, ["key"])


@query("tuned_classifier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = models.logistic()
    grid = ParamGridBuilder().addGrid(base.C, [0.01, 1.0]).build()
    run = _fit(spark, sf, "pain_class", base, grid=grid, evaluator=tuning.RocAuc(), fold_rule="capped3", test_size=0.25)
    return metrics.classification_report(run.scored(), flows.TWO_GROUP_LABELS, "pain_class", "predicted")


@query("grid_search")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _regression(spark, sf)
    base = models.random_forest_reg(5, 3)
    grid = ParamGridBuilder().addGrid(base.maxDepth, [2, 4]).build()
    folded = train.withColumn("fold", split.kfold("key", 2))
    _, _, scores, _ = tuning.grid_search(folded, base, grid, tuning.RegressionScore("mape"), 2)
    return tuning.params_table(spark, grid, scores)


@query("cv_scores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _regression(spark, sf)
    folded = train.withColumn("fold", split.kfold("key", 2))
    candidates = {
        "linear": LinearCandidate(),
        "ridge": LinearCandidate(penalty=Penalty(total=1.0)),
        "lasso": LinearCandidate(penalty=Penalty.elastic(1.0, 1.0)),
        "svr_linear": models.svr("linear"),
        "random_forest": models.random_forest_reg(5, 4),
        "gbt": models.gbt_reg(5, 0.3, 3),
    }
    return tuning.cv_scores(folded, candidates, 2)


def _board(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    train, test = _regression(spark, sf)
    forest, boost = models.random_forest_reg(5, 4), models.gbt_reg(5, 0.3, 3)
    return tuning.tuned_leaderboard(
        train.withColumn("fold", split.kfold("key", 2)),
        test,
        {
            "random_forest": (forest, ParamGridBuilder().addGrid(forest.maxDepth, [3, 5]).build()),
            "gbt": (boost, ParamGridBuilder().addGrid(boost.stepSize, [0.3]).build()),
        },
        2,
    )


@query("tuned_leaderboard")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _board(spark, sf)[0].drop("params", "seconds")


@query("best_model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.best_model(_board(spark, sf)[0].drop("params", "seconds"))


@query("importances_tree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _regression(spark, sf)
    model = models.fit_cached(models.random_forest_reg(20, 4), train)
    return importance.importance_table(spark, model, feature_names(train), 15)


@query("importances_linear")
def _(spark: SparkSession, sf: str) -> DataFrame:
    run = _fit(spark, sf, "pain_group", models.logistic(1.0, one_vs_rest=True))
    names = feature_names(run.model.transform(run.test))
    return importance.importance_table(spark, run.model.stages[-1], names, 15)


def _two_stage(spark: SparkSession, sf: str) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """The refitted model, and the training and test rows that it scored."""
    train, test = _regression(spark, sf)
    model, _ = importance.importance_select_refit(train, models.random_forest_reg(10, 4), 4)
    return model, {"train": model.transform(train), "test": model.transform(test)}


def _compared(scored: DataFrame) -> DataFrame:
    return scored.select("key", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


@query("importance_select_refit")
def _(spark: SparkSession, sf: str) -> DataFrame:
    model, scored = _two_stage(spark, sf)
    return importance.importance_table(spark, model, feature_names(scored["test"], "features_top"))


@query("evaluate_dataset")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The report on the training rows and on the test rows."""
    _, scored = _two_stage(spark, sf)
    train, test = (
        importance.evaluate_dataset(_compared(rows), "key", n_features=4)[0].withColumn("dataset", F.lit(name)) for name, rows in scored.items()
    )
    return train.unionByName(test)


@query("actual_vs_predicted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return importance.actual_vs_predicted(_compared(_two_stage(spark, sf)[1]["test"]), ["key"])


@query(
    "knn_cv",
    f"WITH f AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, CAST(floor({U('vec_id', 42)} * 3) AS INT) AS fold FROM embeddings), near AS "
    "(SELECT q.vec_id, q.label AS actual, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, r.e), 6), r.vec_id) "
    "AS rk FROM f q JOIN f r ON q.fold <> r.fold), votes AS (SELECT k, vec_id, actual, label, count(*) AS v FROM near, (VALUES (3), (7)) t(k) "
    "WHERE rk <= k GROUP BY ALL), pred AS (SELECT k, vec_id, actual, arg_min(label, (-v, label)) AS p FROM votes GROUP BY ALL), recall AS "
    "(SELECT k, actual, count(*) AS n, sum((p = actual)::INT) AS hit FROM pred GROUP BY ALL) SELECT k, sum(n)::BIGINT AS n, "
    f"{R('sum(hit)::DOUBLE / sum(n)')} AS accuracy, {R('avg(hit::DOUBLE / n)')} AS balanced_accuracy FROM recall GROUP BY k",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-neighbour grid: balanced accuracy per neighbour count on the embeddings."""
    folded = table(spark, sf, "embeddings").withColumn("fold", split.kfold("vec_id", 3))
    scored = None
    for fold in range(3):
        held, rest = folded.where(F.col("fold") == fold), folded.where(F.col("fold") != fold)
        # One search serves both neighbour counts.
        near = neighbors.knn_join(held, rest, 7, "vec_id", "vec_id", "embedding", "label")
        for k in (3, 7):
            votes = neighbors.vote(near.where(F.col("rank") <= k), "vec_id", "label")
            part = votes.join(held.select("vec_id", "label"), "vec_id").withColumn("k", F.lit(k))
            scored = part if scored is None else scored.unionByName(part)
    return round_all(metrics.accuracy_metrics(scored, "label", "predicted", by=["k"]))


@query("classifier_board")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Several tuned classifiers on one split, one row each."""
    df = messy(spark, sf).withColumn("label", (F.col("rating") > 6).cast("double"))
    train, test = split.stratified_split(df, "label", KEY)
    prep = _prep().fit(train)
    keep = ["key", "label", "features"]
    folded = split.stratified_kfold(prep.transform(train).select(*keep), "label", KEY, 2)
    ordered = models.stable_order(folded, KEY)
    logit, svm = models.logistic(), models.KernelSvm(components=50)
    forest, boost = models.random_forest_clf(10, 4), models.gbt_clf(5, 0.2, 3)
    candidates = {
        "logistic": (logit, [{logit.C: c} for c in (0.01, 1.0)]),
        "svm": (svm, [*({svm.kernel: "linear", svm.C: c} for c in (0.1, 1.0)), {svm.kernel: "rbf"}]),
        "random_forest": (forest, [{forest.maxDepth: d} for d in (2, 4)]),
        "gbt": (boost, []),
    }
    board, _ = tuning.classifier_board(ordered, prep.transform(test).select(*keep), candidates, tuning.BalancedAccuracy(), 2)
    return board.drop("params")


@query("base_cv")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven base regressors over five folds of the parts table."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.length("p_name").alias("name_length"), F.col("p_retailprice").alias("label"))
    names = ["p_partkey", "p_size", "name_length"]
    scaled = Preprocessor(names).fit(rows).transform(rows).withColumn("key", F.col("p_partkey").cast("long"))
    folded = models.stable_order(scaled.select("key", "features", "label").withColumn("fold", split.kfold("key", 5)), KEY)
    boosted = lambda seed, depth: tuning.early_stopped(
        lambda held: models.gbt_reg(10, 0.3, depth, 0.8, seed=seed, validation_col=held)
    )
    candidates = {
        "linear": LinearCandidate(),
        "ridge": LinearCandidate(penalty=Penalty(total=1.0)),
        "lasso": LinearCandidate(penalty=Penalty.elastic(1.0, 1.0)),
        "elastic_net": LinearCandidate(penalty=Penalty.elastic(1.0, 0.5)),
        "knn": neighbors.NearestNeighbours("key", 5, task="regress"),
        "svr_linear": models.svr("linear"),
        "svr_rbf": models.svr("rbf", gamma=0.3),
        "random_forest": models.random_forest_reg(10, 5),
        "gbt": models.gbt_reg(10, 0.3, 3),
        "gbt_early_depth": boosted(42, 3),
        "gbt_early_leaves": boosted(42, models.depth_for_leaves(31)),
    }
    return tuning.cv_scores(folded, candidates, 5)
