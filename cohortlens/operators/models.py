"""Model builders: ``pyspark.ml`` estimators with the parameters cohort models use."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.functions.columns import as_col
from cohortlens.operators.crowds import bucket_rows, content_hash, full_buckets
from cohortlens.operators.descent import blocks, label_extent
from cohortlens.operators.histtrees import features_array
from cohortlens.operators.machines import Features, fit_machines, scaled_products
from cohortlens.operators.nystroem import kernel_gamma, nystroem, rbf
from cohortlens.shipping import ship_package

UNBOUNDED_DEPTH = 30  # the deepest tree the library grows
CLASS_PARALLELISM = 4  # one-vs-rest parts fitted at the same time
PARTITION_ROWS = 50_000  # training rows in one partition of a fixed order
MOST_PARTITIONS = 240  # beyond which partitions grow: a level of a tree shuffles one block from each to each
SOLVER_ROWS = 100_000  # rows in one partition of a solver's input
SIDE_ROWS = 20_000_000  # rows up to which fits run side by side; larger tables fill the cores, and the caches, one by one


def fit_cached(estimator: Estimator, train: DataFrame) -> Model:
    """Fit on a cached copy: the library reads its input once per pass."""
    if train.storageLevel.useMemory or getattr(estimator, "keeps_rows", False):
        return estimator.fit(train)
    cached = train.persist()
    try:
        return estimator.fit(cached)
    finally:
        cached.unpersist()


def side_by_side(df: DataFrame, run: Callable, items: Sequence) -> list:
    """``run`` of each item in order; at the same time where the table is small, as a solver's many short jobs then wait on the driver."""
    if len(items) < 2 or df.count() > SIDE_ROWS:
        return [run(item) for item in items]
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(run), items, chunksize=1)


@contextmanager
def kept(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """The tables, cached within the block unless they are already."""
    new = [not t.storageLevel.useMemory for t in tables]
    cached = [t.persist() if own else t for t, own in zip(tables, new)]
    try:
        yield cached
    finally:
        for t, own in zip(cached, new):
            if own:
                t.unpersist()


def named_columns(value) -> set[str]:
    """All texts that an estimator, with the estimators within it, has for a setting; column names are among them."""
    if isinstance(value, str):
        return {value}
    if isinstance(value, Estimator):
        return named_columns(list(value.extractParamMap().values())) | named_columns([v for k, v in vars(value).items() if not isinstance(v, Param)])
    if isinstance(value, (list, tuple)):
        return set().union(*map(named_columns, value))
    return set()


def without_inputs(df: DataFrame, prep: Estimator, estimator: Estimator) -> DataFrame:
    """Preprocessed rows without the columns that only led to the feature vector, which a cache need not hold.

    A column that a setting of the estimator names stays.
    """
    gone = getattr(prep, "consumed", list)()
    return df.drop(*(set(gone) - named_columns(estimator))) if gone else df


def penalty_of(c: float, weight_sum: float) -> float:
    """Library penalty for an inverse strength ``C``: losses are averaged here, summed there."""
    return 1.0 / (c * weight_sum)


class ByStrength(Estimator):
    """An estimator with an inverse penalty strength ``C``.

    The weight sum that turns it into the library's penalty is taken from the rows of each
    fit, so one ``C`` means the same in every fold and in the refit.
    """

    C = Param(Params._dummy(), "C", "inverse penalty strength", TypeConverters.toFloat)

    def __init__(self, base: Estimator, c: float = 1.0, weight_col: str | None = None) -> None:
        super().__init__()
        self.base, self.weight_col = base, weight_col
        self._set(C=c)

    def _fit(self, dataset: DataFrame) -> Model:
        total = F.sum(as_col(self.weight_col)) if self.weight_col else F.count(F.lit(1))
        rows, weight = dataset.agg(F.count(F.lit(1)), total.cast("double")).first()
        if not weight:
            raise ValueError("no rows with a weight")
        # Every step of the solver is a job; partitions of a few rows would make it all overhead.
        packed = dataset.coalesce(max(1, -(-rows // SOLVER_ROWS)))
        return _with_penalty(self.base, penalty_of(self.getOrDefault(self.C), weight)).fit(packed)


def _with_penalty(estimator: Estimator, penalty: float) -> Estimator:
    if isinstance(estimator, OneVsRest):
        return estimator.copy({estimator.classifier: _with_penalty(estimator.getClassifier(), penalty)})
    if isinstance(estimator, Pipeline):
        *before, last = estimator.getStages()
        return Pipeline(stages=[*before, _with_penalty(last, penalty)])
    return estimator.copy({estimator.regParam: penalty})


def logistic(
    c: float = 1.0,
    penalty: str = "l2",
    weight_col: str | None = None,
    one_vs_rest: bool = False,
    max_iter: int = 100,
    label: str = "label",
    tol: float = 1e-6,
) -> ByStrength:
    """Logistic regression with L1 or L2 penalty; the intercept is not penalised."""
    lr = LogisticRegression(
        labelCol=label,
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )
    return ByStrength(_multi_class(lr, weight_col, one_vs_rest, label), c, weight_col)


def svm_linear(
    c: float = 1.0,
    weight_col: str | None = None,
    one_vs_rest: bool = True,
    max_iter: int = 100,
    label: str = "label",
    features: str = "features",
    tol: float = 1e-4,
) -> ByStrength:
    """Linear support vector machine; it stops once a step improves the loss by less than ``tol``."""
    svc = LinearSVC(
        labelCol=label,
        featuresCol=features,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )
    return LinearMachine(_multi_class(svc, weight_col, one_vs_rest, label, features), c, weight_col)


def _multi_class(
    base, weight_col: str | None, one_vs_rest: bool, label: str, features: str = "features"
) -> Estimator:
    if not one_vs_rest:
        return base.setWeightCol(weight_col) if weight_col else base
    ovr = ClassByClass(
        classifier=base, labelCol=label, featuresCol=features, parallelism=CLASS_PARALLELISM
    )
    return ovr.setWeightCol(weight_col) if weight_col else ovr


class ClassByClass(OneVsRest):
    """One-vs-rest whose model scores rows without Python."""

    def _fit(self, dataset: DataFrame) -> ClassMargins:
        return self._copyValues(ClassMargins(super()._fit(dataset).models))


class ClassMargins(OneVsRestModel):
    """The library's one-vs-rest model, saved as such; its margins are taken by built-in expressions, not row by row in Python."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw, scored, names = self.getRawPredictionCol(), dataset, []
        for i, model in enumerate(self.models):
            names.append(f"__margin_{i}")
            quiet = {p: "" for p in (model.predictionCol, getattr(model, "probabilityCol", None)) if p is not None}
            one = model.copy({**quiet, model.rawPredictionCol: "__raw"}).transform(scored)
            scored = one.withColumn(names[-1], F.get(vector_to_array("__raw"), F.lit(1))).drop("__raw")
        scored = scored.withColumn("__margins", F.array(*names)).drop(*names)
        if raw:
            scored = scored.withColumn(raw, array_to_vector("__margins"))
        if self.getPredictionCol():
            best = F.array_position("__margins", F.array_max("__margins")).cast("double") - 1
            scored = scored.withColumn(self.getPredictionCol(), best)
        return scored.drop("__margins")


class LinearMachine(ByStrength):
    """Linear support vector machines whose classes, and strengths of a grid, are fitted in the same passes.

    ``base`` is the library's estimator, alone or one against the rest; the model is the library's too.
    """

    keeps_rows = True  # in blocks of its own; a cached copy of its input would be a second one

    def _fit(self, dataset: DataFrame) -> Model:
        return self.fit_grid(dataset, [{}])[0]

    def fit_grid(self, dataset: DataFrame, maps: Sequence[Mapping]) -> list[Model]:
        """A model for every set of parameters, each a strength."""
        return _fitted(self.base, self.weight_col, [self.copy(dict(m)).getOrDefault(self.C) for m in maps], dataset)


def _fitted(
    base: Estimator, weight_col: str | None, strengths: Sequence[float], dataset: DataFrame, features: Features | None = None, inputs: str | None = None
) -> list[Model]:
    """The library's models of ``base`` for every strength; ``features`` of the column ``inputs`` stand for those the model reads."""
    several = isinstance(base, OneVsRest)
    svc = base.getClassifier() if several else base
    label = as_col(base.getLabelCol()).cast("double")
    ship_package(dataset.sparkSession)
    weight = as_col(weight_col).cast("double") if weight_col else F.lit(1.0)
    x = features_array(dataset, inputs or base.getFeaturesCol())
    packed = blocks(dataset.select(x.alias("x"), label.alias("y"), weight.alias("weight"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes, rows = _classes(packed, dataset.schema, base)
        # Every step of the solver is a job; partitions of a few rows would make it all overhead.
        dealt = packed.coalesce(max(1, -(-rows // SOLVER_ROWS)))
        machines = [(k, c) for c in strengths for k in classes]
        found = fit_machines(dealt, features or Features(), machines, svc.getMaxIter(), svc.getTol())
    finally:
        packed.unpersist()
    models = [svc._copyValues(_library_machine(*one)) for one in found]
    if not several:
        return models
    groups = [models[i : i + len(classes)] for i in range(0, len(models), len(classes))]
    return [base._copyValues(ClassMargins(some)) for some in groups]


def _classes(packed: RDD, schema: StructType, base: Estimator) -> tuple[list[float], int]:
    """The classes that get a machine, and the number of rows."""
    rows, lowest, highest = label_extent(packed)
    if not rows:
        raise ValueError("no rows with a weight")
    if not (lowest >= 0 and highest < math.inf):
        raise ValueError("labels must be classes from 0 on")
    if isinstance(base, OneVsRest):
        return [float(k) for k in range(int(highest) + 1)], rows
    named = len(schema[base.getLabelCol()].metadata.get("ml_attr", {}).get("vals", ()))
    if (named or int(highest) + 1) != 2 or highest > 1:
        raise ValueError(f"a machine separates two classes, not {named or int(highest) + 1}")
    return [1.0], rows


def _library_machine(coefficients: np.ndarray, intercept: float) -> LinearSVCModel:
    """The library's model of these coefficients."""
    name = "org.apache.spark.ml.classification.LinearSVCModel"
    return LinearSVCModel(JavaParams._new_java_obj(name, LinearSVC().uid, DenseVector(coefficients), float(intercept)))


class RandomFourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Random cosine features whose inner products approximate ``exp(-gamma |x - y|^2)``.

    The projection depends only on the seed and sizes, so tasks draw it themselves; rows pass
    through in Arrow batches as one matrix product each.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "output size", TypeConverters.toInt)

    def __init__(
        self,
        inputCol: str = "features",
        outputCol: str = "kernel_features",
        gamma: float = 1.0,
        components: int = 100,
        seed: int = 42,
    ) -> None:
        super().__init__()
        self._set(
            inputCol=inputCol, outputCol=outputCol, gamma=gamma, components=components, seed=seed
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        gamma, size, seed = (
            self.getOrDefault(self.gamma), self.getOrDefault(self.components), self.getSeed()
        )

        @F.pandas_udf("array<double>")
        def project(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype="object")
            x = np.array(column.tolist(), dtype="float64")
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, math.sqrt(2 * gamma), (x.shape[1], size))
            phase = rng.uniform(0.0, 2 * math.pi, size)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(x @ w + phase)))

        made = array_to_vector(project(vector_to_array(F.col(self.getInputCol()))))
        return dataset.withColumn(self.getOutputCol(), made)


class ScaledVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector times a number."""

    factor = Param(Params._dummy(), "factor", "multiplier", TypeConverters.toFloat)

    def __init__(self, inputCol: str = "features", outputCol: str = "scaled_features", factor: float = 1.0) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, factor=factor)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        factor = F.lit(self.getOrDefault(self.factor))
        scaled = F.transform(vector_to_array(F.col(self.getInputCol())), lambda x: x * factor)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(scaled))


class KernelSvm(Estimator):
    """A support vector machine whose kernel, width, degree and strength are grid parameters.

    ``kernel`` is linear, rbf or poly; ``gamma`` is scale, auto or a number as text. A rule for gamma is
    worked out on the rows of each fit. The radial kernel runs as a linear machine over features
    from landmark rows, the polynomial one over expanded features.
    """

    kernel = Param(Params._dummy(), "kernel", "linear, rbf or poly", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", TypeConverters.toString)
    degree = Param(Params._dummy(), "degree", "degree of the polynomial", TypeConverters.toInt)
    C = Param(Params._dummy(), "C", "inverse penalty strength", TypeConverters.toFloat)

    def __init__(
        self,
        kernel: str = "rbf",
        gamma: str | float = "scale",
        degree: int = 3,
        c: float = 1.0,
        components: int = 100,
        weight_col: str | None = None,
        one_vs_rest: bool = False,
        max_iter: int = 100,
        label: str = "label",
    ) -> None:
        super().__init__()
        self._set(kernel=kernel, gamma=str(gamma), degree=degree, C=c)
        self.components, self.weight_col, self.label = components, weight_col, label
        self.one_vs_rest, self.max_iter = one_vs_rest, max_iter

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        kernel, gamma = self.getOrDefault(self.kernel), self.getOrDefault(self.gamma)
        width = 1.0
        if kernel != "linear":
            width = kernel_gamma(dataset, rule=gamma) if gamma in ("scale", "auto") else float(gamma)
        if kernel == "linear":
            stages: list[Transformer] = []
            features = Features()
        elif kernel == "rbf":
            mapped = nystroem(dataset, components=self.components, gamma=width)
            stages = [mapped]
            features = Features(functools.partial(rbf, z=mapped.points, gamma=width), mapped.weights)
        elif kernel == "poly":
            degree = self.getOrDefault(self.degree)
            stages = [
                ScaledVector(factor=math.sqrt(width)),
                PolynomialExpansion(inputCol="scaled_features", outputCol="kernel_features", degree=degree),
            ]
            features = Features(functools.partial(scaled_products, factor=math.sqrt(width), degree=degree))
        else:
            raise ValueError(f"unknown kernel {kernel!r}")
        svm = svm_linear(
            self.getOrDefault(self.C),
            self.weight_col,
            self.one_vs_rest,
            self.max_iter,
            self.label,
            "kernel_features" if stages else "features",
        )
        # Kernel features are made anew in each pass of the fit: they are several times the rows they come from.
        return PipelineModel([*stages, *_fitted(svm.base, self.weight_col, [svm.getOrDefault(svm.C)], dataset, features, "features")])


def svm_rbf(gamma: str | float = "scale", c: float = 1.0, components: int = 100, **kw) -> KernelSvm:
    """Radial-kernel SVM."""
    return KernelSvm("rbf", gamma, c=c, components=components, **kw)


def svm_poly(degree: int = 2, c: float = 1.0, gamma: str | float = "scale", **kw) -> KernelSvm:
    """Polynomial-kernel SVM."""
    return KernelSvm("poly", gamma, degree, c, **kw)


def svr(
    kernel: str = "linear",
    gamma: float = 1.0,
    epsilon: float = 1.35,
    c: float = 1.0,
    components: int = 100,
    label: str = "label",
) -> ByStrength:
    """Bounded-influence regression on linear or random Fourier features.

    Huber's loss stands in for the insensitive tube: both grow linearly in large errors.
    """
    lr = LinearRegression(
        labelCol=label,
        featuresCol="features" if kernel == "linear" else "kernel_features",
        loss="huber",
        epsilon=epsilon,
        standardization=False,
    )
    if kernel == "linear":
        return ByStrength(lr, c)
    return ByStrength(Pipeline(stages=[RandomFourierFeatures(gamma=gamma, components=components), lr]), c)


class PlattCurves:
    """Probability curves of a machine's margins, one for each class (one for two classes)."""

    def __init__(self, curves: Sequence[tuple[float, float]]) -> None:
        self.curves = list(curves)

    def probability(self, raw: str = "rawPrediction") -> Column:
        """Array of class probabilities; one curve per class is normalised to a sum of one."""
        margins = vector_to_array(F.col(raw))

        def at(i: int, a: float, b: float) -> Column:
            return 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.get(margins, F.lit(i)))))

        if len(self.curves) == 1:
            p = at(1, *self.curves[0])
            return F.array(1 - p, p)
        parts = [at(i, a, b) for i, (a, b) in enumerate(self.curves)]
        total = sum(parts[1:], parts[0])
        return F.array(*[F.try_divide(p, total) for p in parts])


def platt_out_of_fold(
    df: DataFrame,
    estimator: Estimator,
    folds: int,
    classes: int = 2,
    fold_col: str = "fold",
    label: str = "label",
    prep: Estimator | None = None,
) -> PlattCurves:
    """Curves fitted on margins of rows that the machine was not fitted on.

    Every fold is scored by a machine (and preprocessing) fitted on the others.
    """
    # Every fold reads the rows several times.
    df = df.persist()

    def scored(fold: int) -> DataFrame:
        train, held = df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
        if prep is not None:
            fitted = prep.fit(train)
            train, held = without_inputs(fitted.transform(train), prep, estimator), fitted.transform(held)
        part = fit_cached(estimator, train).transform(held)
        return part.select(as_col(label).cast("double").alias("label"), vector_to_array("rawPrediction").alias("raw"))

    held_out = functools.reduce(DataFrame.unionByName, side_by_side(df, scored, range(folds)))
    cached = held_out.persist()
    try:
        curves = []
        for i in [1] if classes == 2 else range(classes):
            data = cached.select(
                (F.col("label") == i).cast("double").alias("label"), array_to_vector(F.array(F.get("raw", F.lit(i)))).alias("features")
            )
            curve = LogisticRegression(maxIter=100, tol=1e-8).fit(data)
            curves.append((float(curve.intercept), float(curve.coefficients[0])))
    finally:
        cached.unpersist()
        df.unpersist()
    return PlattCurves(curves)


def with_margin(df: DataFrame, raw: str = "rawPrediction", index: int = 1, out: str = "margin") -> DataFrame:
    return df.withColumn(out, F.get(vector_to_array(F.col(raw)), F.lit(index)))


def one_vs_rest_probability(raw: str = "rawPrediction") -> Column:
    """Class probabilities from one-vs-rest margins: sigmoid each, then normalise."""
    odds = F.transform(vector_to_array(F.col(raw)), lambda m: 1 / (1 + F.exp(-m)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return F.transform(odds, lambda p: F.try_divide(p, total))


def class_probability(scored: DataFrame) -> Column:
    """Array of class probabilities of any scored table."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    return one_vs_rest_probability()


def forest_depth(max_depth: int | None) -> int:
    return UNBOUNDED_DEPTH if max_depth is None else max_depth


def random_forest_reg(
    trees: int = 100,
    max_depth: int | None = None,
    min_leaf: int = 1,
    subset: str = "all",
    seed: int = 42,
    label: str = "label",
    features: str = "features",
) -> RandomForestRegressor:
    return RandomForestRegressor(
        labelCol=label,
        featuresCol=features,
        numTrees=trees,
        maxDepth=forest_depth(max_depth),
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy=subset,
        seed=seed,
        checkpointInterval=10,
    )


def random_forest_clf(
    trees: int = 100,
    max_depth: int | None = None,
    min_leaf: int = 1,
    subset: str = "sqrt",
    seed: int = 42,
    label: str = "label",
    min_split: int = 2,
) -> RandomForestClassifier:
    forest = SplitForest(
        labelCol=label,
        numTrees=trees,
        maxDepth=forest_depth(max_depth),
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy=subset,
        seed=seed,
    )
    return forest._set(minSplit=min_split)


class SplitForest(RandomForestClassifier):
    """The library's forest, in which a node of fewer than ``minSplit`` rows (those of its tree's bag) stays a leaf.

    What a node is split on does not rest on the nodes below, so small ones are made leaves after the fit.
    """

    minSplit = Param(Params._dummy(), "minSplit", "fewest rows of a node that is split", TypeConverters.toInt)  # noqa: N815 - as the library's

    def _transfer_params_to_java(self) -> None:
        # The library's own object does not know this one.
        known = self._paramMap
        self._paramMap = {p: v for p, v in known.items() if p.name != "minSplit"}
        try:
            super()._transfer_params_to_java()
        finally:
            self._paramMap = known

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        model = super()._fit(dataset)
        least = self.getOrDefault(self.minSplit)
        # Two leaves of the least size already are that many rows.
        return model if least <= 2 * self.getMinInstancesPerNode() else _without_small_splits(dataset, model, least)


def _without_small_splits(df: DataFrame, model: RandomForestClassificationModel, least: int) -> RandomForestClassificationModel:
    gateway, forest = df.sparkSession.sparkContext._gateway, model._java_obj
    ml = gateway.jvm.org.apache.spark.ml
    tree_class = ml.classification.DecisionTreeClassificationModel

    def kept(node):
        if node.subtreeDepth() == 0:
            return node
        stats = node.impurityStats()
        if stats.rawCount() < least:
            return ml.tree.LeafNode(node.prediction(), node.impurity(), stats)
        left, right = kept(node.leftChild()), kept(node.rightChild())
        return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), left, right, node.split(), stats)

    trees = list(forest.trees())
    made = gateway.new_array(tree_class, len(trees))
    for i, tree in enumerate(trees):
        made[i] = tree_class(tree.uid(), kept(tree.rootNode()), forest.numFeatures(), forest.numClasses())
    pruned = RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(forest.uid(), made, forest.numFeatures(), forest.numClasses()))
    return model._copyValues(pruned)


def gbt_clf(
    trees: int = 100,
    learning_rate: float = 0.1,
    max_depth: int = 3,
    subsample: float = 1.0,
    min_leaf: int = 1,
    seed: int = 42,
    one_vs_rest: bool = False,
    label: str = "label",
) -> Estimator:
    """Boosted trees; several classes are fitted one against the rest."""
    gbt = GBTClassifier(
        labelCol=label,
        maxIter=trees,
        stepSize=learning_rate,
        maxDepth=max_depth,
        subsamplingRate=subsample,
        minInstancesPerNode=min_leaf,
        seed=seed,
    )
    if not one_vs_rest:
        return gbt
    return ClassByClass(classifier=gbt, labelCol=label, parallelism=CLASS_PARALLELISM)


def gbt_reg(
    trees: int = 100,
    learning_rate: float = 0.1,
    max_depth: int = 3,
    subsample: float = 1.0,
    column_sample: str | float = "all",
    seed: int = 42,
    label: str = "label",
    validation_col: str | None = None,
    validation_tol: float = 0.01,
) -> GBTRegressor:
    """Boosted regression trees.

    With ``validation_col`` (a boolean column) boosting stops once the flagged rows stop improving;
    ``column_sample`` is the share of features tried per split.
    """
    gbt = GBTRegressor(
        labelCol=label,
        maxIter=trees,
        stepSize=learning_rate,
        maxDepth=max_depth,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(column_sample),
        seed=seed,
    )
    if validation_col is not None:
        gbt = gbt.setValidationIndicatorCol(validation_col)
        gbt = gbt._set(validationTol=validation_tol)
    return gbt


def depth_for_leaves(leaves: int) -> int:
    """Depth of the smallest balanced tree with that many leaves."""
    return max(1, math.ceil(math.log2(leaves)))


def stable_order(df: DataFrame, key: Sequence[str], partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Fix partitioning and row order, on which the tree learners' random draws depend.

    The number of partitions follows from the number of rows alone, so the draws are the
    same on every cluster. Rows of a key with more rows than a partition is to hold are
    dealt by their content, and stand in the order of its hash.
    """
    rows = bucket_rows(df, key)
    parts = min(MOST_PARTITIONS, max(1, -(-sum(rows.values()) // partition_rows)))
    keys = [F.col(k) for k in key]
    if parts == 1 or not full_buckets(rows, partition_rows):
        return df.repartition(parts, *keys).sortWithinPartitions(*keys)
    dealt = df.withColumn("__content", content_hash(df))
    return dealt.repartition(parts, *keys, "__content").sortWithinPartitions(*keys, "__content").drop("__content")
