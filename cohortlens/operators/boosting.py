"""Leaf-wise boosting with patience, softmax boosting, and forests scored on the rows left out of each bag.

All grow on the histograms of ``histtrees``. Boosting keeps each row's scores in a cached table that every
round replaces; forests need none, as a row's bags follow from its key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, hash_uniform
from cohortlens.operators.histtrees import (
    MAX_BINS,
    SUMS,
    Grower,
    Growth,
    Sums,
    Tree,
    added_sums,
    bin_edges,
    binned,
    bins_matrix,
    features_array,
    hash_share,
)
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.shipping import ship_package

# Rounds after which the table of scores is written to the checkpoint folder.
CHECKPOINT_ROUNDS = 10
# Trees of a forest that grow in the same passes.
FOREST_BATCH = 16

_STATE = "row bigint, y double, held boolean, bins binary, score array<double>"


@dataclass(frozen=True)
class Squared:
    """Half the squared error; one tree a round."""

    outputs: int = 1

    def start(self, counts: dict) -> np.ndarray:
        return np.array([counts["mean"]])

    def gradients(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return y[:, None] - score, np.ones_like(score)

    def losses(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (y - score[:, 0]) ** 2

    def leaf(self, gradient: float, curvature: float, ridge: float) -> float:
        return gradient / (curvature + ridge) if curvature + ridge > 0 else 0.0


@dataclass(frozen=True)
class Softmax:
    """Cross entropy of classes 0 to outputs - 1, whose trees of a round share their gradients."""

    outputs: int

    def start(self, counts: dict) -> np.ndarray:
        shares = np.array([counts["classes"].get(k, 0) for k in range(self.outputs)], float)
        shares = np.maximum(shares / shares.sum(), np.finfo(float).eps)
        return np.log(shares)

    @staticmethod
    def probabilities(score: np.ndarray) -> np.ndarray:
        odds = np.exp(score - score.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def gradients(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.probabilities(score)
        return (np.arange(self.outputs) == y[:, None]) - p, p * (1 - p)

    def losses(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        p = self.probabilities(score)
        return -np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300))

    def leaf(self, gradient: float, curvature: float, ridge: float) -> float:
        share = (self.outputs - 1) / self.outputs
        return share * gradient / (curvature + ridge) if curvature + ridge > 0 else 0.0


@dataclass(frozen=True)
class Ensemble:
    """Rounds of trees (one per output), added to the start scores."""

    start: np.ndarray
    rounds: tuple[tuple[Tree, ...], ...]
    gains: dict[int, float] = field(default_factory=dict)
    losses: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.predict(x)
        return out


def _scores(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _measure(
    loss: Squared | Softmax, share: float, salt: tuple[int, ...], trees: list, wanted: list, width: int, bins: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """A task's sums for the wanted nodes; with a root, also the loss of the rows held out (tree -1)."""
    sums = Sums(trees, wanted, width, bins)
    lost, held_rows = 0.0, 0
    for batch in batches:
        row, y, held, packed, score = (batch.column(c) for c in range(5))
        row, y, held = row.to_numpy(), y.to_numpy(), held.to_numpy(zero_copy_only=False)
        score = _scores(score, batch.num_rows)
        if held.any():
            lost += float(loss.losses(y[held], score[held]).sum())
            held_rows += int(held.sum())
        matrix = bins_matrix(packed, width)[~held]
        gradient, curvature = loss.gradients(y[~held], score[~held])
        weight = np.ones(len(matrix)) if share >= 1 else (hash_share(row[~held], *salt) < share).astype(float)
        sums.add(matrix, gradient, curvature, np.repeat(weight[:, None], len(trees), axis=1))
    yield from sums.rows()
    flat = np.zeros(width * bins * 3)
    flat[:2] = lost, held_rows
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["tree", "node", "sums"]
    )


def _added(trees: tuple[Tree, ...], width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the trees' values added to their scores."""
    for batch in batches:
        matrix, score = bins_matrix(batch.column(3), width), _scores(batch.column(4), batch.num_rows).copy()
        for k, tree in enumerate(trees):
            score[:, k] += np.array(tree.value)[tree.binned_leaves(matrix)]
        offsets = pa.array(np.arange(len(score) + 1) * score.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.ListArray.from_arrays(offsets, pa.array(score.ravel()))], names=batch.schema.names
        )


def _grow(growers: list[Grower], measure: Callable[[list, list], DataFrame], width: int, bins: int) -> dict | None:
    """Grow trees side by side, one pass over the rows for all of them; the sums of tree -1 come back."""
    other = None
    while any(wanted := [g.wanted() for g in growers]):
        found = added_sums(measure([g.tree for g in growers], wanted), width, bins)
        other = other if other is not None else found.get((-1, 0))
        for k, (grower, nodes) in enumerate(zip(growers, wanted)):
            if nodes:
                grower.take({node: sums for (tree, node), sums in found.items() if tree == k}, width, bins)
    return other


def boost(
    df: DataFrame,
    loss: Squared | Softmax,
    rounds: int,
    learning_rate: float,
    growth: Growth,
    key: str,
    features: str = "features",
    label: str = "label",
    row_share: float = 1.0,
    column_share: float = 1.0,
    held_col: str | None = None,
    patience: int = 10,
    max_bins: int = MAX_BINS,
    seed: int = 42,
) -> Ensemble:
    """Boosting by gradients; rows with a null label or feature take no part.

    Rows of a round are drawn by a hash of `key`, its columns by a hash of their place. With `held_col` (a boolean
    column) boosting ends once the mean loss of the flagged rows, which take no part in the fit, has not fallen
    for `patience` rounds, and the rounds up to the least loss are kept.
    """
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    entries = features_array(df, features)
    known = df.where(as_col(label).isNotNull() & entries.isNotNull() & F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x)))
    held = F.coalesce(as_col(held_col).cast("boolean"), F.lit(False)) if held_col else F.lit(False)
    fitted = known.where(~held)
    edges, rows = bin_edges(fitted, features, max_bins)
    if not rows:
        raise ValueError("no complete rows")
    width, bins = len(edges), max((len(e) for e in edges), default=0) + 1
    y = as_col(label).cast("double")
    if isinstance(loss, Softmax):
        counts = {"classes": {int(r.y): r.n for r in fitted.groupBy(y.alias("y")).agg(F.count("*").alias("n")).collect()}}
    else:
        counts = {"mean": fitted.agg(F.avg(y)).first()[0]}
    start = loss.start(counts)
    table = binned(
        known, features, edges, rows, row=F.xxhash64(as_col(key)), y=y, held=held
    ).withColumn("score", F.array(*[F.lit(float(s)) for s in start]))
    state = table.select("row", "y", "held", "bins", "score").persist()
    done: list[tuple[Tree, ...]] = []
    losses: list[float] = []
    gains: dict[int, float] = {}
    try:
        for number in range(rounds):
            allowed = None
            if column_share < 1:
                order = np.argsort(hash_share(np.arange(width), seed, number, 1), kind="stable")
                allowed = order[: max(1, round(column_share * width))].tolist()
            growers = [Grower(growth, edges, allowed) for _ in range(loss.outputs)]

            def measure(trees: list, wanted: list, state: DataFrame = state, salt: tuple[int, ...] = (seed, number)) -> DataFrame:
                return state.mapInArrow(lambda batches: _measure(loss, row_share, salt, trees, wanted, width, bins, batches), SUMS)

            other = _grow(growers, measure, width, bins)
            if held_col and other is not None and other.ravel()[1]:
                losses.append(float(other.ravel()[0] / other.ravel()[1]))
                if len(losses) - 1 - int(np.argmin(losses)) >= patience:
                    break
            trees = []
            for grower in growers:
                tree, gained = grower.finish(lambda g, h, n: learning_rate * loss.leaf(g, h, growth.ridge))
                trees.append(tree)
                for feature, gain in gained.items():
                    gains[feature] = gains.get(feature, 0.0) + gain
            done.append(tuple(trees))
            if number + 1 < rounds or held_col:
                before, added = state, tuple(trees)
                state = before.mapInArrow(lambda batches, added=added: _added(added, width, batches), _STATE)
                # Made from the old scores before those are let go.
                if (number + 1) % CHECKPOINT_ROUNDS == 0:
                    state = state.checkpoint()
                else:
                    state.persist().count()
                before.unpersist()
        else:
            if held_col:
                last = state.where("held").select("y", "score").mapInArrow(lambda batches: _held_loss(loss, batches), "lost double, n bigint")
                total = last.agg(F.sum("lost").alias("lost"), F.sum("n").alias("n")).first()
                if total.n:
                    losses.append(total.lost / total.n)
    finally:
        state.unpersist()
    # The first loss is that of the start scores alone.
    kept = int(np.argmin(losses)) if losses else len(done)
    return Ensemble(start, tuple(done[:kept]), gains, tuple(losses))


def _held_loss(loss: Squared | Softmax, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lost = loss.losses(batch.column(0).to_numpy(), _scores(batch.column(1), batch.num_rows)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([float(lost.sum())]), pa.array([batch.num_rows], pa.int64())], names=["lost", "n"])


def _predicted(df: DataFrame, features: str, function: Callable[[np.ndarray], np.ndarray], width: int) -> Column:
    """The matrix function of the features, a row of `width` numbers for each row; null where an entry is."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        known = [i for i, x in enumerate(column) if x is not None and not any(v is None or v != v for v in x)]
        if known:
            found = function(np.array([column.iloc[i] for i in known], float))
            for i, row in zip(known, found.reshape(len(known), width)):
                out[i] = row
        return pd.Series(out, dtype="object")

    return run(features_array(df, features))


class _Boosted(Estimator):
    """What boosted regressors and classifiers share; the parameters below may stand in grids."""

    rounds = Param(Params._dummy(), "rounds", "number of rounds", TypeConverters.toInt)
    learning_rate = Param(Params._dummy(), "learning_rate", "factor of each tree", TypeConverters.toFloat)
    num_leaves = Param(Params._dummy(), "num_leaves", "most leaves of a tree", TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "most levels of a tree, -1 for any", TypeConverters.toInt)
    subsample = Param(Params._dummy(), "subsample", "share of rows in a round", TypeConverters.toFloat)
    column_sample = Param(Params._dummy(), "column_sample", "share of features in a round", TypeConverters.toFloat)
    min_leaf = Param(Params._dummy(), "min_leaf", "fewest rows of a leaf", TypeConverters.toInt)

    def __init__(
        self,
        key: str,
        rounds: int = 100,
        learning_rate: float = 0.1,
        num_leaves: int = 31,
        max_depth: int = -1,
        subsample: float = 1.0,
        column_sample: float = 1.0,
        min_leaf: int = 20,
        ridge: float = 0.0,
        held_col: str | None = None,
        patience: int = 10,
        max_bins: int = MAX_BINS,
        seed: int = 42,
        features: str = "features",
        label: str = "label",
    ) -> None:
        super().__init__()
        self._set(
            rounds=rounds, learning_rate=learning_rate, num_leaves=num_leaves, max_depth=max_depth,
            subsample=subsample, column_sample=column_sample, min_leaf=min_leaf,
        )
        self.key, self.ridge, self.held_col, self.patience = key, ridge, held_col, patience
        self.max_bins, self.seed, self.features, self.label = max_bins, seed, features, label

    def _boosted(self, dataset: DataFrame, loss: Squared | Softmax, curved: bool) -> Ensemble:
        get = self.getOrDefault
        depth = get(self.max_depth)
        leaves = get(self.num_leaves)
        if leaves < 2 or get(self.rounds) < 0 or not 0 < get(self.subsample) <= 1 or not 0 < get(self.column_sample) <= 1:
            raise ValueError("num_leaves, rounds or a share out of range")
        growth = Growth(leaves, depth if depth > 0 else None, get(self.min_leaf), self.ridge, curved)
        return boost(
            dataset, loss, get(self.rounds), get(self.learning_rate), growth, self.key, self.features, self.label,
            get(self.subsample), get(self.column_sample), self.held_col, self.patience, self.max_bins, self.seed,
        )


class LeafBoostRegressor(_Boosted):
    """Regression by squared error with trees grown leaf by leaf."""

    def _fit(self, dataset: DataFrame) -> LeafBoostRegressionModel:
        return LeafBoostRegressionModel(self._boosted(dataset, Squared(), True), self.features)


class LeafBoostRegressionModel(Model):
    def __init__(self, ensemble: Ensemble, features: str) -> None:
        super().__init__()
        self.ensemble, self.features = ensemble, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", _predicted(dataset, self.features, self.ensemble.scores, 1)[0])


class SoftmaxBoostClassifier(_Boosted):
    """Classes 0 to K - 1 by one ensemble: K trees a round on shared softmax gradients.

    Splits compare the squared error of the gradients, leaves take a Newton step of factor (K - 1) / K.
    """

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostModel:
        classes = int(dataset.agg(F.max(as_col(self.label))).first()[0]) + 1
        return SoftmaxBoostModel(self._boosted(dataset, Softmax(max(2, classes)), False), self.features)


class SoftmaxBoostModel(Model):
    """Adds `probability` (a vector) and `prediction`, the most likely class, the first among equals."""

    def __init__(self, ensemble: Ensemble, features: str) -> None:
        super().__init__()
        self.ensemble, self.features = ensemble, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ensemble = self.ensemble
        p = _predicted(dataset, self.features, lambda x: Softmax.probabilities(ensemble.scores(x)), len(ensemble.start))
        scored = dataset.withColumn("__p", p)
        best = F.array_position("__p", F.array_max("__p")).cast("double") - 1
        return scored.withColumns({"probability": F.when(F.col("__p").isNotNull(), array_to_vector("__p")), "prediction": best}).drop("__p")


# --- forests on bags that follow from the key ----------------------------------------------


def poisson_steps(most: int = 12) -> list[float]:
    """P(X <= k) of a Poisson variable of mean 1, for k below `most`."""
    out, term = [], math.exp(-1.0)
    for k in range(most):
        out.append(term + (out[-1] if out else 0.0))
        term /= k + 1
    return out


def bag_weight(key: str | Column, tree: int, seed: int = 42) -> Column:
    """How often the row of a key is in the bag of a tree: Poisson of mean 1, by a hash of key, seed and tree.

    The same wherever it is worked out, so the rows left out of a bag need no table.
    """
    u = hash_uniform(key, f"{seed}-{tree}")
    out = F.lit(0)
    for step in poisson_steps():
        out = out + (u >= F.lit(step)).cast("int")
    return out.cast("int")


def _bag_sums(trees: list, wanted: list, first: int, width: int, bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums(trees, wanted, width, bins)
    for batch in batches:
        y, bags = batch.column(0).to_numpy(), _scores(batch.column(1), batch.num_rows)
        many = (batch.num_rows, len(trees))
        matrix = bins_matrix(batch.column(2), width)
        sums.add(matrix, np.broadcast_to(y[:, None], many), np.ones(many), bags[:, first : first + len(trees)].astype(float))
    yield from sums.rows()


def _bag_votes(trees: tuple[Tree, ...], width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over rows that some tree's bag left out: n, y, y^2, squared error of the mean of those trees."""
    total = np.zeros(4)
    for batch in batches:
        y, bags = batch.column(0).to_numpy(), _scores(batch.column(1), batch.num_rows)
        matrix = bins_matrix(batch.column(2), width)
        shown, votes = np.zeros(len(y)), np.zeros(len(y))
        for t, tree in enumerate(trees):
            out = bags[:, t] == 0
            shown[out] += np.array(tree.value)[tree.binned_leaves(matrix[out])]
            votes[out] += 1
        some = votes > 0
        y, error = y[some], y[some] - shown[some] / votes[some]
        total += [len(y), y.sum(), (y * y).sum(), (error * error).sum()]
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["n", "s", "ss", "e"])


@dataclass(frozen=True)
class BaggedForest:
    trees: tuple[Tree, ...]
    importances: tuple[float, ...]
    out_of_bag_r2: float | None
    out_of_bag_rows: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((tree.predict(x) for tree in self.trees), np.zeros(len(x))) / len(self.trees)


def bagged_forest(
    df: DataFrame,
    key: str,
    trees: int = 100,
    growth: Growth | None = None,
    features: str = "features",
    label: str = "label",
    max_bins: int = MAX_BINS,
    seed: int = 42,
    batch: int = FOREST_BATCH,
) -> BaggedForest:
    """A regression forest on Poisson bags, with the R2 of the mean prediction of the trees that did not see a row.

    Rows without such a tree do not count; no such row gives None. Importances are shares of the gain. Rows with
    a null label or feature take no part. Trees grow in batches that share their passes.
    """
    spark = df.sparkSession
    ship_package(spark)
    growth = growth or Growth(leaves=None, depth=10)
    entries = features_array(df, features)
    known = df.where(as_col(label).isNotNull() & entries.isNotNull() & F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x)))
    edges, rows = bin_edges(known, features, max_bins)
    if not rows:
        raise ValueError("no complete rows")
    width, bins = len(edges), max((len(e) for e in edges), default=0) + 1
    middle = float(known.agg(F.avg(as_col(label))).first()[0])
    # Sums of squares about the mean keep their digits.
    y = as_col(label).cast("double") - F.lit(middle)
    bags = F.array(*[bag_weight(key, t, seed) for t in range(trees)])
    table = binned(known, features, edges, rows, y=y, bags=bags).persist()
    gains = np.zeros(width)
    done: list[Tree] = []
    try:
        for first in range(0, trees, batch):
            growers = [Grower(growth, edges) for _ in range(min(batch, trees - first))]

            def measure(some: list, wanted: list, first: int = first) -> DataFrame:
                return table.mapInArrow(lambda batches: _bag_sums(some, wanted, first, width, bins, batches), SUMS)

            _grow(growers, measure, width, bins)
            for grower in growers:
                tree, gained = grower.finish(lambda g, h, n: g / n if n else 0.0)
                done.append(tree)
                for feature, gain in gained.items():
                    gains[feature] += gain
        votes = table.mapInArrow(lambda batches: _bag_votes(tuple(done), width, batches), "n double, s double, ss double, e double")
        n, s, ss, e = votes.agg(*[F.sum(c) for c in ("n", "s", "ss", "e")]).first()
    finally:
        table.unpersist()
    spread = ss - s * s / n if n else 0.0
    r2 = None if not n else 1 - e / spread if spread > 0 else float(e == 0)
    for tree in done:
        tree.value = [v + middle if f < 0 else 0.0 for v, f in zip(tree.value, tree.feature)]
    total = gains.sum()
    return BaggedForest(tuple(done), tuple((gains / total if total else gains).tolist()), r2, int(n or 0))


class BaggedForestRegressor(Estimator):
    """A forest whose model knows its out-of-bag R2."""

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "most levels of a tree", TypeConverters.toInt)
    min_leaf = Param(Params._dummy(), "min_leaf", "fewest rows (by weight) of a leaf", TypeConverters.toInt)

    def __init__(
        self,
        key: str,
        trees: int = 100,
        max_depth: int = 10,
        min_leaf: int = 1,
        max_bins: int = MAX_BINS,
        seed: int = 42,
        features: str = "features",
        label: str = "label",
    ) -> None:
        super().__init__()
        self._set(trees=trees, max_depth=max_depth, min_leaf=min_leaf)
        self.key, self.max_bins, self.seed, self.features, self.label = key, max_bins, seed, features, label

    def _fit(self, dataset: DataFrame) -> BaggedForestModel:
        get = self.getOrDefault
        growth = Growth(None, get(self.max_depth), get(self.min_leaf))
        forest = bagged_forest(
            dataset, self.key, get(self.trees), growth, self.features, self.label, self.max_bins, self.seed
        )
        return BaggedForestModel(forest, self.features)


class BaggedForestModel(Model):
    def __init__(self, forest: BaggedForest, features: str) -> None:
        super().__init__()
        self.forest, self.features = forest, features

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the library's name
        return Vectors.dense(self.forest.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", _predicted(dataset, self.features, self.forest.predict, 1)[0])
