import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators.boosting import (
    BaggedForestRegressor,
    LeafBoostRegressor,
    Softmax,
    SoftmaxBoostClassifier,
    Squared,
    bag_weight,
    boost,
)
from cohortlens.operators.histtrees import Growth, bin_edges


def rows_of(seed, count=300, width=3):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        x = [float(rng.randint(0, 9)) for _ in range(width)]
        y = 3 * x[0] - (x[1] > 4) * 7 + (x[0] > 6) * x[2] + rng.gauss(0, 0.5)
        out.append((i, x, y))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, features array<double>, label double").repartition(3, "key")


def brute_tree(x, g, leaves, min_leaf=1, depth=None):
    """Best-first regression tree: the mean of each row's leaf."""
    def best(rows):
        found = None
        if len(rows) < 2:
            return found
        base = g[rows].sum() ** 2 / len(rows)
        for j in range(x.shape[1]):
            for cut in sorted(set(x[rows, j]))[:-1]:
                low = x[rows, j] <= cut
                a, b = g[rows[low]], g[rows[~low]]
                if min(len(a), len(b)) < min_leaf:
                    continue
                gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - base
                if found is None or gain > found[0] + 1e-9 * abs(gain):
                    found = (gain, rows[low], rows[~low])
        return found if found and found[0] > 1e-9 else None

    done = [(best(np.arange(len(x))), np.arange(len(x)), 0)]
    while len(done) < leaves:
        open_leaves = [leaf for leaf in done if leaf[0] and (depth is None or leaf[2] < depth)]
        if not open_leaves:
            break
        top = max(open_leaves, key=lambda leaf: leaf[0][0])
        done = [leaf for leaf in done if leaf is not top]
        done += [(best(part), part, top[2] + 1) for part in top[0][1:]]
    out = np.empty(len(x))
    for _, rows, _ in done:
        out[rows] = g[rows].mean()
    return out


@pytest.mark.parametrize(("leaves", "min_leaf", "depth"), [(2, 1, None), (7, 1, None), (12, 8, None), (30, 1, 3)])
def test_leaf_wise_rounds_equal_a_plain_booster(spark, leaves, min_leaf, depth):
    rows = rows_of(leaves)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = np.full(len(y), y.mean())
    for _ in range(3):
        want = want + 0.3 * brute_tree(x, y - want, leaves, min_leaf, depth)
    model = LeafBoostRegressor("key", 3, 0.3, leaves, depth or -1, min_leaf=min_leaf).fit(table(spark, rows))
    got = {r.key: r.prediction for r in model.transform(table(spark, rows)).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], want)
    assert max(sum(f < 0 for f in tree.feature) for trees in model.ensemble.rounds for tree in trees) <= leaves


def test_patience_keeps_the_best_rounds(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(4)], rng.gauss(0, 1)) for i in range(400)]
    flagged = table(spark, rows).withColumn("held", F.col("key") % 3 == 0)
    noise = LeafBoostRegressor("key", 60, 0.5, 15, min_leaf=1, held_col="held", patience=4).fit(flagged).ensemble
    # Nothing can be learnt: the loss rises, and boosting ends four rounds after its least.
    best = int(np.argmin(noise.losses))
    assert len(noise.losses) == best + 5 and len(noise.rounds) == best < 56
    assert noise.losses[0] == pytest.approx(np.mean([(r[2] - noise.start[0]) ** 2 for r in rows if r[0] % 3 == 0]))
    real = table(spark, rows_of(5)).withColumn("held", F.col("key") % 3 == 0)
    full = LeafBoostRegressor("key", 6, 0.2, 7, held_col="held").fit(real).ensemble
    assert len(full.rounds) == 6 and len(full.losses) == 7 and list(full.losses) == sorted(full.losses, reverse=True)


def test_samples_of_rows_and_columns_repeat(spark):
    df = table(spark, rows_of(6))
    fits = [boost(d, Squared(), 4, 0.3, Growth(7, curved=True), "key", row_share=0.6, column_share=0.5) for d in (df, df.repartition(5))]
    assert [t.feature for r in fits[0].rounds for t in r] == [t.feature for r in fits[1].rounds for t in r]
    # Two of three features stand in each round.
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for r in fits[0].rounds for t in r)
    assert len({tuple(t.feature) for r in fits[0].rounds for t in r}) > 1


def test_five_classes_in_one_ensemble(spark):
    rows = rows_of(8, 600)
    cuts = np.quantile([r[2] for r in rows], [0.2, 0.4, 0.6, 0.8])
    classed = [(k, x, float(np.searchsorted(cuts, y))) for k, x, y in rows]
    model = SoftmaxBoostClassifier("key", 12, 0.3, num_leaves=8, min_leaf=3, subsample=0.8).fit(table(spark, classed))
    assert len(model.ensemble.rounds) == 12 and all(len(trees) == 5 for trees in model.ensemble.rounds)
    scored = model.transform(table(spark, classed)).withColumn("p", vector_to_array("probability")).collect()
    assert all(math.isclose(sum(r.p), 1.0) and r.prediction == max(range(5), key=lambda k: (r.p[k], -k)) for r in scored)
    assert np.mean([r.prediction == r.label for r in scored]) > 0.85


def test_softmax_round_equals_a_plain_step(spark):
    rows = [(k, x, float(min(2, max(0, y // 8)))) for k, x, y in rows_of(9)]
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    shares = np.array([(y == k).mean() for k in range(3)])
    want = np.tile(np.log(shares), (len(y), 1))
    for k in range(3):
        g = (y == k) - shares[k]
        # The mean gradient over p (1 - p) is the Newton step of a leaf.
        want[:, k] += 0.4 * 2 / 3 * brute_tree(x, g, 4) / (shares[k] * (1 - shares[k]))
    model = SoftmaxBoostClassifier("key", 1, 0.4, num_leaves=4, min_leaf=1).fit(table(spark, rows))
    got = {r.key: r.p for r in model.transform(table(spark, rows)).select("key", vector_to_array("probability").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(y))], Softmax.probabilities(want))


def test_out_of_bag_score(spark):
    rows = rows_of(10)
    df = table(spark, rows)
    model = BaggedForestRegressor("key", 5, 3).fit(df)
    bags = {r.key: r.w for r in df.select("key", F.array(*[bag_weight("key", t) for t in range(5)]).alias("w")).collect()}
    w = np.array([bags[i] for i in range(len(rows))])
    assert 0.25 < (w == 0).mean() < 0.5 and 0.85 < w.mean() < 1.15
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for t, tree in enumerate(model.forest.trees):
        many = np.repeat(np.arange(len(rows)), w[:, t])
        plain = brute_tree(x[many], y[many], 100, depth=3)
        assert np.allclose(tree.predict(x)[many], plain)
    shown = np.array([tree.predict(x) for tree in model.forest.trees]).T
    out = w == 0
    some = out.any(axis=1)
    p = (shown * out).sum(axis=1)[some] / out.sum(axis=1)[some]
    want = 1 - ((y[some] - p) ** 2).sum() / ((y[some] - y[some].mean()) ** 2).sum()
    assert model.forest.out_of_bag_r2 == pytest.approx(want) and model.forest.out_of_bag_rows == some.sum()
    assert sum(model.featureImportances) == pytest.approx(1.0) and np.argmax(model.featureImportances) == 0


def test_awkward_rows(spark):
    rows = [(1, [1.0, None], 2.0), (2, None, 1.0), (3, [1.0, math.nan], 1.0), (4, [1.0, 1.0], None), (5, [1.0, 1.0], 3.0), (None, [2.0, 1.0], 5.0)]
    df = table(spark, rows)
    model = LeafBoostRegressor("key", 2, 1.0, 4, min_leaf=1).fit(df)
    got = {r.key: r.prediction for r in model.transform(df).collect()}
    assert got[1] is None and got[2] is None and got[3] is None
    assert got[4] == got[5] == pytest.approx(3.0) and got[None] == pytest.approx(5.0)
    with pytest.raises(ValueError, match="no complete rows"):
        LeafBoostRegressor("key").fit(df.limit(0))
    # One class, equal labels and constant features give constant predictions.
    same = table(spark, [(i, [1.0], 0.0) for i in range(10)])
    assert {r.prediction for r in SoftmaxBoostClassifier("key", 2).fit(same).transform(same).collect()} == {0.0}
    assert {r.prediction for r in BaggedForestRegressor("key", 2).fit(same).transform(same).collect()} == {0.0}
    edges, count = bin_edges(same, "features")
    assert edges == [[1.0]] and count == 10
