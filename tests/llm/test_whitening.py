import math
import random
from fractions import Fraction

import numpy as np
import pytest

from cohortlens.llm.whitening import bit_planes, scatter, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component string, key string"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "own", "own", "own") for k, v in rows], SCHEMA)


def plain(rows):
    """Integers of the rows that take part, and the exact covariance."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, dims = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dims)]
    centred = [[Fraction(n * r[i] - sums[i], n) for i in range(dims)] for r in x]
    covariance = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dims)] for i in range(dims)])
    deviations = [sum((n * r[i] - sums[i]) ** 2 for i in range(dims)) for r in x]
    return kept, centred, covariance, deviations


def some_rows(seed=1, count=150, dims=6):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    rows = []
    for i in range(count):
        z = [rng.gauss(0, 1 + k) for k in range(dims)]
        rows.append((i, [sum(a * b for a, b in zip(z, m)) + 3 for m in mix]))
    # Copies, null keys, and vectors that take no part.
    rows += [rows[0], rows[0], (None, rows[1][1])]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * dims), (903, [math.inf] + [0.0] * (dims - 1))]
    return rows


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for low, high, rows in ((-5, 5, 1), (0, 1, 64), (-(2**40), 2**40, 130), (7, 8, 65), (10**6, 10**6 + 300, 1000)):
        values = rng.integers(low, high, (rows, 4))
        sums, products = scatter(values)
        wide = values.astype(object)
        assert sums.tolist() == wide.sum(axis=0).tolist()
        assert products.tolist() == (wide.T @ wide).tolist()
    assert bit_planes(np.zeros((0, 3), np.int64)) == []
    assert scatter(np.zeros((0, 2), np.int64))[1].tolist() == [[0, 0], [0, 0]]


@pytest.mark.parametrize("components", [32, 3])
def test_whitening_equals_the_plain_solution(spark, components):
    rows = some_rows()
    kept, centred, covariance, deviations = plain(rows)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    got = whiten(table(spark, rows).repartition(4), "vec_id", "embedding", components).collect()
    assert len(got) == len(kept) * len(order)
    wanted = np.array([[float(c) for c in r] for r in centred]) @ (vectors[:, order] / np.sqrt(values[order]))
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append((r["vec_id"], float(r["deviation"]), r["whitened"]))
        assert r["n"] == len(kept)
        assert abs(r["explained"] - values[order[r["component"] - 1]] / values.sum()) <= 1e-9
        assert r["identity_error"] < 1e-9
    for k in range(len(order)):
        want = [(key, float(d), w) for (key, _), d, w in zip(kept, deviations, wanted[:, k])]
        found = by_component[k + 1]
        near = lambda rows, sign: sorted(((str(a), b, round(sign * c, 7) + 0.0) for a, b, c in rows))
        assert near(found, 1) in (near(want, 1), near(want, -1))
    # The deviation is exact.
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviations)


def test_whitened_covariance_is_the_identity(spark):
    got = whiten(table(spark, some_rows(2)), "vec_id", "embedding").collect()
    # Rows with one key are copies, so each component's values stand in one order of rows.
    columns = [sorted((str(r["vec_id"]), r["whitened"]) for r in got if r["component"] == k) for k in range(1, 7)]
    assert len({tuple(key for key, _ in column) for column in columns}) == 1
    whitened = np.array([[value for _, value in column] for column in columns]).T
    centred = whitened - whitened.mean(axis=0)
    assert np.abs(centred.T @ centred / len(whitened) - np.eye(6)).max() < 1e-9


def test_degenerate_tables(spark):
    assert whiten(table(spark, []), "vec_id", "embedding").count() == 0
    assert whiten(table(spark, [(1, None), (2, [None])]), "vec_id", "embedding").count() == 0
    assert whiten(table(spark, [(1, []), (2, [])]), "vec_id", "embedding").count() == 0
    # Equal vectors have no variance; a constant dimension has none of its own.
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(4)]), "vec_id", "embedding").count() == 0
    flat = whiten(table(spark, [(i, [float(i), 2.0]) for i in range(4)]), "vec_id", "embedding").collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 4
    with pytest.raises(ValueError, match="rename"):
        whiten(table(spark, []), "n", "embedding")
    with pytest.raises(Exception, match="different lengths"):
        whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").collect()


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + (i << 30)), float(-i)]) for i in range(5)]
    _, _, _, deviations = plain(rows)
    got = whiten(table(spark, rows), "vec_id", "embedding").where("component = 1").orderBy("vec_id").collect()
    assert [int(r["deviation"]) for r in got] == deviations
    with pytest.raises(Exception, match="does not fit"):
        whiten(table(spark, [(1, [3e38]), (2, [1.0])]), "vec_id", "embedding").collect()
