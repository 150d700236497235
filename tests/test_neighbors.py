import numpy as np
import pytest

from cohortlens.operators import neighbors

N, DIM, K = 300, 5, 4


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    vecs = np.round(rng.normal(size=(N, DIM)), 1)
    vecs[: N // 3] = vecs[0]  # a third of the rows are copies of one point
    labels = rng.integers(0, 3, N)
    rows = [(i, vecs[i].tolist(), int(labels[i])) for i in range(N)]
    return vecs, labels, spark.createDataFrame(rows, "key long, features array<double>, label int").cache()


def brute(vecs, metric, k=K, exclude_self=False):
    out = {}
    for i, q in enumerate(vecs):
        d = np.abs(vecs - q).sum(1) if metric == "manhattan" else np.sqrt(((vecs - q) ** 2).sum(1))
        order = sorted((round(float(v), 6), j) for j, v in enumerate(d) if not (exclude_self and j == i))
        out[i] = [j for _, j in order[:k]]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("key", "rank").collect():
        out.setdefault(r.key, []).append(r.neighbor)
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski"])
@pytest.mark.parametrize("route", [{}, {"pivots": 9, "chunk_rows": 25}, {"pivots": 1}])
def test_any_cells_are_exact(points, metric, route):
    vecs, _, df = points
    got = collect(neighbors.knn_join(df, df, K, "key", "key", metric=metric, **route))
    assert got == brute(vecs, "manhattan" if metric == "manhattan" else "euclidean")


def test_without_self(points):
    vecs, _, df = points
    got = collect(neighbors.knn_join(df, df, K, "key", "key", exclude_self=True, pivots=5))
    assert got == brute(vecs, "euclidean", exclude_self=True)


def test_more_neighbours_than_rows(points):
    _, _, df = points
    few = df.where("key < 3")
    for route in ({}, {"pivots": 2}):
        assert neighbors.knn_join(few, few, 10, "key", "key", **route).count() == 9


def test_votes(points):
    vecs, labels, df = points
    near = brute(vecs, "euclidean", 5)
    got = {r.key: r.predicted for r in neighbors.knn_classify(df, df, "label", 5).collect()}
    for key, rows in near.items():
        votes = np.bincount(labels[rows], minlength=3)
        assert got[key] == votes.argmax()


def test_exact_match_takes_all_weight(spark):
    ref = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (3, [1.1], 0)], "key long, features array<double>, label int")
    ask = spark.createDataFrame([(9, [0.0])], "key long, features array<double>")
    assert neighbors.knn_classify(ask, ref, "label", 3).first().predicted == 0
    assert neighbors.knn_classify(ask, ref, "label", 3, weights="distance").first().predicted == 1
    assert neighbors.knn_regress(ask, ref, "label", 3).first().predicted == pytest.approx(1 / 3)


def test_unknown_metric(points):
    with pytest.raises(ValueError):
        neighbors.knn_join(points[2], points[2], 1, "key", "key", metric="cosine")


def test_text_keys_vectors_and_missing_ones(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [5.0, 5.0]), ("n", None), (None, [0.0, 0.0]), ("m", [None, 1.0])]
    df = spark.createDataFrame(rows, "key string, features array<double>")
    got = collect(neighbors.knn_join(df, df, 2, "key", "key"))
    assert got == {"a": ["a", "b"], "b": ["a", "b"], "c": ["c", "a"]}
    ml = df.where("key IN ('a', 'b', 'c')").withColumn("features", array_to_vector("features"))
    assert collect(neighbors.knn_join(ml, ml, 2, "key", "key")) == got


def test_no_reference_rows(points):
    _, _, df = points
    assert neighbors.knn_join(df, df.limit(0), 3, "key", "key").count() == 0


def test_few_candidates_reach_the_final_ranking(spark):
    """Candidate rows per query stay within a small multiple of k."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 8)) * 10
    rows = [(i, (centres[i % 30] + rng.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, vec array<double>")
    found = neighbors._search(df, df, 5, "euclidean", None, neighbors.CHUNK_ROWS)
    assert found.count() <= 4 * 5 * 3000


def test_few_reference_rows_and_many_queries_stay_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    queries, refs = rng.normal(size=(60_000, 16)), rng.normal(size=(10, 16))
    tracemalloc.start()
    try:
        found = [d for _, _, d in neighbors._nearest(queries, refs, np.arange(10), 10, "euclidean", np.full(len(queries), np.inf))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # All pairs are candidates; their differences alone would be 77 MB.
    assert sum(map(len, found)) == 600_000 and peak < 70e6


def test_a_query_goes_once_to_each_shelf(points):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(50, 6))
    sizes = np.full(50, 100)
    sizes[7] = 2_500
    shelf, chunks = neighbors._shelves(sizes, 1_000)
    assert chunks.tolist() == [1, 3, 1, 1, 1, 1, 1] and (np.diff(shelf) >= 0).all()
    cells = neighbors._Cells(centers, sizes, np.zeros(50), np.full(50, 99.0), shelf, chunks, "euclidean")
    vecs = rng.normal(size=(400, 6))
    home, on = (list(cells.route(vecs, np.arange(400), 3, r)) for r in (None, np.full(400, 50.0)))
    sent = [(k, s) for part in on for k, s in zip(part["key"], part["shelf"])]
    # Nothing is pruned: a row per query and shelf, not per cell, and every cell is asked once.
    assert len(sent) == len(set(sent)) <= 400 * len(chunks)
    for parts in zip(*([[(k, c) for p in side for k, cs in zip(p["key"], p["cells"]) for c in cs]] for side in (home, on))):
        assert sorted(parts[0] + parts[1]) == [(k, c) for k in range(400) for c in range(50)]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_candidates_are_merged_on_the_way(points, metric, monkeypatch):
    import pandas as pd

    vecs, _, _ = points
    monkeypatch.setattr(neighbors, "BLOCK_CELLS", 500)
    q = pd.DataFrame({"key": np.arange(N), "vec": list(vecs), "cells": [np.arange(4)] * N, "radius": np.inf})
    r = pd.DataFrame({"key": np.arange(N), "vec": list(vecs), "cell": np.arange(N) % 4})
    found = neighbors._search_shelf(q, r, K, metric)
    near = {k: g.sort_values(["distance", "neighbor"])["neighbor"].tolist() for k, g in found.groupby("query")}
    assert near == brute(vecs, metric)
