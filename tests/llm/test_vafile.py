import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm.vafile import exact_top_k, integer_vectors


def brute(rows, every, k):
    out = []
    for i, (key, vector) in enumerate(rows):
        if key is None or vector is None or key % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, other)), other_key)
            for j, (other_key, other) in enumerate(rows)
            if j != i and other_key is not None and other is not None and len(other) == len(vector)
        )
        out += [(key, rank + 1, other, -score) for rank, (score, other) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("spread", "block"), [(3, 4096), (200, 4096), (200, 3), (1 << 27, 4096)])
def test_equals_brute_force(spark, spread, block):
    rng = random.Random(spread + block)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(1000, rows[0][1]), (1000, rows[0][1]), (7, None), (None, [1] * 6)]
    rows += [(2000, [1, 2]), (2010, [3, 4]), (3000, []), (3001, [])]
    table = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, vector array<bigint>, row string").repartition(3)
    got = exact_top_k(table, "vec_id", "vector", F.col("vec_id") % 10 == 0, 5, block).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 10, 5)


def test_fewer_candidates_than_wanted_and_no_queries(spark):
    table = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, vector array<bigint>")
    got = exact_top_k(table, "vec_id", "vector", F.col("vec_id") == 0, 5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 11)]
    assert exact_top_k(table, "vec_id", "vector", F.lit(False), 5).count() == 0
    assert exact_top_k(table.limit(0), "vec_id", "vector", F.lit(True), 5).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1e30, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["v"] for r in table.select("vec_id", integer_vectors(table, "embedding").alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: None}


def test_large_finite_components_take_part(spark):
    rows = [(1, [2.0**20, 1.0]), (2, [-(2.0**22), 0.5]), (3, [1.0, 2.0**42]), (4, [0.25, -1.0]), (5, [2.0**26, 0.0]), (6, [float("inf"), 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = table.select("vec_id", integer_vectors(table, "embedding").alias("w"))
    own = {key: [int(x * 256) for x in vector] for key, vector in rows[:-1]}
    # The third's score with itself would not fit 64 bits.
    asks = [1, 3, 4]
    got = exact_top_k(whole, "vec_id", "w", F.col("vec_id").isin(asks), 4).collect()
    want = []
    for q in asks:
        scores = sorted((-sum(a * b for a, b in zip(own[q], own[c])), c) for c in own if c != q)
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == want
    large = spark.createDataFrame([(1, [1 << 48]), (2, [1 << 48])], "vec_id long, w array<bigint>")
    with pytest.raises(Exception, match="a score does not fit 64 bits"):
        exact_top_k(large, "vec_id", "w", F.col("vec_id") == 1, 4).collect()
    with pytest.raises(Exception, match="a scaled component does not fit 64 bits"):
        spark.createDataFrame([([1e30],)], "e array<double>").select(integer_vectors(table, "e", strict=True)).collect()
