"""Registered queries over leaf-wise boosting, softmax boosting and bagged forests, next to their SQL.

SQL unrolls a step on a feature of few values: counts and sums by value, running totals, the best cut.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import split
from cohortlens.operators.boosting import (
    BaggedForestRegressor,
    LeafBoostRegressor,
    SoftmaxBoostClassifier,
    bag_weight,
    poisson_steps,
)
from cohortlens.operators.models import fit_cached
from cohortlens.plans.standins import FLAT, U, R, cte, flat, query, round_all

_RATE, _CLASSES, _TREES = 0.5, 5, 3

# Five classes by the rating's steps of two.
_CLASS = "CASE WHEN rating > 8 THEN 4 WHEN rating > 6 THEN 3 WHEN rating > 4 THEN 2 WHEN rating > 2 THEN 1 ELSE 0 END"
_ROWS = f"rows AS (SELECT key, discount AS x, y, {_CLASS} AS c, {U('key', 42)} AS u FROM flat)"


def _rows(spark: SparkSession, sf: str, label: str) -> tuple[DataFrame, DataFrame]:
    rows = flat(spark, sf).withColumn("c", F.expr(_CLASS).cast("double"))
    assembled = VectorAssembler(inputCols=["discount"], outputCol="features").transform(rows)
    return split.train_test_split(assembled.select("key", "features", F.col(label).alias("label")), "key")


def _best(name: str, values: str) -> str:
    """The best cut of a relation (x, n, s) by squared error, as a one-row relation (cut, left and right sums)."""
    return (
        f"{name}_c AS (SELECT x, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER () AS nt, sum(s) OVER () AS st FROM {values} "
        "WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)), "
        f"{name} AS MATERIALIZED (SELECT x AS cut, nl, sl, nt - nl AS nr, st - sl AS sr FROM {name}_c WHERE nl > 0 AND nl < nt "
        "ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, x LIMIT 1)"
    )


_LEAF_WISE = [
    _ROWS,
    "f0 AS MATERIALIZED (SELECT avg(y) AS f0 FROM rows WHERE u < 0.8)",
    "v AS MATERIALIZED (SELECT x, count(*)::DOUBLE AS n, sum(y - f0) AS s FROM rows, f0 WHERE u < 0.8 GROUP BY x)",
    _best("b0", "v"),
    "sides AS (SELECT v.*, x <= cut AS low FROM v, b0)",
    "c1 AS (SELECT low, x, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER p AS nt, sum(s) OVER p AS st FROM sides "
    "WINDOW o AS (PARTITION BY low ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY low))",
    # Of the two leaves, the one whose best cut gains more is split.
    "b1 AS MATERIALIZED (SELECT low AS side, x AS cut1 FROM c1 WHERE nl < nt ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt DESC LIMIT 1)",
    "leaves AS (SELECT x, n, s, low, low = side AND x <= cut1 AS deep FROM sides, b1)",
    "means AS (SELECT low, deep, sum(s) / sum(n) AS m FROM leaves GROUP BY ALL)",
]


@query(
    "gbt_leaf_wise",
    cte(FLAT, *_LEAF_WISE) + f"SELECT key, {R(f'f0 + {_RATE} * m')} AS prediction FROM rows JOIN leaves USING (x) JOIN means USING (low, deep), f0 WHERE u >= 0.8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf, "y")
    model = fit_cached(LeafBoostRegressor("key", 1, _RATE, num_leaves=3, min_leaf=1), train)
    return round_all(model.transform(test).select("key", "prediction"))


def _class_step(k: int) -> list[str]:
    """The tree of class k on the gradients of the class shares, and its leaf values."""
    newton = f"{_CLASSES - 1} / {_CLASSES}.0::DOUBLE * {{s}} / ({{n}} * p{k} * (1 - p{k}))"
    return [
        f"v{k} AS (SELECT x, count(*)::DOUBLE AS n, sum((c = {k})::INT - p{k}) AS s FROM rows, shares WHERE u < 0.8 GROUP BY x)",
        _best(f"t{k}", f"v{k}"),
        f"w{k} AS MATERIALIZED (SELECT cut AS cut{k}, ln(p{k}) + {_RATE} * {newton.format(s='sl', n='nl')} AS lo{k}, "
        f"ln(p{k}) + {_RATE} * {newton.format(s='sr', n='nr')} AS hi{k} FROM t{k}, shares)",
    ]


_SOFTMAX = [
    _ROWS,
    "shares AS MATERIALIZED (SELECT " + ", ".join(f"avg((c = {k})::INT) AS p{k}" for k in range(_CLASSES)) + " FROM rows WHERE u < 0.8)",
    *[part for k in range(_CLASSES) for part in _class_step(k)],
    "odds AS (SELECT key, " + ", ".join(f"exp(CASE WHEN x <= cut{k} THEN lo{k} ELSE hi{k} END) AS e{k}" for k in range(_CLASSES))
    + " FROM rows, " + ", ".join(f"w{k}" for k in range(_CLASSES)) + " WHERE u >= 0.8)",
]
_ALL = " + ".join(f"e{k}" for k in range(_CLASSES))


@query(
    "gbt_softmax_groups",
    cte(FLAT, *_SOFTMAX) + "SELECT key, " + ", ".join(f"{R(f'e{k} / ({_ALL})')} AS p{k}" for k in range(_CLASSES)) + " FROM odds",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf, "c")
    model = fit_cached(SoftmaxBoostClassifier("key", 1, _RATE, num_leaves=2, min_leaf=1), train)
    scored = model.transform(test).withColumn("p", vector_to_array("probability"))
    return round_all(scored.select("key", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(_CLASSES))))


def _weight(tree: int) -> str:
    u = U("key", f"42-{tree}")
    return " + ".join(f"({u} >= {step!r})::INT" for step in poisson_steps())


@query("bag_weights", cte(FLAT) + "SELECT key, " + ", ".join(f"CAST({_weight(t)} AS INT) AS w{t}" for t in range(_TREES)) + " FROM flat")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("key", *(bag_weight("key", t).alias(f"w{t}") for t in range(_TREES)))


def _bagged_tree(t: int) -> list[str]:
    return [
        f"v{t} AS (SELECT x, sum(w{t})::DOUBLE AS n, sum(w{t} * y) AS s FROM bagged GROUP BY x)",
        _best(f"t{t}", f"v{t}"),
        f"m{t} AS MATERIALIZED (SELECT cut AS cut{t}, sl / nl AS lo{t}, sr / nr AS hi{t} FROM t{t})",
    ]


def _any(part: str, between: str = " + ") -> str:
    return between.join(part.format(t=t) for t in range(_TREES))


_FOREST = [
    _ROWS,
    "bagged AS MATERIALIZED (SELECT key, x, y, " + ", ".join(f"{_weight(t)} AS w{t}" for t in range(_TREES)) + " FROM rows WHERE u < 0.8)",
    *[part for t in range(_TREES) for part in _bagged_tree(t)],
]
_VOTED = (
    "voted AS (SELECT y, (" + _any("(w{t} = 0)::INT * CASE WHEN x <= cut{t} THEN lo{t} ELSE hi{t} END") + ") / nullif(" + _any("(w{t} = 0)::INT")
    + ", 0) AS p FROM bagged, " + _any("m{t}", ", ") + ")"
)


@query(
    "out_of_bag_r2",
    cte(FLAT, *_FOREST, _VOTED) + f"SELECT count(*) AS n, {R('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2 FROM voted WHERE p IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _rows(spark, sf, "y")
    forest = fit_cached(BaggedForestRegressor("key", _TREES, 1), train).forest
    return round_all(spark.createDataFrame([(forest.out_of_bag_rows, forest.out_of_bag_r2)], "n long, r2 double"))


@query(
    "bagged_forest_stumps",
    cte(FLAT, *_FOREST) + f"SELECT key, {R('(' + _any('CASE WHEN x <= cut{t} THEN lo{t} ELSE hi{t} END') + f') / {_TREES}')} AS prediction FROM rows, "
    + _any("m{t}", ", ") + " WHERE u >= 0.8",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf, "y")
    model = fit_cached(BaggedForestRegressor("key", _TREES, 1), train)
    return round_all(model.transform(test).select("key", "prediction"))
