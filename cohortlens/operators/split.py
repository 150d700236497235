"""Deterministic splits, folds and class weights.

Membership is a function of the row key and a seed: no permutation is drawn, no
data is moved for the plain variants, and a recomputed partition lands in the
same fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import as_col, hash_uniform
from cohortlens.operators.clean import class_counts
from cohortlens.operators.ranks import hashed_positions, key_digest, null_safe_join

MOST_CLASSES = 10_000  # classes whose last test hashes may reach the driver


def is_test(key: str | Column, test_size: float = 0.2, seed: object = 42) -> Column:
    return hash_uniform(key, seed) >= 1.0 - test_size


def train_test_split(
    df: DataFrame, key: str | Column, test_size: float = 0.2, seed: object = 42
) -> tuple[DataFrame, DataFrame]:
    """Split on the key's hash; pass the subject as key to keep its visits together."""
    test = is_test(key, test_size, seed)
    return df.where(~test), df.where(test)


def mark_stratified(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    test_size: float = 0.2,
    seed: object = 42,
    out: str = "is_test",
) -> DataFrame:
    """Flag exactly ``round(test_size * n_c)`` rows of every class as test rows.

    Rows without a class form a class of their own.
    """
    # The class sizes come with the positions: a join on the class would put a class in one task.
    ranked = hashed_positions(df, key, [target], seed, "__position", "__size")
    cut = F.round(F.col("__size") * test_size).cast("long")
    return ranked.withColumn(out, F.col("__position") < cut).drop("__position", "__size")


def _mark_by_hash(df: DataFrame, target: str, key: Sequence[str], test_size: float, seed: object, out: str) -> DataFrame:
    """The rows of ``mark_stratified``, told by the last test hash of their class; no table is shuffled."""
    cuts = _last_tested(df, target, key, test_size, seed)
    if cuts is None:
        return mark_stratified(df, target, key, test_size, seed, out)
    schema = T.StructType([T.StructField(target, df.schema[target].dataType), T.StructField("__last", T.StringType()), T.StructField("__shared", T.LongType())])
    ends = F.broadcast(df.sparkSession.createDataFrame(cuts, schema))
    placed = null_safe_join(df.withColumn("__h", key_digest(key, seed)), ends, [target], "left")
    below = F.coalesce(F.col("__h") <= F.col("__last"), F.lit(False))
    if all(shared is None for *_, shared in cuts):
        return placed.withColumn(out, below).drop("__h", "__last", "__shared")
    # Rows that share a hash on both sides of a cut are the only ones that have to be numbered.
    tied = F.coalesce((F.col("__h") == F.col("__last")) & F.col("__shared").isNotNull(), F.lit(False))
    order = Window.partitionBy(as_col(target), "__h").orderBy(*[as_col(k) for k in key])
    numbered = placed.where(tied).withColumn("__row", F.row_number().over(order))
    marked = placed.where(~tied).withColumn(out, below).unionByName(numbered.withColumn(out, F.col("__row") <= F.col("__shared")).drop("__row"))
    return marked.drop("__h", "__last", "__shared")


def _last_tested(df: DataFrame, target: str, key: Sequence[str], test_size: float, seed: object) -> list[tuple] | None:
    """(class, hash of its last test row, how many rows of that hash are tested, or null for all); None for very many classes.

    Two passes that shuffle no rows: counts by class and hash bucket tell the bucket in which a class is cut, and the
    rows of that bucket, one in 4096, the hash.
    """
    hashed = df.select(as_col(target).alias("__class"), key_digest(key, seed).alias("__h")).withColumn("__bucket", F.substring("__h", 1, 3))
    whole = Window.partitionBy("__class")
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    wanted = F.round(F.sum("__n").over(whole) * test_size).cast("long")
    edges = (
        counts.withColumns({"__base": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__wanted": wanted})
        .where((F.col("__base") < F.col("__wanted")) & (F.col("__wanted") <= F.col("__base") + F.col("__n")))
        .select("__class", "__bucket", (F.col("__wanted") - F.col("__base")).alias("__need"))
    )
    found = edges.limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        return None
    ends = F.broadcast(df.sparkSession.createDataFrame(found, edges.schema))
    near = null_safe_join(hashed, ends, ["__class", "__bucket"]).groupBy("__class", "__h").agg(F.count(F.lit(1)).alias("__n"), F.first("__need").alias("__need"))
    above = whole.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    last = near.withColumn("__left", F.col("__need") - F.coalesce(F.sum("__n").over(above), F.lit(0))).where((F.col("__left") > 0) & (F.col("__left") <= F.col("__n")))
    return [(r[0], r[1], r[2]) for r in last.select("__class", "__h", F.when(F.col("__left") < F.col("__n"), F.col("__left"))).collect()]


def stratified_split(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    test_size: float = 0.2,
    seed: object = 42,
) -> tuple[DataFrame, DataFrame]:
    """Class proportions kept exactly; classes too small to share stay in train.

    Two passes find the last test hash of each class, after which both parts are filters of the table.
    """
    marked = _mark_by_hash(df, target, key, test_size, seed, "__test")
    return (
        marked.where(~F.col("__test")).drop("__test"),
        marked.where(F.col("__test")).drop("__test"),
    )


def hash_order(df: DataFrame, target: str, key: Sequence[str], seed: object = 42) -> DataFrame:
    """Fix partitioning and row order, on which the tree learners' random draws depend, by class and hash."""
    placed = df.withColumn("__h", key_digest(key, seed)).withColumn("__bucket", F.substring("__h", 1, 3))
    dealt = placed.repartition(as_col(target), F.col("__bucket"))
    return dealt.sortWithinPartitions(as_col(target), "__bucket", "__h", *[as_col(k) for k in key]).drop("__h", "__bucket")


def kfold(key: str | Column, k: int = 5, seed: object = 42) -> Column:
    """Fold number 0..k-1 from the key's hash."""
    return F.floor(hash_uniform(key, seed) * k).cast("int")


def stratified_kfold(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    k: int = 5,
    seed: object = 42,
    out: str = "fold",
) -> DataFrame:
    """Folds whose class counts differ by at most one row."""
    ranked = hashed_positions(df, key, [target], seed, "__position")
    return ranked.withColumn(out, F.pmod("__position", F.lit(k)).cast("int")).drop("__position")


def min_class_count(df: DataFrame, target: str) -> int:
    """Size of the smallest class; one number reaches the driver."""
    return class_counts(df, target).agg(F.min("n").alias("m")).first().m or 0


def choose_folds(smallest: int, rule: str = "steps") -> int:
    """Fold count allowed by the smallest class.

    ``steps``: 5, 3 or 2; ``capped3``: at most 3; ``capped5``: 5 lowered to the class size.
    """
    if rule == "steps":
        return 5 if smallest >= 5 else 3 if smallest >= 3 else 2
    if rule == "capped3":
        return min(3, smallest) if smallest > 1 else 2
    if rule == "capped5":
        return 5 if smallest >= 5 else max(smallest, 2)
    raise ValueError(f"unknown rule {rule!r}")


def balanced_weights(df: DataFrame, target: str, out: str = "class_weight") -> DataFrame:
    """Attach ``n / (K * n_class)`` to every row with a known class."""
    counts = class_counts(df.where(as_col(target).isNotNull()), target)
    n, k = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    weights = counts.select(target, (F.lit((n or 0) / (k or 1)) / F.col("n")).alias(out))
    # One row per class; a shuffle by class would put a class in one task.
    return df.join(F.broadcast(weights), target)
