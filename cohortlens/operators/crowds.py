"""Keys that very many rows share: their rows are spread over tasks instead of going to one.

Keys are first counted by hash bucket, so that tables of distinct keys cost one scan and a few
thousand numbers; only the keys of full buckets are counted one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.columns import as_col

KEY_ROWS = 50_000  # rows of one key that may go to one task
BUCKETS = 4096


@dataclass(frozen=True)
class Crowds:
    """The keys with more rows than one task is to get, and over how many tasks the largest is spread."""

    keys: tuple
    copies: int

    def of(self, key: Column) -> Column:
        known = key.isin([k for k in self.keys if k is not None])
        return F.coalesce(known, F.lit(None in self.keys))


def _bucket(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[as_col(k) for k in key]), F.lit(BUCKETS))


def content_hash(df: DataFrame) -> Column:
    """A hash of the whole row, alike wherever it is recomputed; maps have none and are left out."""
    kinds = [(f.name, getattr(f.dataType, "sqlType", lambda t=f.dataType: t)()) for f in df.schema.fields]
    return F.xxhash64(*[as_col(c) for c, kind in kinds if not isinstance(kind, T.MapType)])


def bucket_rows(df: DataFrame, key: Sequence[str]) -> dict[int, int]:
    """Rows by hash bucket of the key, from one scan."""
    return {r[0]: r[1] for r in df.groupBy(_bucket(key).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}


def full_buckets(rows: Mapping[int, int], key_rows: int) -> list[int]:
    """Buckets that hold more than distinct keys would bring, and a key of ``key_rows`` rows."""
    most = key_rows + 2 * sum(rows.values()) // BUCKETS
    return [b for b, n in rows.items() if n > most]


def crowds(df: DataFrame, key: str, key_rows: int | None = None) -> Crowds:
    """Keys of more than ``key_rows`` rows; at most one for that many rows of the table reaches the driver."""
    key_rows = KEY_ROWS if key_rows is None else key_rows
    full = full_buckets(bucket_rows(df, [key]), key_rows)
    if not full:
        return Crowds((), 1)
    counts = df.where(_bucket([key]).isin(full)).groupBy(as_col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") > key_rows).collect()
    return Crowds(tuple(r[0] for r in found), max((-(-r[1] // key_rows) for r in found), default=1))


def spread_join(many: DataFrame, few: DataFrame, key: str, few_key: str, found: Crowds, how: str = "inner") -> DataFrame:
    """``many`` with the columns of ``few`` but its key; a crowd of ``many`` is spread, and what it joins is copied for each part."""
    on = as_col(key) == as_col(few_key)
    if not found.keys:
        return many.join(few, on, how).drop(few_key)
    part = F.when(found.of(as_col(key)), F.pmod(content_hash(many), F.lit(found.copies))).otherwise(F.lit(0)).cast("int")
    last = F.when(found.of(as_col(few_key)), F.lit(found.copies - 1)).otherwise(F.lit(0))
    left = many.withColumn("__part", part)
    right = few.withColumn("__copy", F.explode(F.sequence(F.lit(0), last)))
    return left.join(right, on & (F.col("__part") == F.col("__copy")), how).drop("__part", "__copy", few_key)
