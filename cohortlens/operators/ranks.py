"""Distributed ranks: the shared base of rank tests, ECDFs, AUC and quantiles.

A window over a whole measure would pull it into one task. Instead values are
first counted (so a value that fills a third of the table becomes one row), cut
into buckets at approximate quantiles of the distinct values, accumulated per
bucket, and shifted by the totals of the buckets below.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col, numeric_or_null

BUCKET_BITS = 8  # 256 buckets per group at first
PART_ROWS = 1_000_000  # rows of a bucket beyond which it is cut into parts
HOT_ROWS = 1_000_000  # rows beyond which a group's value counts are spread over several tasks
HOT_GROUPS, SALTS = 1_000, 32  # the largest groups that are spread, and over how many tasks
KEEP_VALUES, KEEP_COLUMNS = 200_000, 200  # values that may reach the driver, columns handled together


def long_measures(
    df: DataFrame, measures: Sequence[str], ids: Sequence[str] = (), name: str = "measure"
) -> DataFrame:
    """One row per (row, measure) with a non-null double ``value``."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias(name), numeric_or_null(m).alias("value")) for m in measures]
    )
    return df.select(*[as_col(c) for c in ids], F.inline(pairs)).where(F.col("value").isNotNull())


def cumulative_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    tallies: Mapping[str, Column],
    few_groups: bool = False,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """One row per (group, distinct value) with running tallies.

    For each tally ``t`` the output has ``t`` (at this value), ``t_before``
    (strictly below it) and ``t_total`` (whole group); ``center`` is a value near the group's
    median, to shift sums by. Null groups are groups. The bucket bounds are a sketch
    of the rows, combined on the map side. Values are counted before they are shuffled;
    bucket totals and running counts both read that one shuffle. A group of more than
    ``PART_ROWS`` rows a bucket has its buckets cut into evenly wide parts, as many as its rows
    ask for, so what a task sorts does not grow with the table.

    ``few_groups`` says that the number of groups is bounded by the plan (columns,
    listed timepoints) and not by the data; only then the per-group bounds and
    bucket totals are broadcast.
    """
    if not by:
        whole = df.withColumn("__all", F.lit(1))
        return cumulative_counts(whole, value, ["__all"], tallies, True, bits).drop("__all")
    small = F.broadcast if few_groups and bits <= 12 else (lambda d: d)
    keys, names, buckets = list(by), list(tallies), 1 << bits
    rows = df.where(as_col(value).isNotNull()).select(
        *[as_col(k) for k in keys],
        as_col(value).alias("value"),
        *[t.cast("long").alias(n) for n, t in tallies.items()],
    )
    cuts = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    sketch = F.expr(f"percentile_approx(value, array({cuts}), {40 * buckets})")
    bounds = rows.groupBy(*keys).agg(
        sketch.alias("__bounds"), F.count(F.lit(1)).alias("__rows"), F.min("value").alias("__lo"), F.max("value").alias("__hi")
    ).withColumn("__parts", F.ceil(F.col("__rows") / F.lit(buckets * PART_ROWS)).cast("double"))
    counted = rows.groupBy(*keys, "value").agg(*[F.sum(n).alias(n) for n in names])
    placed = _place(attach_groups(counted, bounds, keys, few_groups and bits <= 12), bits)
    group = Window.partitionBy(*keys)
    below = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__bucket")
        .agg(*[F.sum(n).alias(f"__{n}") for n in names])
        .select(
            *keys,
            "__bucket",
            *[F.coalesce(F.sum(f"__{n}").over(below), F.lit(0)).alias(f"__{n}_base") for n in names],
            *[F.sum(f"__{n}").over(group).alias(f"{n}_total") for n in names],
        )
    )
    inside = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.withColumns({f"__{n}_run": F.sum(n).over(inside) for n in names})
    return null_safe_join(running, small(offsets), [*keys, "__bucket"]).select(
        *keys,
        "value",
        *names,
        *[(F.col(f"__{n}_base") + F.col(f"__{n}_run") - F.col(n)).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names],
        "center",
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys whose nulls equal each other; the left side's keys stay."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = functools.reduce(lambda a, b: a & b, [as_col(k).eqNullSafe(F.col(f"`__r_{k}`")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def attach_groups(rows: DataFrame, stats: DataFrame, keys: Sequence[str], few_groups: bool, size: str = "__rows") -> DataFrame:
    """Give every row (with a ``value``) the numbers of its group.

    With ``few_groups``, bounded by the plan, they are broadcast. Otherwise the rows of the
    largest groups, by the column ``size`` of ``stats``, are dealt over several tasks by their
    value; the list of those groups is bounded by its limit and so can be broadcast.
    """
    if few_groups:
        return null_safe_join(rows, F.broadcast(stats.drop("__rows")), keys)
    largest = stats.where(F.col(size) >= HOT_ROWS).orderBy(F.desc(size)).limit(HOT_GROUPS)
    hot = F.broadcast(largest.select(*[as_col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))

    def mark(df: DataFrame) -> DataFrame:
        on = functools.reduce(lambda a, b: a & b, [as_col(k).eqNullSafe(F.col(f"`__h_{k}`")) for k in keys])
        return df.join(hot, on, "left").drop(*[f"__h_{k}" for k in keys])

    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("value"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.sequence(F.lit(0), F.when(F.col("__hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    left = mark(rows).withColumn("__salt", salt).drop("__hot")
    right = mark(stats.drop("__rows")).withColumn("__salt", F.explode(copies)).drop("__hot")
    return null_safe_join(left, right, [*keys, "__salt"]).drop("__salt")


def _place(df: DataFrame, bits: int) -> DataFrame:
    """Number of bounds below the value, by binary search, and with it the part of that bucket."""
    steps = ", ".join(str(1 << b) for b in reversed(range(bits)))
    place = F.expr(
        f"coalesce(aggregate(array({steps}), 0, (pos, step) -> "
        "if(value > element_at(__bounds, pos + step), pos + step, pos)), 0)"
    )
    center = F.element_at("__bounds", 1 << (bits - 1))
    found = df.withColumns({"__place": place, "center": center})
    low = F.coalesce(F.get("__bounds", F.col("__place") - 1), F.col("__lo"))
    high = F.coalesce(F.get("__bounds", F.col("__place")), F.col("__hi"))
    # Rises with the value; where the ends are not finite, all of a bucket is its last part.
    share = F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(F.lit(0.0))
    part = F.least(F.floor(F.nanvl(share, F.lit(1.0)) * F.col("__parts")), F.col("__parts").cast("long") - 1)
    bucket = F.col("__place").cast("long") * (1 << 40) + F.when(F.col("__parts") > 1, part).otherwise(F.lit(0))
    return found.withColumn("__bucket", bucket).drop("__bounds", "__place", "__lo", "__hi", "__parts")


def average_ranks(df: DataFrame, value: str, by: Sequence[str], few_groups: bool = False) -> DataFrame:
    """Average rank (ties share the mean) of every distinct value in its group."""
    cum = cumulative_counts(df, value, by, {"n": F.lit(1)}, few_groups)
    return cum.select(
        *by, "value", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


def quantile_column(p: float, tally: str = "n") -> Column:
    """Linear-interpolated quantile as an aggregate over ``cumulative_counts`` rows.

    The two order statistics around position ``p * (total - 1)`` are the values
    whose running count covers them.
    """
    n, before, total = F.col(tally), F.col(f"{tally}_before"), F.col(f"{tally}_total")
    position = F.lit(float(p)) * (total - 1)

    def order_statistic(index: Column) -> Column:
        return F.max(F.when((before <= index) & (index < before + n), F.col("value")))

    lo, hi = order_statistic(F.floor(position)), order_statistic(F.ceil(position))
    weight = F.max(position - F.floor(position))
    return lo + (hi - lo) * weight


def group_quantiles(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    probabilities: Mapping[str, float],
    exact: bool = True,
    few_groups: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles per group, one column per entry of ``probabilities``.

    Exact ones interpolate linearly and never hold a group's values in one task
    (``percentile`` would). ``exact=False`` is a one-pass sketch without shuffling values.
    """
    if exact:
        cum = cumulative_counts(df, value, by, {"n": F.lit(1)}, few_groups)
        return cum.groupBy(*by).agg(
            *[quantile_column(p).alias(name) for name, p in probabilities.items()]
        )
    sketch = F.percentile_approx(as_col(value), list(probabilities.values()), accuracy)
    return (
        df.groupBy(*[as_col(b) for b in by])
        .agg(sketch.alias("__q"))
        .select(*by, *[F.col("__q")[i].alias(name) for i, name in enumerate(probabilities)])
    )


def select_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    p: float,
    accuracy: int = 10_000,
    keep: int = KEEP_VALUES,
) -> dict[str, float]:
    """One exact quantile of each expression without shuffling its values.

    A first pass brackets the wanted order statistics of all columns with a sketch. Where
    the bracket is sure to hold few values, the next pass counts those and what lies below.
    Larger ones are counted and sketched again, shrinking about a thousandfold per round.
    At most about ``keep`` distinct values of all columns together reach the driver; many
    columns are handled in blocks. Columns without a value are left out of the result.
    """
    if len(columns) > KEEP_COLUMNS:
        entries, out = list(columns.items()), {}
        for at in range(0, len(entries), KEEP_COLUMNS):
            out |= select_quantiles(df, dict(entries[at : at + KEEP_COLUMNS]), p, accuracy, keep)
        return out
    if not columns:
        return {}
    keep = max(1, keep // len(columns))
    names = {f"q{i}": name for i, name in enumerate(columns)}
    values = df.select(*[c.cast("double").alias(a) for a, c in zip(names, columns.values())])

    def sketch(alias: str, lo: float, hi: float) -> Column:
        cut = F.percentile_approx(alias, [max(0.0, lo), min(1.0, hi)], accuracy)
        return cut.alias(f"{alias}_cut")

    slack = 4.0 / accuracy
    first = values.agg(
        *[
            e
            for a in names
            for e in (
                F.count(a).alias(f"{a}_n"),
                F.min(a).alias(f"{a}_lo"),
                F.max(a).alias(f"{a}_hi"),
                sketch(a, p - slack, p + slack),
            )
        ]
    ).first()
    targets = {a: _Bracket.start(first, a, p) for a in names if first[f"{a}_n"]}
    cuts = {a: first[f"{a}_cut"] for a, t in targets.items() if t.wide(keep)}
    ready = {a: (t.lo, t.hi) for a, t in targets.items() if a not in cuts}
    while cuts:
        # The sketch is off by at most 1/accuracy on either side of its slack.
        likely = {a for a in cuts if targets[a].inside * (2 * slack + 4 / accuracy) < keep / 2}
        ready |= {a: cuts.pop(a) for a in likely}
        if not cuts:
            break
        counted = values.agg(
            *[
                e
                for a, (lo, hi) in cuts.items()
                for e in (
                    F.count_if(F.col(a) < lo).alias(f"{a}_below"),
                    F.count_if(F.col(a).between(lo, hi)).alias(f"{a}_inside"),
                )
            ]
        ).first()
        moved = {
            a
            for a, (lo, hi) in cuts.items()
            if targets[a].shrink(lo, hi, counted[f"{a}_below"], counted[f"{a}_inside"])
        }
        ready |= {a: (targets[a].lo, targets[a].hi) for a in moved if not targets[a].wide(keep)}
        moved -= ready.keys()
        cuts = {}
        if moved:
            within = [
                F.when(F.col(a).between(targets[a].lo, targets[a].hi), F.col(a)).alias(a) for a in moved
            ]
            again = values.select(*within).agg(*[sketch(a, *targets[a].shares(slack)) for a in moved])
            row = again.first()
            cuts = {a: row[f"{a}_cut"] for a in moved}

    result: dict[str, float] = {}
    if ready:
        # Values below a bracket count as one, those above it are left out.
        clipped = [
            F.when(F.col(a) < lo, F.lit(-math.inf)).when(F.col(a) <= hi, F.col(a)).alias(a)
            for a, (lo, hi) in ready.items()
        ]
        counts = (
            long_measures(values.select(*clipped), list(ready))
            .groupBy("measure", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        limit = (keep + 1) * len(ready)
        near = counts.limit(limit + 1).toPandas()
        if len(near) <= limit:
            for a, found in near.groupby("measure"):
                picked = targets[a].pick(found.sort_values("value"))
                result |= {} if picked is None else {a: picked}
    missed = [a for a in targets if a not in result]
    if missed:
        # A sketch that misled, or values it cannot separate: rank them all.
        tall = long_measures(values, missed)
        ranked = group_quantiles(tall, "value", ["measure"], {"q": p}, few_groups=True).collect()
        result |= {r.measure: float(r.q) for r in ranked}
    return {names[a]: v for a, v in result.items()}


def select_near(df: DataFrame, column: Column, p: float, n: int, lo: float, hi: float, keep: int = KEEP_VALUES) -> float | None:
    """The quantile of ``n`` known values in one job, if it lies between ``lo`` and ``hi`` with few values about it; else None."""
    value = column.cast("double")
    clipped = F.when(value < lo, F.lit(-math.inf)).when(value <= hi, value)
    counts = df.select(clipped.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    near = counts.limit(keep + 1).toPandas()
    return None if len(near) > keep else _Bracket(p * (n - 1), lo, hi, 0, n).pick(near.sort_values("value"))


@dataclass
class _Bracket:
    """Interval known to hold two neighbouring order statistics, with counts below and inside."""

    position: float
    lo: float
    hi: float
    below: int
    inside: int

    @classmethod
    def start(cls, row: Row, alias: str, p: float) -> _Bracket:
        n = row[f"{alias}_n"]
        return cls(p * (n - 1), row[f"{alias}_lo"], row[f"{alias}_hi"], 0, n)

    def wide(self, keep: int) -> bool:
        return self.lo < self.hi and self.inside > keep

    def shares(self, slack: float) -> tuple[float, float]:
        low, high = math.floor(self.position), math.ceil(self.position)
        return (low - self.below) / self.inside - slack, (high - self.below + 1) / self.inside + slack

    def shrink(self, lo: float, hi: float, below: int, inside: int) -> bool:
        """Move to a narrower interval if it still covers both; false if there is no progress."""
        covers = below <= math.floor(self.position) and math.ceil(self.position) < below + inside
        if not covers or inside >= self.inside:
            return False
        self.lo, self.hi, self.below, self.inside = lo, hi, below, inside
        return True

    def pick(self, counts: pd.DataFrame) -> float | None:
        """Interpolate between the two order statistics of sorted (value, n) rows.

        None if the counted values do not cover both of them.
        """
        value, upto = counts["value"].to_numpy(), counts["n"].cumsum().to_numpy()
        low, high = math.floor(self.position), math.ceil(self.position)
        if not len(upto) or high >= upto[-1]:
            return None
        x, y = value[np.searchsorted(upto, [low, high], side="right")]
        return float(x + (y - x) * (self.position - low)) if x > -math.inf else None


def key_digest(key: Sequence[str], seed: object) -> Column:
    """The hash by which rows are put in order."""
    text = F.concat_ws("|", *[as_col(k).cast("string") for k in key])
    return F.md5(F.concat(text, F.lit(f"-{seed}")))


def hashed_positions(
    df: DataFrame, key: Sequence[str], by: Sequence[str], seed: object, out: str = "position", size: str | None = None
) -> DataFrame:
    """Zero-based position of every row in the hash order of its group, and its group's rows as ``size`` if named.

    The hash spreads each group evenly over 4096 sub-buckets, so even a class with
    most of the rows is numbered by many tasks. ``key`` must identify a row.
    """
    placed = df.withColumn("__h", key_digest(key, seed)).withColumn("__bucket", F.substring("__h", 1, 3))
    groups = [as_col(b) for b in by]
    below = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.groupBy(*groups, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *groups,
            "__bucket",
            F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__base"),
            *([F.sum("__n").over(Window.partitionBy(*groups)).alias(size)] if size else []),
        )
    )
    order = Window.partitionBy(*groups, "__bucket").orderBy("__h", *[as_col(k) for k in key])
    return (
        null_safe_join(placed.withColumn("__row", F.row_number().over(order)), offsets, [*by, "__bucket"])
        .withColumn(out, F.col("__base") + F.col("__row") - 1)
        .drop("__h", "__bucket", "__row", "__base")
    )
