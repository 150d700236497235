"""Tables behind the charts: histogram, density, box plot and scatter data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import numeric_or_null
from cohortlens.operators.describe import QUARTILES
from cohortlens.operators.ranks import (
    attach_groups,
    cumulative_counts,
    group_quantiles,
    long_measures,
    null_safe_join,
    quantile_column,
)


def _range_stats(tall: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tall.groupBy(*keys).agg(
        F.count("value").alias("n_group"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.stddev_samp("value").alias("sd"),
    )


def histogram_table(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    bins: int | str = 20,
    few_groups: bool = False,
) -> DataFrame:
    """Equal-width bins per (group, measure) with counts and densities.

    Bins are right-open but for the last; empty bins are kept. ``bins='auto'`` takes the
    narrower width of the Sturges and Freedman-Diaconis rules per group. The bin index is
    arithmetic on the row, so only bin counts are shuffled.
    """
    keys = [*by, "measure"]
    few = few_groups or not by
    tall = long_measures(df, measures, by)
    stats = _range_stats(tall, keys)
    width = F.col("hi") - F.col("lo")
    if bins == "auto":
        spread = group_quantiles(tall, "value", keys, {"q1": 0.25, "q3": 0.75}, few_groups=few)
        stats = null_safe_join(stats, spread, keys)
        sturges = width / (F.log2("n_group") + 1)
        fd = 2 * (F.col("q3") - F.col("q1")) / F.pow("n_group", F.lit(1 / 3))
        step = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
        count = F.when(step > 0, F.ceil(width / step)).otherwise(F.lit(1))
    else:
        count = F.lit(int(bins))
    flat = F.col("hi") == F.col("lo")
    edges = stats.select(
        *keys,
        "n_group",
        count.cast("int").alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))
    counted = (
        attach_groups(tall, edges, keys, few, "n_group")
        .withColumn("bin", F.least(position, F.col("bins") - 1).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    grid = edges.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")
    )
    return null_safe_join(grid, counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("n_group") * step)).alias("density"),
    )


def kde_table(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    points: int = 200,
    few_groups: bool = False,
) -> DataFrame:
    """Gaussian kernel density on an even grid over each group's range.

    Scott bandwidth ``sd * n**-0.2``. Equal values are counted first; every distinct
    value then adds to all grid points inside its own task and only the grid sums are
    shuffled.
    """
    keys = [*by, "measure"]
    tall = long_measures(df, measures, by)
    stats = (
        _range_stats(tall, keys)
        .where(F.col("sd") > 0)
        .select(*keys, "n_group", "lo", "hi", (F.col("sd") * F.pow("n_group", F.lit(-0.2))).alias("bw"))
    )
    counted = tall.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    z = (at - F.col("value")) / F.col("bw")
    kernel = F.col("n") * F.exp(-0.5 * z * z) / (F.col("n_group") * F.col("bw") * math.sqrt(2 * math.pi))
    return (
        attach_groups(counted, stats, keys, few_groups or not by, "n_group")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy(*keys, "point")
        .agg(F.max(at).alias("x"), F.sum(kernel).alias("density"))
    )


def kde_binned(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    points: int = 200,
    cells: int = 4096,
    few_groups: bool = False,
) -> DataFrame:
    """The density of ``kde_table`` by linear binning and one convolution of the grid.

    Every value gives its two neighbouring grid nodes their shares of its weight; the nodes' sums, combined
    on the map side, are all that is shuffled. The points then sum the kernel over their group's nodes,
    of which there are ``cells`` + 1 whatever the rows.
    """
    keys = [*by, "measure"]
    tall = long_measures(df, measures, by)
    stats = (
        _range_stats(tall, keys)
        .where(F.col("sd") > 0)
        .select(*keys, "n_group", "lo", "hi", (F.col("sd") * F.pow("n_group", F.lit(-0.2))).alias("bw"))
    )
    place = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(cells)
    low = F.least(F.floor(place), F.lit(cells - 1)).cast("int")
    shares = F.array(
        F.struct(low.alias("node"), (1 - (place - low)).alias("w")), F.struct((low + 1).alias("node"), (place - low).alias("w"))
    )
    spread = attach_groups(tall, stats, keys, few_groups or not by, "n_group").select(
        *keys, "lo", "hi", "bw", F.col("n_group").alias("n"), F.inline(shares)
    )
    same = [F.first(c).alias(c) for c in ("lo", "hi", "bw", "n")]
    nodes = spread.groupBy(*keys, "node").agg(F.sum("w").alias("w"), *same)
    grids = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node", "w")).alias("grid"), *same)
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    shown = grids.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", at)
    step = (F.col("hi") - F.col("lo")) / cells

    def add(total: Column, node: Column) -> Column:
        z = (F.col("x") - F.col("lo") - node["node"] * step) / F.col("bw")
        return total + node["w"] * F.exp(-0.5 * z * z)

    total = F.aggregate("grid", F.lit(0.0), add)
    return shown.select(*keys, "point", "x", (total / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


def boxplot_table(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    whisker: float = 1.5,
    few_groups: bool = False,
) -> DataFrame:
    """Quartiles, whisker ends and outlier count per (group, measure)."""
    keys = [*by, "measure"]
    few = few_groups or not by
    counts = cumulative_counts(long_measures(df, measures, by), "value", keys, {"n": F.lit(1)}, few)
    # Whiskers and outliers follow from the counted values; no row is read again for them.
    fenced = attach_groups(counts.select(*keys, "value", "n"), _fences(counts, keys, whisker), keys, few, "n_group")
    inside = F.col("value").between(F.col("fence_lo"), F.col("fence_hi"))
    return fenced.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("q25").alias("q25"),
        F.max("q50").alias("q50"),
        F.max("q75").alias("q75"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
    )


def boxplot_outliers(
    df: DataFrame,
    measures: Sequence[str],
    ids: Sequence[str],
    by: Sequence[str] = (),
    whisker: float = 1.5,
    few_groups: bool = False,
) -> DataFrame:
    """The rows beyond the whiskers."""
    keys = [*by, "measure"]
    few = few_groups or not by
    tall = long_measures(df, measures, [*ids, *by])
    fences = _fences(cumulative_counts(tall, "value", keys, {"n": F.lit(1)}, few), keys, whisker)
    return (
        attach_groups(tall, fences, keys, few, "n_group")
        .where(~F.col("value").between(F.col("fence_lo"), F.col("fence_hi")))
        .select(*ids, *keys, "value")
    )


def _fences(counts: DataFrame, keys: Sequence[str], whisker: float) -> DataFrame:
    quartiles = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_group"), *[quantile_column(p).alias(q) for q, p in QUARTILES.items()]
    )
    reach = (F.col("q75") - F.col("q25")) * whisker
    return quartiles.select(
        "*",
        (F.col("q25") - reach).alias("fence_lo"),
        (F.col("q75") + reach).alias("fence_hi"),
    )


def scatter_table(df: DataFrame, x: str, y: str, ids: Sequence[str] = ()) -> DataFrame:
    """The (x, y) pairs with both sides known."""
    return df.select(*ids, numeric_or_null(x).alias("x"), numeric_or_null(y).alias("y")).dropna(
        subset=["x", "y"]
    )
