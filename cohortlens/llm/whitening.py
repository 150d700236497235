"""Embedding whitening from exact integer cross-products of bit-sliced dimensions.

Each dimension of a block of rows, shifted to start at zero, is cut into bit planes, and a plane's bits
are packed across rows into 64-bit words. A product of two dimensions summed over the rows is then a
sum of popcounts of planes anded word by word, weighted by powers of two, and exact. The
sums of all blocks meet in Spark; the driver gets one row for each pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.shipping import ship_package

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
# Rows packed together; a multiple of 64.
BLOCK_ROWS = 8192
# Words of which all dimensions' planes are anded at once.
_CHUNK = 1 << 21


def whole_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and holds neither nulls nor non-finite entries."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(entries.isNotNull() & finite)


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of every entry, one row for each vector."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(SCALE * entries)
    if len(scaled) and not np.abs(scaled).max() < 2.0**62:
        raise ValueError("a scaled entry does not fit a long")
    return scaled.astype(np.int64).reshape(len(column), int(sizes[0]) if len(sizes) else 0) + OFFSET


def bit_planes(values: np.ndarray) -> list[np.ndarray]:
    """Planes of a matrix of non-negative integers, lowest first: dimensions x words, a bit for each row."""
    if not values.size:
        return []
    words = -(-len(values) // 64)
    planes = []
    for bit in range(int(values.max()).bit_length()):
        ones = np.zeros((values.shape[1], 64 * words), np.uint8)
        ones[:, : len(values)] = ((values >> bit) & 1).T
        planes.append(np.packbits(ones, axis=1, bitorder="little").view(np.uint64))
    return planes


def _common_ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many rows have both bits, for every pair of a dimension of `a` and one of `b`."""
    dims, words = a.shape
    out = np.empty((dims, dims), np.int64)
    step = max(1, _CHUNK // max(1, dims * words))
    for at in range(0, dims, step):
        out[at : at + step] = np.bitwise_count(a[at : at + step, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def scatter(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of the columns of an integer matrix, as Python integers."""
    dims = values.shape[1]
    low = values.min(axis=0) if len(values) else np.zeros(dims, np.int64)
    planes = bit_planes(values - low)
    products = np.zeros((dims, dims), object)
    sums = np.zeros(dims, object)
    for p, a in enumerate(planes):
        sums += np.bitwise_count(a).sum(axis=1, dtype=np.int64).astype(object) << p
        for q in range(p + 1):
            ones = _common_ones(a, planes[q]).astype(object) << (p + q)
            products += ones if p == q else ones + ones.T
    # Undo the shift: the sum of (y_i + l_i) * (y_j + l_j).
    base = low.astype(object)
    products += np.outer(sums, base) + np.outer(base, sums) + len(values) * np.outer(base, base)
    return sums + len(values) * base, products


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (dims, i, j, n, product) for each pair i <= j of a task's rows; i = -1 stands for the sum of dimension j."""
    rows, total, dims = 0, None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            values = _integers(batch.column(0).slice(at, BLOCK_ROWS))
            sums, products = scatter(values)
            if total is None:
                total, dims = [sums, products], values.shape[1]
            elif dims != values.shape[1]:
                raise ValueError(f"vectors of different lengths: {dims}, {values.shape[1]}")
            else:
                total = [total[0] + sums, total[1] + products]
            rows += len(values)
    if total is None or not dims:
        return
    i, j = np.triu_indices(dims)
    entries = [*total[0].tolist(), *total[1][i, j].tolist()]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(entries), dims), pa.int32()),
            pa.array(np.concatenate([np.full(dims, -1), i]), pa.int32()),
            pa.array(np.concatenate([np.arange(dims), j]), pa.int32()),
            pa.array(np.full(len(entries), rows), pa.int64()),
            pa.array([str(x) for x in entries], pa.string()),
        ],
        names=["dims", "i", "j", "n", "product"],
    )


class Whitening:
    """The fit: rows `n`, sums, components, eigenvalues and the covariance's exact numerators."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int):
        dims = len(sums)
        self.n, self.sums = n, sums
        # n * n * covariance, centred as integers.
        numerators = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
        covariance = np.array([[float(Fraction(x, n * n)) for x in row] for row in numerators])
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        # What has no spread but rounding can't be scaled to one.
        order = order[values[order] > dims * np.finfo(float).eps * max(values.max(), 0.0)][:components]
        self.values, self.directions = values[order], vectors[:, order]
        self.explained = self.values / (float(Fraction(sum(numerators[i][i] for i in range(dims)), n * n)) or 1.0)
        self.scaled = self.directions / np.sqrt(self.values)
        spread = self.scaled.T @ covariance @ self.scaled
        self.identity_error = float(np.abs(spread - np.eye(len(order))).max()) if len(order) else 0.0


def fit_whitening(vectors: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Fitted on every whole vector; None without rows or entries.

    The driver collects one row for each pair of dimensions, whatever the number of vectors.
    """
    ship_package(vectors.sparkSession)
    entries = whole_vectors(vectors, vector).select(F.col(f"`{vector}`").cast("array<double>"))
    partial = entries.mapInArrow(_partials, "dims int, i int, j int, n bigint, product string")
    exact = F.sum(F.col("product").cast("decimal(38,0)")).cast("string").alias("product")
    found = partial.groupBy("dims", "i", "j").agg(F.sum("n").alias("n"), exact).collect()
    if not found:
        return None
    sizes = {r["dims"] for r in found}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    if any(r["product"] is None for r in found):
        raise ValueError("a sum of products does not fit 38 digits")
    dims = sizes.pop()
    sums = [0] * dims
    products = np.zeros((dims, dims), object)
    for r in found:
        if r["i"] < 0:
            sums[r["j"]] = int(r["product"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["product"])
    return Whitening(found[0]["n"], sums, products, components)


def _deviations(values: np.ndarray, n: int, sums: list[int]) -> tuple[list[int], np.ndarray]:
    """Each row's exact sum of (n * x - S)^2, and its x - S / n."""
    sum_of = np.array(sums, object)
    # Small differences to the rounded mean fit a long; else Python's integers take over.
    mean = np.array([s // n for s in sums], object)
    rest = sum_of - n * mean
    near = values - mean.astype(np.int64)
    bound = n * (int(np.abs(near).max()) + 1) if near.size else 0
    if bound * bound * max(1, len(sums)) < 2**63:
        exact = n * near - rest.astype(np.int64)
        deviations = (exact * exact).sum(axis=1).tolist()
    else:
        wide = n * near.astype(object) - rest
        deviations = (wide * wide).sum(axis=1).tolist()
        exact = wide
    return deviations, exact.astype(np.float64) / n


def _project(fit: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = len(fit.values)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(at, BLOCK_ROWS)
            if not some.num_rows or not count:
                continue
            deviations, centred = _deviations(_integers(some.column(1)), fit.n, fit.sums)
            row = pa.array(np.repeat(np.arange(some.num_rows), count))
            every = some.num_rows * count
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0).take(row),
                    pa.array(np.tile(np.arange(1, count + 1), some.num_rows), pa.int32()),
                    pa.array(np.full(every, fit.n), pa.int64()),
                    pa.array([str(x) for x in deviations], pa.string()).take(row),
                    pa.array((centred @ fit.scaled).ravel()),
                    pa.array(np.tile(fit.explained, some.num_rows)),
                    pa.array(np.full(every, fit.identity_error)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """`key` and, by component, `n`, `deviation`, `whitened`, `explained` and `identity_error` of each whole vector.

    Entries become floor(64 * c) + 1000000. Components are numbered from 1 by falling
    variance, and those without any variance (constant dimensions, fewer rows than dimensions) are left
    out, so a table of equal vectors gives no rows. `deviation` is an exact decimal. Vectors that
    are null or hold null or non-finite entries take no part and give no rows; repeated
    rows and null keys are rows like others; other columns are left behind. Vectors of
    different lengths, and entries that no long can hold, are errors.
    """
    outputs = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    if key in outputs:
        raise ValueError(f"rename the key column {key!r}: it has an output's name")
    kind = dict(vectors.dtypes)[key]
    schema = f"key {kind}, component int, n bigint, deviation string, whitened double, explained double, identity_error double"
    fit = fit_whitening(vectors, vector, components)
    if fit is None:
        empty = vectors.sparkSession.createDataFrame([], schema)
    else:
        sent = vectors.sparkSession.sparkContext.broadcast(fit)
        chosen = whole_vectors(vectors, vector).select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>"))
        empty = chosen.mapInArrow(lambda batches: _project(sent.value, batches), schema)
    return empty.select(
        F.col("key").alias(key), "component", "n", F.col("deviation").cast("decimal(38,0)"), "whitened", "explained", "identity_error"
    )
