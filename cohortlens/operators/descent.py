"""Smooth convex losses over all rows, minimised by L-BFGS on the driver.

A step sends the weights to the tasks and gets back one value and one gradient, summed by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY, MAX_STEPS, MAX_HALVINGS = 10, 60, 40


def lbfgs(
    value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    tol: float = 1e-7,
    max_steps: int = MAX_STEPS,
) -> np.ndarray:
    """The point at which the gradient has fallen to `tol` of max(1, its first size), or no step improves."""
    x = start.astype(float)
    value, gradient = value_and_gradient(x)
    first = max(1.0, float(np.abs(gradient).max(initial=0.0)))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_steps):
        if float(np.abs(gradient).max(initial=0.0)) <= tol * first:
            break
        direction = -_two_loops(gradient, steps)
        slope = float(direction @ gradient)
        if slope >= 0:
            steps.clear()
            direction, slope = -gradient, -float(gradient @ gradient)
        # Without a curvature the first step is no longer than one.
        length = 1.0 if steps else min(1.0, 1.0 / max(1e-300, float(np.abs(gradient).sum())))
        for _ in range(MAX_HALVINGS):
            new = x + length * direction
            new_value, new_gradient = value_and_gradient(new)
            if new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        moved, turned = new - x, new_gradient - gradient
        if float(moved @ turned) > 1e-12 * float(moved @ moved):
            steps = [*steps, (moved, turned)][-MEMORY:]
        if value - new_value <= 1e-14 * max(1.0, abs(value)):
            x, gradient = new, new_gradient
            break
        x, value, gradient = new, new_value, new_gradient
    return x


def _two_loops(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps suggest."""
    q, back = gradient.copy(), []
    for moved, turned in reversed(steps):
        a = float(moved @ q) / float(moved @ turned)
        back.append(a)
        q -= a * turned
    if steps:
        moved, turned = steps[-1]
        q *= float(moved @ turned) / float(turned @ turned)
    for (moved, turned), a in zip(steps, reversed(back)):
        q += (a - float(turned @ q) / float(moved @ turned)) * moved
    return q


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def blocks(rows: DataFrame) -> RDD:
    """Rows of x (array), y and weight as matrices, one to a batch, for `summed` to read many times.

    They are kept as the workers wrote them: a pass plans no query and converts no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), batch.num_rows)
                z = np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([pa.array([len(z)], pa.int32()), pa.array([z.tobytes()], pa.binary())], names=["n", "z"])

    held = rows.select("x", F.col("y").cast("double"), F.col("weight").cast("double")).mapInArrow(packed, "n int, z binary")
    return held.rdd.map(lambda r: np.frombuffer(bytes(r.z)).reshape(r.n, -1))


def label_extent(blocks: RDD) -> tuple[int, float, float]:
    """The number of rows, and the least and greatest y; NaN if a row has none."""
    found = blocks.map(lambda z: (len(z), float(z[:, -2].min()), float(z[:, -2].max()))).collect()
    if not found:
        return 0, math.nan, math.nan
    rows, least, greatest = np.array(found).T
    return int(rows.sum()), float(least.min()), float(greatest.max())


def summed(blocks: RDD, function: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """`function(x, y, weight)` of each block, a vector of one size, summed over all rows; None without rows.

    A vector of each task reaches the driver, which adds them in the order of the tasks.
    """

    def partial(held: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        total = None
        for z in held:
            own = function(z[:, :-2], z[:, -2], z[:, -1])
            total = own if total is None else total + own
        if total is not None:
            yield total

    total = None
    for own in blocks.mapPartitions(partial).collect():
        total = own if total is None else total + own
    return total
