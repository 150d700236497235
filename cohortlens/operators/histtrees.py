"""Trees grown leaf by leaf from binned histograms.

Features are cut into bins once. A pass over the rows sums gradients, curvatures and weights by leaf, feature and
bin for all leaves it is asked for, in one grouped aggregate; the driver sees only those sums. It
splits the leaf of the greatest gain first. A pass measures the smaller child of every leaf that may still be split
(the other child is the rest of its parent), so a tree costs about as many passes as it is deep.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BINS = 64
PARTITION_ROWS = 50_000  # rows in one partition of a binned table
_MIXER = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Tree:
    """Nodes by number; `feature` is -1 at leaves. Rows with a bin (value) up to the cut (threshold) go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        children = len(self.feature), len(self.feature) + 1
        self.left[node], self.right[node] = children
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [empty, empty]
        return children

    def leaves(self, x: np.ndarray, cuts: list) -> np.ndarray:
        """The leaf of each row of a matrix, whose entries are compared with `cuts`."""
        feature, left, right, limit = (np.array(c) for c in (self.feature, self.left, self.right, cuts))
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            own = node[rows]
            rows = rows[feature[own] >= 0]
            own = node[rows]
            node[rows] = np.where(x[rows, feature[own]] <= limit[own], left[own], right[own])
        return node

    def binned_leaves(self, bins: np.ndarray) -> np.ndarray:
        return self.leaves(bins, self.cut)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x, self.threshold)]


@dataclass(frozen=True)
class Growth:
    """How trees grow: at most `leaves` leaves and `depth` levels (None: any), `min_leaf` rows (by weight) in each leaf.

    With `curved` splits compare G^2 / (H + ridge) of gradients and curvatures, else G^2 / n of gradients alone.
    """

    leaves: int | None = 31
    depth: int | None = None
    min_leaf: float = 1.0
    ridge: float = 0.0
    curved: bool = False
    min_gain: float = 1e-9


def features_array(df: DataFrame, features: str) -> Column:
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    return vector_to_array(features) if vector else F.col(features).cast("array<double>")


def bin_edges(df: DataFrame, features: str, bins: int = MAX_BINS) -> tuple[list[list[float]], int]:
    """Values up to which each bin of each feature goes, from map-side combined sketches, and the number of rows.

    A feature of few values has an edge at each that makes up a bin's share of the rows.
    """
    shares = ", ".join(f"{i / bins}D" for i in range(1, bins))
    entries = df.select(F.posexplode(features_array(df, features)).alias("at", "x"))
    sketch = F.expr(f"percentile_approx(x, array({shares}), {100 * bins})")
    found = entries.groupBy("at").agg(sketch.alias("edges"), F.count("*").alias("n")).orderBy("at").collect()
    return [sorted(set(r.edges or [])) for r in found], max((r.n for r in found), default=0)


def binned(df: DataFrame, features: str, edges: Sequence[Sequence[float]], rows: int, **columns: Column) -> DataFrame:
    """`columns` and the row's `bins` (a byte per feature), dealt over partitions of a bounded number of rows."""
    if any(len(e) > 255 for e in edges):
        raise ValueError("at most 256 bins")
    limits = [np.array(e, float) for e in edges]
    kept = df.select(*(c.alias(name) for name, c in columns.items()), features_array(df, features).alias("bins"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(limits))
            out = np.empty(x.shape, np.uint8)
            for j, limit in enumerate(limits):
                out[:, j] = np.searchsorted(limit, x[:, j], side="left")
            packed = pa.array([row.tobytes() for row in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)

    schema = ", ".join(f"{name} {kind}" for name, kind in kept.dtypes[:-1]) + ", bins binary"
    parts = max(1, -(-rows // PARTITION_ROWS))
    return kept.mapInArrow(place, schema).repartition(parts)


def bins_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def hash_share(row: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) from row numbers (64-bit) and a salt, alike wherever a row is recomputed."""
    x = row.astype(np.uint64)
    for s in salt:
        x = x ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * _MIXER
        x = (x ^ (x >> np.uint64(32))) * _MIXER
        x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)) / float(1 << 53)


class Sums:
    """Sums of one task by (tree, node): features x bins x (gradient, curvature, weight)."""

    def __init__(self, trees: Sequence[Tree], wanted: Sequence[Sequence[int]], width: int, bins: int):
        self.trees, self.wanted, self.width, self.bins = trees, wanted, width, bins
        self.total = [np.zeros((len(nodes), width, bins, 3)) for nodes in wanted]

    def add(self, bins: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, weight: np.ndarray) -> None:
        """Rows with a column per tree in each of the three matrices."""
        for k, (tree, nodes) in enumerate(zip(self.trees, self.wanted)):
            if not len(nodes):
                continue
            slots = np.full(len(tree.feature), -1)
            slots[list(nodes)] = np.arange(len(nodes))
            slot = slots[tree.binned_leaves(bins)]
            own = np.flatnonzero((slot >= 0) & (weight[:, k] > 0))
            base, size = slot[own] * self.bins, len(nodes) * self.bins
            w = weight[own, k]
            weighted = (gradient[own, k] * w, curvature[own, k] * w, w)
            for j in range(self.width):
                at = base + bins[own, j]
                for m, values in enumerate(weighted):
                    self.total[k][:, j, :, m] += np.bincount(at, values, size).reshape(len(nodes), self.bins)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for k, nodes in enumerate(self.wanted):
            for slot, node in enumerate(nodes):
                flat = self.total[k][slot].ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([node], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64()))],
                    names=["tree", "node", "sums"],
                )


SUMS = "tree int, node int, sums array<double>"


def added_sums(partial: DataFrame, width: int, bins: int) -> dict[tuple[int, int], np.ndarray]:
    """The sums of all tasks by (tree, node)."""
    vectors = partial.select("tree", "node", array_to_vector("sums").alias("v"))
    found = vectors.groupBy("tree", "node").agg(Summarizer.sum(F.col("v")).alias("s")).collect()
    return {(r.tree, r.node): r.s.toArray().reshape(width, bins, 3) for r in found}


class Grower:
    """The growth of one tree: which nodes it wants measured, and what it makes of the sums.

    Leaves are split by falling gain. To need few passes, leaves further down the order are split ahead of
    their turn; splits whose turn never came are taken back in the end.
    """

    def __init__(self, growth: Growth, edges: Sequence[Sequence[float]], allowed: Sequence[int] | None = None):
        self.growth, self.edges = growth, edges
        self.some = np.zeros(len(edges), bool)
        self.some[list(range(len(edges)) if allowed is None else allowed)] = True
        self.tree = Tree()
        self.totals: dict[int, np.ndarray] = {}
        # Gain, feature and cut of the best split of each measured node that may be split, and the sums of open ones.
        self.best: dict[int, tuple[float, int, int]] = {}
        self.sums: dict[int, np.ndarray] = {}
        self._depth = {0: 0}
        # By measured child: its parent's sums, and the child that is the rest.
        self._pending: dict[int, tuple[np.ndarray, int]] = {}

    def _strength(self, sums: np.ndarray) -> np.ndarray:
        """G^2 / n, or G^2 / (H + ridge), along the last axis."""
        mass = sums[..., 1] + self.growth.ridge if self.growth.curved else sums[..., 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(mass > 0, sums[..., 0] ** 2 / mass, 0.0)

    def _best(self, sums: np.ndarray) -> tuple[float, int, int] | None:
        """Gain, feature and cut of the best split of a leaf; the first feature and lowest cut among equals."""
        left = np.cumsum(sums, axis=1)[:, :-1]
        whole = sums.sum(axis=1)[:, None]
        right = whole - left
        gain = self._strength(left) + self._strength(right) - self._strength(whole)
        enough = np.minimum(left[..., 2], right[..., 2]) >= max(self.growth.min_leaf, 1e-9)
        real = np.arange(gain.shape[1]) < np.array([len(e) for e in self.edges])[:, None]
        gain = np.where(enough & real & self.some[:, None], gain, -np.inf)
        if not gain.size:
            return None
        top = gain.max()
        scale = abs(float(self._strength(whole).max())) + float(np.abs(gain[np.isfinite(gain)]).max(initial=0.0))
        if not top > self.growth.min_gain * max(scale, 1e-300):
            return None
        # Rounding of sums in another order is not to decide between equal splits.
        feature, cut = np.argwhere(gain >= top - 1e-9 * abs(top))[0]
        return float(top), int(feature), int(cut)

    def _measured(self, node: int, sums: np.ndarray) -> None:
        self.totals[node] = sums[0].sum(axis=0)
        if self.growth.depth is not None and self._depth[node] >= self.growth.depth:
            return
        best = self._best(sums)
        if best is not None:
            self.best[node], self.sums[node] = best, sums

    def _expand(self, node: int) -> None:
        """Split an open node, and mark its smaller child for measuring."""
        _, feature, cut = self.best[node]
        sums = self.sums.pop(node)
        left, right = self.tree.split(node, feature, cut, self.edges[feature][cut])
        self._depth[left] = self._depth[right] = self._depth[node] + 1
        below, whole = sums[feature, : cut + 1].sum(axis=0), sums[feature].sum(axis=0)
        self.totals[left], self.totals[right] = below, whole - below
        measured, rest = (left, right) if 2 * below[2] <= whole[2] else (right, left)
        self._pending[measured] = (sums, rest)

    def _chosen(self) -> tuple[list[int], list[int]]:
        """Nodes to split by falling gain, as far as it is known, and those of them whose children are not measured."""
        limit = self.growth.leaves
        heap = [(-self.best[0][0], 0)] if 0 in self.best else []
        chosen, unknown = [], []
        while heap and (limit is None or len(chosen) + 1 < limit):
            _, node = heapq.heappop(heap)
            chosen.append(node)
            if node in self.sums:
                unknown.append(node)
            else:
                for child in (self.tree.left[node], self.tree.right[node]):
                    if child in self.best:
                        heapq.heappush(heap, (-self.best[child][0], child))
        # The children of the very last split are leaves whatever they hold.
        if limit is not None and len(chosen) + 1 == limit and unknown == chosen[-1:]:
            unknown = []
        return chosen, unknown

    def wanted(self) -> list[int]:
        """Nodes to measure in the next pass; none once the tree is done."""
        if not self.totals:
            return [0]
        chosen, unknown = self._chosen()
        if not unknown:
            return []
        room = len(self.sums) if self.growth.leaves is None else max(len(unknown), self.growth.leaves - len(chosen))
        ahead = sorted(set(self.sums) - set(unknown), key=lambda node: (-self.best[node][0], node))
        for node in [*unknown, *ahead[: max(0, room - len(unknown))]]:
            self._expand(node)
        return list(self._pending)

    def take(self, found: dict[int, np.ndarray], width: int, bins: int) -> None:
        """The sums of the nodes that were wanted; a node without rows has none."""
        empty = np.zeros((width, bins, 3))
        if not self.totals:
            self._measured(0, found.get(0, empty))
        for node, (parent, rest) in self._pending.items():
            sums = found.get(node, empty)
            self._measured(node, sums)
            self._measured(rest, parent - sums)
        self._pending.clear()

    def finish(self, value: Callable[[float, float, float], float]) -> tuple[Tree, dict[int, float]]:
        """The tree with leaf values `value(gradient, curvature, weight)`, and the gain of each feature."""
        chosen, _ = self._chosen()
        for node in chosen:
            if node in self.sums:
                self._expand(node)
        keep, out, gains = set(chosen), Tree(), {}
        waiting = [(0, 0)]
        for node, own in waiting:
            if node in keep:
                gain, feature, cut = self.best[node]
                gains[feature] = gains.get(feature, 0.0) + gain
                waiting += zip((self.tree.left[node], self.tree.right[node]), out.split(own, feature, cut, self.tree.threshold[node]))
            else:
                out.value[own] = float(value(*self.totals[node]))
        return out, gains
