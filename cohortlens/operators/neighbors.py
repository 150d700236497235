"""Exact k nearest neighbours.

The reference rows are cut into cells around pivot rows. Every query first searches the
cells nearest to it that hold enough rows, which gives a tight radius; by the triangle
inequality only cells that reach into that radius can hold a nearer row, and the query goes
to those in a second search. Cells lie on shelves of a bounded number of rows, and a query is
sent once to each shelf with the list of its cells there, so that what is shuffled does not grow with
the number of cells. Rows are dealt over tasks by key and vector, and keys of very many rows are spread
where they are joined. Nothing is capped or approximated, whatever the size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import as_col
from cohortlens.operators.crowds import crowds, spread_join
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.shipping import ship_package

DIGITS = 6  # distances are compared after rounding, so ties break on the key
MAX_PIVOTS = 1024
CHUNK_ROWS = 50_000  # reference or query rows of one shelf handled by one task
SPLIT_ROWS = 1_000  # query rows below which a chunk is not cut further
MAX_TASKS = 5_000
CHUNK_CELLS = 4_000_000  # doubles in those rows
BLOCK_CELLS = 1_000_000  # doubles in one distance block
TILE_CELLS = 32_768  # doubles that stay in a core's cache
_SLACK = 2 * 10.0**-DIGITS


def _pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows a[i], b[i]."""
    if metric == "manhattan":
        return np.abs(a - b).sum(axis=1)
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between two small sets of rows; euclidean ones are good to about 1e-7 of the norms."""
    if metric == "manhattan":
        out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
        step = max(1, TILE_CELLS // max(1, len(b)))
        room = np.empty((step, len(b)))
        for start in range(0, len(a), step):
            some, sums = a[start : start + step], out[start : start + step]
            gap = room[: len(some)]
            for i, column in enumerate(columns):
                np.subtract(some[:, i, None], column, out=gap)
                sums += np.abs(gap, out=gap)
        return out
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _doubt(a: np.ndarray, b: np.ndarray) -> float:
    """How far `_distances` may be off."""
    return 1e-7 * float(np.sqrt(max((a * a).sum(axis=1).max(initial=0), (b * b).sum(axis=1).max(initial=0)))) + _SLACK


def _nearest(
    queries: np.ndarray, refs: np.ndarray, keys: np.ndarray, k: int, metric: str, radius: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query numbers, reference numbers and rounded distances of the k nearest within each radius.

    Candidates come from one matrix product per block; only they get exact distances. Equal
    distances go to the smaller key.
    """
    step = max(1, BLOCK_CELLS // max(1, len(refs)))
    for start in range(0, len(queries), step):
        some = queries[start : start + step]
        rough, doubt = _distances(some, refs, metric), _doubt(some, refs)
        limit = radius[start : start + step]
        if len(refs) > k:
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + doubt)
        row, column = np.nonzero(rough <= (limit + doubt)[:, None])
        exact, few = np.empty(len(row)), max(1, BLOCK_CELLS // max(1, refs.shape[1]))
        for at in (slice(i, i + few) for i in range(0, len(row), few)):
            exact[at] = np.round(_pair_distances(some[row[at]], refs[column[at]], metric), DIGITS)
        order = np.lexsort((keys[column], exact, row))
        row, column, exact = row[order], column[order], exact[order]
        first = np.searchsorted(row, np.arange(len(some)))
        keep = np.arange(len(row)) - first[row] < k
        yield start + row[keep], column[keep], exact[keep]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64").reshape(len(column), -1)


def _narrow(df: DataFrame, key: str, vector: str, payload: str | None = None) -> DataFrame:
    """Key, vector as array and payload of the rows that have a key and a vector."""
    array = vector_to_array(as_col(vector)) if dict(df.dtypes)[vector] == "vector" else as_col(vector).cast("array<double>")
    cols = [as_col(key).alias("key"), array.alias("vec")]
    if payload is not None:
        cols.append(as_col(payload).alias("payload"))
    return df.select(*cols).where(F.col("key").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))


def knn_join(
    queries: DataFrame,
    reference: DataFrame,
    k: int,
    query_key: str,
    reference_key: str,
    vector: str = "features",
    payload: str | None = None,
    metric: str = "euclidean",
    exclude_self: bool = False,
    pivots: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The k nearest reference rows of every query: ``query_key, neighbor, distance, rank, payload``.

    Keys are numbers or texts and identify a row; vectors are arrays or ML vectors of one length.
    Rows without a key or with a missing vector take no part. Distances are rounded to six digits
    and ordered by (distance, neighbour key). ``exclude_self`` skips the reference row with
    the query's own key. About the square root of the reference rows serve as pivots.
    """
    metric = "euclidean" if metric == "minkowski" else metric
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    ship_package(queries.sparkSession)
    refs = _narrow(reference, reference_key, vector, payload)
    asked = _narrow(queries, query_key, vector)
    found = _search(asked, refs.select("key", "vec"), k + int(exclude_self), metric, pivots, chunk_rows)
    if exclude_self:
        found = found.where(F.col("query") != F.col("neighbor"))
    order = Window.partitionBy("query").orderBy("distance", "neighbor")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if payload is not None:
        ranked = spread_join(refs.select(F.col("key").alias("__ref"), "payload"), ranked, "__ref", "neighbor", crowds(refs, "key"))
        ranked = ranked.withColumnRenamed("__ref", "neighbor")
        ranked = ranked.withColumnRenamed("payload", payload)
    return ranked.select(
        F.col("query").alias(query_key), "neighbor", "distance", "rank", *([payload] if payload else [])
    )


def _shelves(sizes: np.ndarray, chunk_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each cell, and the chunks of each shelf: small cells share one chunk of at most `chunk_rows`, larger ones are cut."""
    shelf, chunks, used = np.zeros(len(sizes), np.int64), [], chunk_rows + 1
    for cell, n in enumerate(sizes.tolist()):
        if n > chunk_rows:
            chunks.append(-(-n // chunk_rows))
            shelf[cell], used = len(chunks) - 1, chunk_rows + 1
            continue
        if used + n > chunk_rows:
            chunks.append(1)
            used = 0
        shelf[cell], used = len(chunks) - 1, used + n
    return shelf, np.array(chunks, np.int64)


@dataclass(frozen=True)
class _Cells:
    """Where the reference rows lie: pivots, rows of each cell, least and greatest distance to the pivot, shelves."""

    centers: np.ndarray
    sizes: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    shelf: np.ndarray
    chunks: np.ndarray
    metric: str

    def blocks(self, rows: int) -> Iterator[slice]:
        step = max(1, BLOCK_CELLS // len(self.centers))
        return (slice(i, i + step) for i in range(0, rows, step))

    def route(self, vecs: np.ndarray, keys: np.ndarray, k: int, radius: np.ndarray | None) -> Iterator[pd.DataFrame]:
        """A row per query and shelf with cells for it: those at home (nearest ones with k rows together), or all others within the radius."""
        for at in self.blocks(len(vecs)):
            d = _distances(vecs[at], self.centers, self.metric)
            order = np.argsort(np.where(self.sizes > 0, d, np.inf), axis=1)
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            wanted = np.zeros(d.shape, bool)
            np.put_along_axis(wanted, order, (before < k) & (self.sizes[order] > 0), axis=1)
            del order, before
            bound = np.full(len(d), np.inf)
            if radius is not None:
                bound, doubt = radius[at], _doubt(vecs[at], self.centers)
                lower = np.maximum(0.0, np.maximum(d - self.hi, self.lo - d))
                wanted = ~wanted & (self.sizes > 0) & (lower <= bound[:, None] + 2 * doubt)
            row, cell = np.nonzero(wanted)
            # Cells of a shelf are neighbours in number, so runs of one query and one shelf follow one another.
            start = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(self.shelf[cell], prepend=-1))
            if len(start):
                own = row[start]
                yield pd.DataFrame(
                    {"key": keys[at][own], "vec": list(vecs[at][own]), "shelf": self.shelf[cell[start]].astype("int32"),
                     "cells": np.split(cell.astype("int32"), start[1:]), "radius": bound[own]}
                )


def _first(query: np.ndarray, ref: np.ndarray, distance: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first candidates of each query by (distance, place of the key)."""
    order = np.lexsort((place[ref], distance, query))
    query, ref, distance = query[order], ref[order], distance[order]
    begins = np.flatnonzero(np.diff(query, prepend=-1))
    keep = np.arange(len(query)) - np.repeat(begins, np.diff(begins, append=len(query))) < k
    return query[keep], ref[keep], distance[keep]


def _search_shelf(q: pd.DataFrame, r: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The k nearest rows of a shelf's chunk, each query in its own cells."""
    if not len(q) or not len(r):
        return pd.DataFrame({"query": q["key"][:0], "neighbor": r["key"][:0], "distance": np.zeros(0)})
    keys, queries, refs = r["key"].to_numpy(), _matrix(q["vec"]), _matrix(r["vec"])
    place = np.empty(len(keys), np.int64)
    place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    radius = q["radius"].to_numpy(copy=True)
    asked = np.concatenate(q["cells"].tolist())
    asker = np.repeat(np.arange(len(q)), q["cells"].map(len))
    by_cell = np.argsort(asked, kind="stable")
    asked, asker = asked[by_cell], asker[by_cell]
    held = r["cell"].to_numpy()
    by_held = np.argsort(held, kind="stable")
    none = np.zeros(0, np.int64)
    best, fresh, waiting = (none, none, np.zeros(0)), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = _first(*(np.concatenate(part) for part in zip(best, *fresh)), place, k)
        # From k candidates on, the last bounds what can still come in.
        full, last = np.unique(found[0], return_index=True)[0], np.searchsorted(found[0], found[0], side="right") - 1
        counts = np.bincount(found[0], minlength=len(radius))
        ends = last[np.searchsorted(found[0], full)]
        some = counts[full] >= k
        radius[full[some]] = np.minimum(radius[full[some]], found[2][ends[some]] + _SLACK)
        return found

    for cell in np.unique(held):
        own = by_held[slice(*np.searchsorted(held[by_held], [cell, cell + 1]))]
        some = asker[slice(*np.searchsorted(asked, [cell, cell + 1]))]
        for i, j, d in _nearest(queries[some], refs[own], place[own], k, metric, radius[some]):
            fresh.append((some[i], own[j], d))
            waiting += len(i)
            if waiting > BLOCK_CELLS:
                best, fresh, waiting = merged(), [], 0
    query, ref, distance = merged()
    return pd.DataFrame({"query": q["key"].to_numpy()[query], "neighbor": keys[ref], "distance": distance})


def _search(
    asked: DataFrame, refs: DataFrame, k: int, metric: str, pivots: int | None, chunk_rows: int
) -> DataFrame:
    """At least the k nearest references of every query, as (query, neighbor, distance)."""
    ensure_checkpoint_dir(refs.sparkSession)
    kinds = dict(refs.dtypes)["key"], dict(asked.dtypes)["key"]
    result = f"query {kinds[1]}, neighbor {kinds[0]}, distance double"
    rows = refs.count()
    if not rows:
        return refs.sparkSession.createDataFrame([], result)
    wanted = pivots or max(1, min(MAX_PIVOTS, math.isqrt(rows)))
    # A hash of the row picks the pivots, so the cells are the same on every run, and repeated keys do not choose them.
    centers = np.unique(_matrix(refs.orderBy(F.xxhash64("key", "vec"), "key", "vec").limit(wanted).toPandas()["vec"]), axis=0)
    chunk_rows = min(chunk_rows, max(1, CHUNK_CELLS // max(1, centers.shape[1])))
    step = max(1, BLOCK_CELLS // len(centers))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), step):
                some = batch[start : start + step]
                vecs = _matrix(some["vec"])
                cell = _distances(vecs, centers, metric).argmin(axis=1)
                yield some.assign(cell=cell.astype("int32"), to_center=_pair_distances(vecs, centers[cell], metric))

    placed = refs.mapInPandas(assign, f"key {kinds[0]}, vec array<double>, cell int, to_center double").checkpoint()
    asked = asked.checkpoint()
    sizes = np.zeros(len(centers), np.int64)
    lo, hi = np.full(len(centers), np.inf), np.full(len(centers), -np.inf)
    reach = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_center").alias("lo"), F.max("to_center").alias("hi"))
    for r in reach.collect():
        sizes[r.cell], lo[r.cell], hi[r.cell] = r.n, r.lo, r.hi
    cells = _Cells(centers, sizes, lo, hi, *_shelves(sizes, chunk_rows), metric)
    routed = f"key {kinds[1]}, vec array<double>, shelf int, cells array<int>, radius double"

    def go_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from cells.route(_matrix(batch["vec"]), batch["key"].to_numpy(), k, None)

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from cells.route(_matrix(batch["vec"]), batch["key"].to_numpy(), k, batch["radius"].fillna(np.inf).to_numpy())

    def searched(sent: DataFrame) -> DataFrame:
        """Search every (query, shelf) pair; large shelves and their queries are cut into chunks, few shelves' queries into one for each core."""
        load = {r.shelf: r["count"] for r in sent.groupBy("shelf").count().collect()}
        cores = refs.sparkSession.sparkContext.defaultParallelism
        least = -(-2 * cores // int(cells.chunks.sum()))
        cuts = [
            max(1, -(-n // chunk_rows), min(least, n // SPLIT_ROWS)) for n in (load.get(s, 0) for s in range(len(cells.chunks)))
        ]

        def at(counts: Sequence[int], place: Column) -> Column:
            return F.get(F.array(*[F.lit(int(n)) for n in counts]), place)

        shelf = at(cells.shelf, F.col("cell"))
        chunks = lambda place: at(cells.chunks, place)
        splits = lambda place: at(cuts, place)
        part = lambda n: F.pmod(F.xxhash64("key", "vec"), n).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        ref_side = placed.select("key", "vec", "cell", shelf.alias("shelf"))
        ref_side = ref_side.select("*", part(chunks(F.col("shelf"))).alias("chunk"), copies(splits(F.col("shelf"))).alias("split"))
        query_side = sent.select("*", copies(chunks(F.col("shelf"))).alias("chunk"), part(splits(F.col("shelf"))).alias("split"))
        group = ["shelf", "chunk", "split"]
        # Work follows pairs of rows, not bytes, so small partitions are not to be put together.
        tasks = min(MAX_TASKS, 3 * int(cells.chunks @ np.array(cuts)))
        query_side, ref_side = (side.repartition(tasks, *group) for side in (query_side, ref_side))
        pairs = query_side.groupBy(*group).cogroup(ref_side.groupBy(*group))
        return pairs.applyInPandas(lambda q, r: _search_shelf(q, r, k, metric), result)

    near = searched(asked.mapInPandas(go_home, routed)).checkpoint()
    nth = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor"))
    radius = near.withColumn("nth", nth).where(F.col("nth") == k).select("query", F.col("distance").alias("radius"))
    bounded = spread_join(asked, radius, "key", "query", crowds(asked, "key"), "left").select("key", "vec", "radius")
    further = searched(bounded.mapInPandas(go_on, routed))
    return near.unionByName(further)


def knn_classify(
    queries: DataFrame,
    reference: DataFrame,
    label: str,
    k: int = 5,
    query_key: str = "key",
    reference_key: str = "key",
    vector: str = "features",
    metric: str = "euclidean",
    weights: str = "uniform",
    exclude_self: bool = False,
    **search,
) -> DataFrame:
    """Majority vote ``(query_key, predicted, share)``; equal votes go to the smallest class.

    ``weights='distance'`` votes with the inverse distance; exact matches then take all weight.
    """
    near = knn_join(
        queries, reference, k, query_key, reference_key, vector, label, metric, exclude_self, **search
    )
    return vote(near, query_key, label, weights)


def vote(near: DataFrame, query_key: str, label: str, weights: str = "uniform") -> DataFrame:
    """Each query's winning class and its share of the votes."""
    if weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(query_key))
        ballot = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
    else:
        ballot = F.lit(1.0)
    votes = near.withColumn("__vote", ballot).groupBy(query_key, label).agg(F.sum("__vote").alias("__vote"))
    return votes.groupBy(query_key).agg(
        F.min_by(label, F.struct(-F.col("__vote"), F.col(label))).alias("predicted"),
        F.try_divide(F.max("__vote"), F.sum("__vote")).alias("share"),
    )


def knn_regress(
    queries: DataFrame,
    reference: DataFrame,
    target: str,
    k: int = 5,
    query_key: str = "key",
    reference_key: str = "key",
    vector: str = "features",
    metric: str = "euclidean",
    **search,
) -> DataFrame:
    """Mean target of the k nearest reference rows."""
    near = knn_join(
        queries, reference, k, query_key, reference_key, vector, target, metric, **search
    )
    return near.groupBy(query_key).agg(F.avg(as_col(target)).alias("predicted"))


class NearestNeighbours(Estimator):
    """Nearest neighbours as a tunable model: ``k``, ``weights`` and ``metric`` are grid parameters.

    ``task`` is classify (majority vote of numeric labels) or regress (mean). ``key`` names the
    column that identifies a row. The fitted model holds its training rows as a table.
    """

    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean, manhattan or minkowski", TypeConverters.toString)

    def __init__(
        self,
        key: str,
        k: int = 5,
        weights: str = "uniform",
        metric: str = "euclidean",
        task: str = "classify",
        features: str = "features",
        label: str = "label",
    ) -> None:
        super().__init__()
        self._set(k=k, weights=weights, metric=metric)
        self.key, self.task, self.features, self.label = key, task, features, label

    def _reference(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(as_col(self.key).alias("__ref"), as_col(self.features).alias("features"), as_col(self.label).alias("__label"))

    def _fit(self, dataset: DataFrame) -> NearestNeighboursModel:
        # Cut off from the caller's cache, which may be gone when the model is used.
        ensure_checkpoint_dir(dataset.sparkSession)
        return NearestNeighboursModel(self, self._reference(dataset).checkpoint())

    def near(self, rows: DataFrame, reference: DataFrame, k: int, metric: str) -> DataFrame:
        asked = rows.select(as_col(self.key).alias("__key"), as_col(self.features).alias("features"))
        return knn_join(asked, reference, k, "__key", "__ref", "features", "__label", metric)

    def predicted(self, rows: DataFrame, near: DataFrame, k: int, weights: str) -> DataFrame:
        """``rows`` with a prediction from their ``k`` nearest among ``near``."""
        few = near.where(F.col("rank") <= k)
        if self.task == "classify":
            votes = vote(few, "__key", "__label", weights).select("__key", F.col("predicted").cast("double").alias("prediction"))
        else:
            votes = few.groupBy("__key").agg(F.avg("__label").alias("prediction"))
        return spread_join(rows, votes, self.key, "__key", crowds(rows, self.key), "left")

    def score_grid(self, train: DataFrame, held: DataFrame, maps: Sequence[Mapping], evaluator: Evaluator) -> list[float]:
        """Score all parameter sets: one search per metric serves every number of neighbours and weighting."""
        settings = [self.copy(dict(m)) for m in maps]
        reference, scores = self._reference(train), [math.nan] * len(settings)
        for metric in dict.fromkeys(s.getOrDefault(s.metric) for s in settings):
            own = [i for i, s in enumerate(settings) if s.getOrDefault(s.metric) == metric]
            most = max(settings[i].getOrDefault(settings[i].k) for i in own)
            near = self.near(held, reference, most, metric).checkpoint()
            for i in own:
                s = settings[i]
                scores[i] = evaluator.evaluate(s.predicted(held, near, s.getOrDefault(s.k), s.getOrDefault(s.weights)))
        return scores


class NearestNeighboursModel(Model):
    def __init__(self, settings: NearestNeighbours, reference: DataFrame) -> None:
        super().__init__()
        self.settings, self.reference = settings, reference

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.settings
        k, metric, weights = (s.getOrDefault(p) for p in (s.k, s.metric, s.weights))
        return s.predicted(dataset, s.near(dataset, self.reference, k, metric), k, weights)
