"""Exact top-k inner-product search over a vector-approximation file.

Every distinct integer vector is quantised to one byte per dimension. For a block of
queries the cells are scanned twice: for the k-th best lower bound of each query, and for
the vectors whose upper bound reaches it. Exact vectors are then read in the order of
their bounds until no unread bound can reach the k-th exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import slices
from cohortlens.llm.store import stored
from cohortlens.shipping import ship_package

CELLS = 64
QUERY_BLOCK = 4096
# Exact vectors read per query before the first look at the k-th exact score, times k.
FIRST_READ = 4
# Integers from here on do not fit 64 bits; scores of this size or more are not told apart.
_PAST_LONG, _PAST_SCORE = 2.0**63, "1" + "0" * 30
_SCORE = "decimal(38,0)"


def integer_vectors(vectors: DataFrame, vector: str, scale: int = 256, strict: bool = False) -> Column:
    """floor(scale * x) of every component as long; null where the vector takes no part.

    That is where a component is null or not finite, and where an integer does not fit 64 bits;
    `strict` makes the latter an error.
    """
    limit = F.lit(_PAST_LONG)
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    fits = F.forall(values, lambda x: (x * F.lit(float(scale)) >= -limit) & (x * F.lit(float(scale)) < limit))
    whole = F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    past = F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("array<bigint>") if strict else F.lit(None)
    return F.when(sound, F.when(fits, whole).otherwise(past))


def _scores(left: str, right: str, bound: Column) -> Column:
    """Inner products as decimals, exact below 10^30; `bound` is no less than any partial sum."""
    pairs = F.zip_with(left, right, lambda a, b: a * b)
    small = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x).cast(_SCORE)
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    near = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    exact = F.zip_with(left, right, lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(_SCORE))
    large = F.aggregate(exact, F.lit(0).cast(_SCORE), lambda s, x: (s + x).cast(_SCORE))
    past = F.lit(_PAST_SCORE).cast(_SCORE)
    return F.when(bound < F.lit(2.0**62), small).when(near >= F.lit(1e30), past).when(near <= F.lit(-1e30), -past).otherwise(large)


def _grid(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The rows of an array or binary column, all of `width` entries, as one matrix."""
    picked = column.take(pa.array(rows))
    if pa.types.is_binary(picked.type):
        return np.frombuffer(b"".join(picked.to_pylist()), np.uint8).reshape(len(rows), width)
    return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for width in np.unique(lengths):
        yield int(width), np.flatnonzero(lengths == width)


def _encode(cells: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(1)
        codes: list[bytes] = [b""] * batch.num_rows
        for width, rows in _by_length(vectors.value_lengths().to_numpy()):
            if width:
                low, step = cells[width]
                # Differences may need 64 bits without a sign.
                above = _grid(vectors, rows, width).astype(np.uint64) - low.astype(np.uint64)
                coded = (above // step.astype(np.uint64)).astype(np.uint8)
                for row, code in zip(rows.tolist(), coded):
                    codes[row] = code.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "code"])


def _bounds(queries: dict, cells: dict, batch: pa.RecordBatch) -> Iterator[tuple]:
    """Query keys, class keys, lower and upper bounds of each group of vectors of one length."""
    code = batch.column(1)
    lengths = np.array([len(x) for x in code.to_pylist()])
    keys = batch.column(0).to_numpy()
    for width, rows in _by_length(lengths):
        if width not in queries:
            continue
        ids, vectors = queries[width]
        if width:
            low, step = cells[width]
            # Wraps around and back: the sum fits.
            floor = (low + _grid(code, rows, width).astype(np.int64) * step).astype(np.float64)
            base = vectors @ floor.T
            span = step - 1.0
            # Past 2^53 products and sums are rounded; the slack covers it.
            most = width * np.abs(vectors).max(axis=1) * (np.abs(floor).max() + span.max()) if base.size else np.zeros(len(ids))
            slack = np.where(most < 2.0**53, 0.0, most * (width + 8) * 2.0**-52)
            lower = base - (np.maximum(-vectors, 0) @ span + slack)[:, None]
            upper = base + (np.maximum(vectors, 0) @ span + slack)[:, None]
        else:
            lower = upper = np.zeros((len(ids), len(rows)))
        yield ids, keys[rows], lower, upper


def _best_lower(queries: dict, cells: dict, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's k best lower bounds of every query."""
    best: dict[int, np.ndarray] = {}
    for batch in slices(batches):
        for ids, keys, lower, _ in _bounds(queries, cells, batch):
            top = np.concatenate([best[id(ids)], lower], axis=1) if id(ids) in best else lower
            best[id(ids)] = -np.partition(-top, k - 1, axis=1)[:, :k] if top.shape[1] > k else top
    for ids, _ in queries.values():
        if id(ids) in best:
            top = best[id(ids)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, top.shape[1])), pa.array(top.ravel())], names=["query", "lower"]
            )


def _reaching(queries: dict, cells: dict, bars: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors whose upper bound reaches the query's bar."""
    for batch in slices(batches):
        for ids, keys, _, upper in _bounds(queries, cells, batch):
            bar = np.array([bars.get(q, -np.inf) for q in ids.tolist()])
            row, column = np.nonzero(upper >= bar[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(keys[column]), pa.array(upper[row, column])], names=["query", "class", "upper"]
            )


def _cells(vectors: DataFrame) -> dict:
    """By vector length, the lowest value and the cell width of each dimension."""
    entries = vectors.select(F.size("vector").alias("width"), F.posexplode("vector").alias("at", "value"))
    ranges = entries.groupBy("width", "at").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in ranges:
        low, step = out.setdefault(r["width"], (np.zeros(r["width"], np.int64), np.ones(r["width"], np.int64)))
        low[r["at"]], step[r["at"]] = r["low"], (r["high"] - r["low"]) // CELLS + 1
    return out


def _query_blocks(queries: DataFrame, size: int) -> Iterator[dict]:
    """By vector length, keys and vectors of successive blocks of query classes."""

    def block(rows: list) -> dict:
        lengths = np.array([len(v) for _, v in rows])
        return {
            width: (
                np.array([rows[i][0] for i in at], np.int64),
                np.array([rows[i][1] for i in at], np.float64).reshape(len(at), width),
            )
            for width, at in _by_length(lengths)
        }

    rows: list = []
    for row in queries.toLocalIterator():
        rows.append((row["class"], row["vector"]))
        if len(rows) == size:
            yield block(rows)
            rows = []
    if rows:
        yield block(rows)


def exact_top_k(vectors: DataFrame, id_column: str, vector: str, is_query: Column, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """`query_id`, `rank`, `vec_id` and `score` of every query's k best other rows.

    `vector` holds integers (array<bigint>); rows with a null id or vector take no part, and
    only vectors of one length are compared. Scores are exact inner products, and one of the
    result that does not fit 64 bits is an error; ties go to the
    smaller id. A row is no match of itself, while another row with an equal id or vector
    is. Equal vectors are searched for once and kept as a class with its k + 1 smallest ids,
    so that groups of copies of any size cost one entry. Queries go to the workers in blocks
    of `block` distinct vectors. A table without queries gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    rows = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).cast("long").alias("id"),
            F.col(vector).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
        ).where(F.col("id").isNotNull() & F.col("vector").isNotNull()),
        "va-rows",
    )
    # The rank filter runs before the shuffle as well, so a large group of copies shrinks at once.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id", "row"))
    smallest = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    members = F.sort_array(F.collect_list(F.struct("id", "row"))).alias("members")
    classes = smallest.groupBy("vector").agg(F.min("row").alias("class"), members)
    cells = _cells(rows)
    coded = stored(
        classes.select("class", "vector", "members").mapInArrow(
            lambda batches: _encode(cells, batches),
            "class bigint, vector array<bigint>, members array<struct<id:bigint,row:bigint>>, code binary",
        ),
        "va-classes",
    )
    asking = stored(
        rows.where("is_query").join(coded.select("class", "vector"), "vector").select("class", "id", "row", "vector"), "va-queries"
    )
    file = coded.select("class", "code")
    by_query = Window.partitionBy("query")
    reached = []
    for queries in _query_blocks(asking.select("class", "vector").dropDuplicates(["class"]), block):
        sent = sc.broadcast(queries)
        lower = file.mapInArrow(lambda b, q=sent: _best_lower(q.value, cells, k + 1, b), "query bigint, lower double")
        nth = F.row_number().over(by_query.orderBy(F.desc("lower")))
        # One number for each query of this block.
        bars = {r["query"]: r["lower"] for r in lower.withColumn("nth", nth).where(F.col("nth") == k + 1).collect()}
        kept = sc.broadcast(bars)
        found = file.mapInArrow(
            lambda b, q=sent, x=kept: _reaching(q.value, cells, x.value, b), "query bigint, class bigint, upper double"
        )
        reached.append(stored(found, "va-reached"))
    if not reached:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    candidates = reached[0]
    for more in reached[1:]:
        candidates = candidates.unionAll(more)
    ordered = stored(
        candidates.withColumn("nth", F.row_number().over(by_query.orderBy(F.desc("upper"), "class"))), "va-ordered"
    )
    # The largest component, for a bound of the products.
    most = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    asked = coded.select(F.col("class").alias("query"), F.col("vector").alias("asked"), most.alias("asked_most"))

    def exact(pairs: DataFrame) -> DataFrame:
        score = _scores("asked", "vector", F.col("asked_most") * F.col("most") * F.size("vector"))
        return pairs.join(coded.select("class", "vector", "members", most.alias("most")), "class").join(asked, "query").select(
            "query", score.alias("score"), "members"
        )

    first = FIRST_READ * (k + 1)
    early = exact(ordered.where(F.col("nth") <= first))
    bar = (
        early.withColumn("nth", F.row_number().over(by_query.orderBy(F.desc("score"))))
        .where(F.col("nth") == k + 1)
        .select("query", F.col("score").alias("bar"))
    )
    late = ordered.where(F.col("nth") > first).join(bar, "query").where(F.col("upper") >= F.col("bar"))
    matches = early.unionAll(exact(late)).select("query", "score", F.explode("members").alias("member"))
    best = matches.select("query", "score", "member.id", "member.row")
    nth = F.row_number().over(by_query.orderBy(F.desc("score"), "id", "row"))
    best = best.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    answers = asking.select(F.col("class").alias("query"), F.col("id").alias("query_id"), F.col("row").alias("own")).join(best, "query")
    # A vector's score with itself is no part of the result and may be of any size.
    low, high = (F.lit(x).cast(_SCORE) for x in ("-9223372036854775808", "9223372036854775807"))
    fits = F.col("score").between(low, high)
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "id", "row"))
    return (
        answers.where(F.col("row") != F.col("own"))
        .withColumn("rank", rank.cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), score.alias("score"))
    )
