"""SimHash near-duplicates: exact pairs within a Hamming distance through vantage-point trees.

A tree over a small sample cuts the fingerprints into shards: each node sends what lies
within the median distance of its vantage point inside, the rest outside. By the triangle
inequality only fingerprints within the wanted distance of that boundary can have partners
on the other side; copies of those, as queries, follow. Inside a shard the same tree goes on
in memory down to small leaves, which are compared directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import with_text_columns
from cohortlens.llm.components import connected_components, local_components
from cohortlens.llm.store import stored

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
# Fingerprints a shard is built for, and how many sampled ones stand for a shard.
SHARD, SAMPLED = 32_768, 64
_LEAF = 256
_BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(last)), np.uint64, last)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(last, 8), axis=1, bitorder="little")
    over_half = 2 * bits.sum(axis=0, dtype=np.int64) > last
    return int(np.packbits(over_half, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, texts: pa.Array) -> list[pa.Array]:
    values = [fingerprint(text, shingle) for text in texts.to_pylist()]
    return [pa.array(np.array(values, np.uint64).view(np.int64))]


def with_fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, name: str = "fingerprint", keep: list[str] | None = None
) -> DataFrame:
    """Adds the SimHash of each text as a long (its bits are the unsigned fingerprint).

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A
    text of fewer than `shingle` words is one shingle; null texts and texts without words
    have fingerprint zero.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: _fingerprints(shingle, texts)

    return with_text_columns(docs, text, make, {name: "bigint"}, keep)


def _distance(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point)


@dataclass
class Node:
    """A vantage point and its radius; children are nodes or shard numbers."""

    point: np.uint64
    radius: int
    inside: Node | int
    outside: Node | int


def _split(values: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point among `values` and the median distance to it, if that splits them."""
    for at in (0, len(values) // 2, len(values) - 1):
        distance = _distance(values, values[at])
        radius = int(np.median(distance))
        if (distance > radius).any():
            return values[at], radius
        if (distance < radius).any():
            return values[at], radius - 1
    return None


def build_tree(sample: np.ndarray, shards: int) -> tuple[Node | int, int]:
    """A tree over the sample with about `shards` leaves, and how many it has."""
    count = 0

    def grow(values: np.ndarray, leaves: int) -> Node | int:
        nonlocal count
        cut = _split(values) if leaves > 1 and len(values) > 1 else None
        if cut is None:
            count += 1
            return count - 1
        inside = _distance(values, cut[0]) <= cut[1]
        return Node(*cut, grow(values[inside], leaves // 2), grow(values[~inside], leaves - leaves // 2))

    return grow(sample, shards), count


def _route(node: Node | int, home: np.ndarray, query: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, fingerprints at home there, and those that come as queries."""
    if isinstance(node, int):
        yield node, home, query
        return
    own, other = _distance(home, node.point), _distance(query, node.point)
    inside = own <= node.radius
    # Of two partners that part here, the inner one follows the outer one.
    crossing = home[inside & (own > node.radius - reach)]
    yield from _route(node.inside, home[inside], query[other <= node.radius + reach], reach)
    outer = np.concatenate([query[other > node.radius - reach], crossing])
    yield from _route(node.outside, home[~inside], outer, reach)


def _deal(tree: Node | int, reach: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for shard, home, query in _route(tree, values, values[:0], reach):
            both = np.concatenate([home, query])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(both), shard, np.int64)), pa.array(both.view(np.int64)), pa.array(np.arange(len(both)) < len(home))],
                names=["shard", "fingerprint", "home"],
            )


def _leaf_links(home: np.ndarray, query: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what lies within reach: at most one to each connected part of the leaf."""
    near = np.bitwise_count(home[:, None] ^ home[None, :]) <= reach
    part = local_components(len(home), *np.nonzero(near))
    yield home, home[part]
    for at in range(0, len(query), _BLOCK):
        some = query[at : at + _BLOCK]
        row, column = np.nonzero(np.bitwise_count(some[:, None] ^ home[None, :]) <= reach)
        pairs = np.unique(row * len(home) + part[column])
        yield some[pairs // len(home)], home[pairs % len(home)]


def _links(home: np.ndarray, query: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the home fingerprints, and between them and the queries."""
    cut = _split(home) if len(home) > _LEAF else None
    if cut is None:
        for at in range(0, len(home), _LEAF):
            rest = home[at + _LEAF :]
            yield from _leaf_links(home[at : at + _LEAF], np.concatenate([query, rest]), reach)
        return
    own, other = _distance(home, cut[0]), _distance(query, cut[0])
    inside = own <= cut[1]
    yield from _links(home[inside], query[other <= cut[1] + reach], reach)
    crossing = home[inside & (own > cut[1] - reach)]
    yield from _links(home[~inside], np.concatenate([query[other > cut[1] - reach], crossing]), reach)


def _shard_edges(reach: int, shard: pa.Table) -> pa.Table:
    """Edges that connect each connected part of a shard to its least fingerprint (as signed numbers)."""
    values = shard.column("fingerprint").to_numpy().view(np.uint64)
    home = shard.column("home").to_numpy(zero_copy_only=False)
    pairs = list(_links(np.unique(values[home]), np.unique(values[~home]), reach))
    a = np.concatenate([x for x, _ in pairs] or [values[:0]]).view(np.int64)
    b = np.concatenate([x for _, x in pairs] or [values[:0]]).view(np.int64)
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_components(len(nodes), flat[: len(a)], flat[len(a) :])
    moved = label != np.arange(len(nodes))
    return pa.table({"a": nodes[moved], "b": nodes[label[moved]]})


def near_edges(fingerprints: DataFrame, reach: int = MAX_DISTANCE, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs within `reach` bits.

    `fingerprints` has one long column `fingerprint` of distinct values and is read twice.
    """
    spark = fingerprints.sparkSession
    shards = -(-fingerprints.count() // shard)
    if shards > 1:
        order = F.xxhash64("fingerprint", F.lit(SEED))
        picked = fingerprints.orderBy(order, "fingerprint").limit(shards * SAMPLED).collect()
        tree, _ = build_tree(np.array([r["fingerprint"] for r in picked], np.int64).view(np.uint64), shards)
    else:
        tree = 0
    sent = spark.sparkContext.broadcast(tree)
    dealt = fingerprints.select("fingerprint").mapInArrow(
        lambda batches: _deal(sent.value, reach, batches), "shard bigint, fingerprint bigint, home boolean"
    )
    return dealt.groupBy("shard").applyInArrow(lambda table: _shard_edges(reach, table), "a bigint, b bigint")


def _components(marked: DataFrame, key: str, reach: int, shard: int) -> DataFrame:
    """`root` (a fingerprint of its own) and `component_id` of each fingerprint of the stored table `marked` (key, fingerprint)."""
    nodes = stored(marked.groupBy("fingerprint").agg(F.min(key).alias("lead")), "nodes")
    roots = connected_components(near_edges(nodes.select("fingerprint"), reach, shard))
    rooted = nodes.join(roots.select(F.col("a").alias("fingerprint"), F.col("b").alias("root")), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    leads = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    return rooted.join(leads, "root").select("fingerprint", "root", "component_id")


def simhash_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE_WORDS,
    reach: int = MAX_DISTANCE,
    shard: int = SHARD,
) -> DataFrame:
    """`key`, `fingerprint` (long) and `component_id` of every row.

    Rows whose fingerprints differ in at most `reach` bits are linked, and a component's id is
    its smallest key. Equal fingerprints, repeated rows and groups of copies are one node of
    the search. Null keys are ignored for the id, which is null where a component has no
    other; an empty table gives no rows.
    """
    marked = stored(with_fingerprints(docs, text, shingle, keep=[key]), "fingerprints")
    components = _components(marked, key, reach, shard)
    return marked.join(components, "fingerprint").select(key, "fingerprint", "component_id")


def keep_one_per_component(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE_WORDS,
    reach: int = MAX_DISTANCE,
    shard: int = SHARD,
) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest key.

    Equal rows of that key are one row; where a key is given to different texts of one
    component, the one with the smallest fingerprint (then hash) stays. A null key comes
    after all others. Components are told apart by their fingerprints, so ones with the same
    smallest key keep a row each. Rows are known by 96 bits of hashes of key and text, so
    only those and not the texts go through the search.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    known = docs.withColumns({"__id__": F.xxhash64(F.col(f"`{key}`"), value), "__check__": F.hash(value, F.col(f"`{key}`"))})
    marked = stored(with_fingerprints(known, text, shingle, keep=[key, "__id__", "__check__"]), "fingerprints")
    found = marked.join(_components(marked, key, reach, shard), "fingerprint")
    first = F.min(F.struct("fingerprint", "__id__", "__check__")).alias("first")
    kept = found.where(F.col(f"`{key}`").eqNullSafe(F.col("component_id"))).groupBy("root").agg(first)
    ids = ["__id__", "__check__"]
    chosen = known.join(kept.select("first.__id__", "first.__check__"), ids, "left_semi").dropDuplicates(ids)
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns))
