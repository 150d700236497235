"""MinHash near-dedup: universal hash minima, banding, verified links, connected components.

Equal shingle sets are one node. A node's signature holds one byte of each of its 240 minima,
and six neighbouring bytes are a band, so two sets of similarity 0.85 share none of the 40 bands with
probability 6e-9. All members of a band are first held against one leader. Where members are
left that neither the leader nor anything else connects, the band is cut into blocks of a
bounded size and all of its pairs are compared block by block, without writing them out.
A link counts only if signatures agree well and the full shingle sets confirm it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import Rolling, lower_ascii, mix, runs, with_text_columns
from cohortlens.llm.components import connected_components
from cohortlens.llm.store import stored
from cohortlens.shipping import ship_package

SHINGLE_WORDS = 5
# Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, BAND_ROWS = 40, 6
HASHES = BANDS * BAND_ROWS
# Members of a band that are compared with each other in one task.
BLOCK = 256

_U = np.uint64
_WORDS = Rolling(31)
_RNG = np.random.default_rng(32)
# x -> a * x + b modulo 2^64 with odd a, of which the top bits count.
_FACTORS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_TERMS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * _U(2) + _RNG.integers(0, 2, HASHES, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def least_agreement(percent: int = PERCENT, hashes: int = HASHES) -> int:
    """Signature bytes that agree at least: seven deviations below what sets at the threshold expect.

    Sets at the threshold itself fall below that with probability 5e-9, more similar ones more rarely.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    return max(0, floor(hashes * p - 7 * sqrt(hashes * p * (1 - p))))


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and how many words each text has."""
    lowered = lower_ascii(data)
    inside = ~_SPACE[lowered]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(lowered))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _WORDS.between(_WORDS.prefix(lowered), starts, stops), np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit names, end to end, and each text's number of them."""
    words, counts = _word_hashes(data, ends)
    base = np.cumsum(counts) - counts
    owners, names = [], []
    for length in range(1, width + 1):
        # Shorter sequences are whole texts only.
        texts = np.flatnonzero(counts == length) if length < width else np.flatnonzero(counts >= width)
        many = counts[texts] - length + 1
        owner = np.repeat(texts, many)
        at = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        name = np.full(len(at), _U(length))
        for k in range(length):
            name = mix(name * _STEP + words[at + k])
        owners.append(owner)
        names.append(name)
    owner, name = np.concatenate(owners), np.concatenate(names)
    order = np.lexsort((name, owner))
    owner, name = owner[order], name[order]
    new = np.ones(len(name), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1])
    return name[new], np.bincount(owner[new], minlength=len(ends))


def signatures(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of HASHES bytes for each set that is not empty: a byte mixed from each minimum."""
    filled = counts[counts > 0]
    out = np.empty((len(filled), HASHES), np.uint8)
    if len(filled):
        starts = np.cumsum(filled) - filled
        for j in range(HASHES):
            least = np.minimum.reduceat(names * _FACTORS[j] + _TERMS[j], starts)
            out[:, j] = mix(least) >> _U(56)
    return out


def _mark(texts: pa.Array) -> list[pa.Array]:
    sizes, digests, signed = [], [], []
    for _, _, data, ends in runs(texts):
        names, counts = shingle_sets(data, ends)
        total = np.zeros((len(ends), 2), np.uint64)
        filled = counts > 0
        if filled.any():
            starts = (np.cumsum(counts) - counts)[filled]
            for k, salt in enumerate((_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))):
                total[filled, k] = np.add.reduceat(mix(names ^ salt), starts)
        rows = iter(signatures(names, counts))
        sizes.append(counts)
        digests.append(total)
        signed += [next(rows).tobytes() if n else None for n in counts]
    if not sizes:
        return [pa.array([], pa.int64())] * 3 + [pa.array([], pa.binary())]
    digest = np.concatenate(digests).view(np.int64)
    return [
        pa.array(np.concatenate(sizes).astype(np.int64)),
        pa.array(np.ascontiguousarray(digest[:, 0])),
        pa.array(np.ascontiguousarray(digest[:, 1])),
        pa.array(signed, pa.binary()),
    ]


def _shingles(texts: pa.Array) -> list[pa.Array]:
    out = []
    for _, _, data, ends in runs(texts):
        names, counts = shingle_sets(data, ends)
        stops = np.cumsum(counts)
        out += [names[a:b].tobytes() for a, b in zip((stops - counts).tolist(), stops.tolist())]
    return [pa.array(out, pa.binary())]


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    joined = np.concatenate([a, b])
    joined.sort(kind="stable")
    common = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return 100 * common >= percent * (both - common)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """A matrix from binary values of one size."""
    return np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in column]).reshape(len(column), -1)


def _confirm(percent: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are links; input: a, b, their signatures and their sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        agree = (_bytes_of(batch.column(2)) == _bytes_of(batch.column(3))).sum(axis=1)
        rows = [
            i for i in np.flatnonzero(agree >= least).tolist() if similar(_set(batch.column(4)[i]), _set(batch.column(5)[i]), percent)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)], names=["a", "b"])


def _block_links(percent: int, least: int, block: pa.Table) -> pa.Table:
    """Links that join what is still apart; columns: lo, hi, own (block), node, part, signature, shingles."""
    node, part, own = (block.column(c).to_numpy() for c in ("node", "part", "own"))
    lo, hi = block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
    signature, sets = _bytes_of(block.column("signature").combine_chunks()), block.column("shingles")
    above = np.flatnonzero(own == lo)
    parts, root = np.unique(part, return_inverse=True)
    leader = list(range(len(parts)))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    pairs = []
    for i in above.tolist():
        others = np.flatnonzero((own == hi) & (part != part[i]))
        if lo == hi:
            others = others[others > i]
        agree = (signature[others] == signature[i]).sum(axis=1)
        keep = agree >= least
        pairs += zip((-agree[keep]).tolist(), [i] * int(keep.sum()), others[keep].tolist())
    links = []
    # The most alike first: they join parts, and pairs inside a part need no comparison.
    for _, i, j in sorted(pairs):
        a, b = find(root[i]), find(root[j])
        if a != b and similar(_set(sets[i]), _set(sets[j]), percent):
            leader[a] = b
            links.append((i, j))
    rows = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": node[rows[:, 0]], "b": node[rows[:, 1]]})


def _open_members(members: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(band, lo, hi, own, node, part) of bands whose members other than the leader are not all of one part.

    A band of n members has n / block hashed blocks, and a row for each pair of them meets.
    """
    labelled = members.join(parts, members.node == parts.a, "left").select(
        "band", "leader", "node", F.coalesce("b", "node").alias("part")
    )
    rest = stored(labelled.where(F.col("node") != F.col("leader")).select("band", "node", "part"), "members")
    apart = rest.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    still = apart.where("low <> high").select("band", blocks.alias("blocks"))
    dealt = rest.join(still, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("band", "node", "part", "own", other)
    return met.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part")


def _links(nodes: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b) for each node a and its component's least node b, if that is another one.

    `nodes` has node, t1, t2 (the text's two hashes) and signature; `texts` has t1, t2, text.
    """
    least = least_agreement(percent)
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("nth")
    bytes_of = F.expr(f"substring(signature, nth * {BAND_ROWS} + 1, {BAND_ROWS})")
    bands = nodes.select("node", "signature", band).select("node", F.xxhash64("nth", bytes_of).alias("band"))
    order = F.struct(F.xxhash64("node").alias("order"), "node")
    leaders = bands.groupBy("band").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(leaders.select("band", F.col("first.node").alias("leader")), "band"), "bands")

    met = members.select("node").distinct()
    wanted = nodes.join(met, "node", "left_semi").select("node", "t1", "t2", "signature")
    found = wanted.join(texts.dropDuplicates(["t1", "t2"]), ["t1", "t2"])
    sets = stored(
        with_text_columns(found, "text", lambda: _shingles, {"shingles": "binary"}, ["node", "signature"]),
        "shingles",
    )
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    of_a = sets.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("shingles").alias("xa"))
    of_b = sets.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("shingles").alias("xb"))
    held = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "sa", "sb", "xa", "xb")
    parts = connected_components(held.mapInArrow(lambda batches: _confirm(percent, least, batches), "a bigint, b bigint"))

    open_rows = _open_members(members, parts, block).join(sets, "node")
    fields = ("lo", "hi", "own", "node", "part", "signature", "shingles")
    more = stored(
        open_rows.select("band", *fields)
        .groupBy("band", "lo", "hi")
        .applyInArrow(lambda table: _block_links(percent, least, table), "a bigint, b bigint"),
        "links",
    )
    return parts if more.isEmpty() else connected_components(parts.unionAll(more))


def minhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """`key`, `n_shingles`, `component_id` and `kept` of every row.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A
    text's set holds its distinct runs of five words, or its whole sequence if that is shorter.
    Rows whose sets have 100 * intersection >= percent * union are linked; a component's id is its
    smallest key, and `kept` marks the rows with that key. Null texts and ones without words have empty
    sets and are their own components. Repeated rows and copies are one node. Null keys are ignored for
    the id, which is null where a component has no other key. An empty table gives no rows;
    other columns are left behind. Shingles are compared by 64-bit names, whole sets by 128 bits.
    """
    outputs = ("n_shingles", "component_id", "kept")
    if key in outputs:
        raise ValueError(f"rename the key column {key!r}: it has an output's name")
    ship_package(docs.sparkSession)
    value = F.col(f"`{text}`").cast("string")
    hashed = docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(7), value).alias("t2"), value.alias("text")
    )

    def mark() -> Callable[[pa.Array], list[pa.Array]]:
        return _mark

    fields = {"n_shingles": "bigint", "d1": "bigint", "d2": "bigint", "signature": "binary"}
    marked = stored(with_text_columns(hashed, "text", mark, fields, ["id", "t1", "t2"]), "marked")
    same = marked.where("n_shingles > 0").groupBy("d1", "d2")
    one = same.agg(F.min("id").alias("lead"), F.min(F.struct("t1", "t2")).alias("t"), F.first("signature").alias("signature"))
    nodes = one.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "lead", "t.t1", "t.t2", "signature")
    # Written once, so the numbers stand.
    nodes = stored(nodes, "nodes")
    roots = _links(nodes, hashed.select("t1", "t2", "text"), percent, block)
    rooted = nodes.join(roots, nodes.node == roots.a, "left").select("d1", "d2", "lead", F.coalesce("b", "node").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    ids = rooted.join(leads, "root").select("d1", "d2", "component_id")
    full = marked.where("n_shingles > 0").join(ids, ["d1", "d2"]).select("id", "n_shingles", "component_id")
    empty = marked.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.unionAll(empty).select(
        F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
