"""Token alignment of two vocabularies by lockstep merging of all documents of a batch.

One state vector holds, for each document of a batch, a pointer to a token of A and one to a token
of B. In each step every document links its two tokens and moves the pointer of the token that
ends first (both where they end together, which is a cut); finished documents leave the vector. Links
are counted by id pair over the whole corpus, and each document's links then meet their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import byte_runs, slices
from cohortlens.llm.store import stored
from cohortlens.llm.subwords import UnitEncoder, Units, unit_encoder
from cohortlens.llm.wordstore import gather
from cohortlens.shipping import ship_package

# Bytes of text that are merged at once, and that share one list of id pairs.
RUN_BYTES, CHUNK_BYTES = 1 << 21, 1 << 25
# A document of more tokens than this enters the state vector in parts, cut where tokens of both end.
LANE_TOKENS = 256
# Distinct units of a chunk that are merged at once.
_UNITS = 100_000


@dataclass
class Links:
    """All links of a batch in order: token numbers in A and B, and whether both tokens end there."""

    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray


def _lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_stop: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Past tokens of A and B of each lane: the documents, and common ends about every `long` tokens within long ones."""
    inner = np.arange(long - 1, len(a_ends), long)
    inner = inner[np.diff(a_stop, prepend=0)[np.searchsorted(a_stop, inner, side="right")] > long]
    at = np.searchsorted(b_ends, a_ends[inner])
    shared = b_ends[at] == a_ends[inner]
    stops = np.union1d(a_stop[a_stop > 0], inner[shared] + 1)
    return stops, np.searchsorted(b_ends, a_ends[stops - 1]) + 1


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_stop: np.ndarray, long: int = LANE_TOKENS) -> Links:
    """Merge the tokens of all documents at once.

    `a_ends` and `b_ends` are the tokens' end offsets over the batch, documents end to end; `a_stop` is the
    number of A tokens up to the end of each document, where a token of B ends too.
    """
    none = np.zeros(0, np.int64)
    if not len(a_ends):
        return Links(none, none, np.zeros(0, bool))
    stop, b_stop = _lanes(a_ends, b_ends, a_stop, long)
    a, b = np.append(0, stop[:-1]), np.append(0, b_stop[:-1])
    lane, steps = np.arange(len(stop)), np.zeros(len(stop), np.int64)
    links = []
    step = 0
    while len(lane):
        ends_a, ends_b = a_ends[a], b_ends[b]
        cut = ends_a == ends_b
        links.append((lane, a, b, cut))
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
        step += 1
        going = a < stop
        if not going.all():
            steps[lane[~going]] = step
            a, b, lane, stop = a[going], b[going], lane[going], stop[going]
    # A lane's link of a step goes behind the links of all lanes before it.
    first = np.cumsum(steps) - steps
    sizes = [len(x[0]) for x in links]
    place = first[np.concatenate([x[0] for x in links])] + np.repeat(np.arange(len(links)), sizes)
    out = Links(np.empty(len(place), np.int64), np.empty(len(place), np.int64), np.empty(len(place), bool))
    for k, name in enumerate(("a", "b", "cut"), 1):
        getattr(out, name)[place] = np.concatenate([x[k] for x in links])
    return out


class Aligned:
    """A batch of texts with its tokens and links; `stop_*` count tokens and links up to each text's end."""

    def __init__(self, encoder: UnitEncoder, units: Units):
        self.a, self.b = (
            gather(ids, np.cumsum(per) - per, per, units.codes) for ids, per in ((units.a, units.per_a), (units.b, units.per_b))
        )
        text = np.repeat(np.arange(len(units.per_text)), units.per_text)
        count = lambda per: np.cumsum(np.bincount(text, per[units.codes], len(units.per_text))).astype(np.int64)
        self.stop_a, self.stop_b = count(units.per_a), count(units.per_b)
        self.links = lockstep(np.cumsum(encoder.a_bytes[self.a]), np.cumsum(encoder.b_bytes[self.b]), self.stop_a)
        self.stop_links = np.searchsorted(self.links.a, self.stop_a)
        # Tokens at which a group ends.
        self.cut_a, self.cut_b = self.links.a[self.links.cut], self.links.b[self.links.cut]
        self.stop_groups = np.searchsorted(self.cut_a, self.stop_a)

    def pairs(self, size_b: int) -> np.ndarray:
        """The id pair of each link as one number."""
        return self.a[self.links.a] * size_b + self.b[self.links.b]

    def group_texts(self, spelled: np.ndarray) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` of each text; `spelled` has every id with a comma, then with a bar, then with a semicolon."""
        size = len(spelled) // 3
        many_a, many_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        shown = np.empty(len(self.a) + len(self.b), np.int64)
        ids_a, ids_b = self.a.copy(), self.b.copy()
        ids_a[self.cut_a] += size
        ids_b[self.cut_b] += 2 * size
        shown[np.arange(len(self.a)) + np.repeat(np.cumsum(many_b) - many_b, many_a)] = ids_a
        shown[np.arange(len(self.b)) + np.repeat(np.cumsum(many_a), many_b)] = ids_b
        stops = (self.stop_a + self.stop_b).tolist()
        for start, stop in zip([0, *stops], stops):
            yield "".join(spelled[shown[start:stop]].tolist())[:-1]


def _spelled(size: int) -> np.ndarray:
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], object)


def _per_text(stops: np.ndarray) -> np.ndarray:
    return np.diff(stops, prepend=0)


_DIGEST = ("n_a", "n_b", "n_groups", "n_links")


def _merge_counts(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


class _Chunk:
    """What the runs of a chunk share: its distinct units by number, and its id pairs with their counts."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.units = pa.array([], pa.large_string())
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, encoder: UnitEncoder, units: Units, found: Aligned, size: int) -> np.ndarray:
        """Count a run in; the chunk's own codes of the run's units."""
        pair, n = np.unique(found.pairs(encoder.b.size), return_counts=True)
        self.pairs.append(pair)
        self.counts.append(n)
        self.bytes += size
        at = pc.index_in(units.names, value_set=self.units)
        own = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = units.names.filter(pc.is_null(at))
        own[own < 0] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, new])
        return own[units.codes]

    def links(self, encoder: UnitEncoder, pair: np.ndarray) -> bytes:
        """The number of links of each unit, then each link's place among the chunk's pairs."""
        many, places = [], []
        for at in range(0, len(self.units), _UNITS):
            some = self.units.slice(at, _UNITS)
            found = Aligned(encoder, Units(some, np.arange(len(some)), np.ones(len(some), np.int64), *encoder.ids(some)))
            many.append(_per_text(found.stop_links))
            places.append(np.searchsorted(pair, found.pairs(encoder.b.size)))
        # Units of texts without tokens alone may have pairs that are not counted; nothing asks for them.
        whole = np.minimum(np.concatenate([*places, np.zeros(0, np.int64)]), max(0, len(pair) - 1))
        return b"".join(x.astype("<u4").tobytes() for x in (np.array([len(self.units)]), *many, whole))


def _align(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs (chunk, docs, data: their units) and one of each chunk (data: its units' links, pairs with counts)."""
    encoder = unit_encoder(a_path, b_path)
    spelled = _spelled(max(encoder.a.size, encoder.b.size))
    pack = zstandard.ZstdCompressor(level=1).compress
    pair_type = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
    chunk = _Chunk(TaskContext.get().partitionId() << 24)

    def row(docs: pa.Array, data: bytes, pairs: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk.number]), docs, pa.array([pack(data)], pa.binary()), pairs], names=["chunk", "docs", "data", "pairs"]
        )

    def chunk_end() -> pa.RecordBatch:
        pair, n = _merge_counts(chunk.pairs, chunk.counts)
        listed = pa.StructArray.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
        held = pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), listed)
        return row(pa.nulls(1, docs_type), chunk.links(encoder, pair), held)

    docs_type = None
    for batch in slices(batches):
        for first, past, size in byte_runs(batch.column(1), RUN_BYTES):
            keys, texts = batch.column(0).slice(first, past - first), batch.column(1).slice(first, past - first)
            units = encoder.units(texts)
            found = Aligned(encoder, units)
            codes = chunk.add(encoder, units, found, size)
            digests = [hashlib.sha256(shown.encode()).hexdigest() if shown else "" for shown in found.group_texts(spelled)]
            per_text = [_per_text(x) for x in (found.stop_a, found.stop_b, found.stop_groups, found.stop_links)]
            fields = [keys, *(pa.array(x) for x in per_text), pa.array(digests), pa.array(units.per_text)]
            rows = pa.StructArray.from_arrays(fields, names=["key", *_DIGEST, "groups_sha256", "n_units"])
            docs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            docs_type = docs.type
            yield row(docs, codes.astype("<u4").tobytes(), pa.nulls(1, pair_type))
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk_end()
                chunk = _Chunk(chunk.number + 1)
    if chunk.pairs:
        yield chunk_end()


def _score(runs: pa.Table, told: pa.Table) -> pa.Table:
    """Each document of a chunk with its sums; `told` has the chunk's pairs with count and best."""
    unpack = zstandard.ZstdDecompressor().decompress
    pair = told.column("pair").to_numpy()
    order = np.argsort(pair)
    count = told.column("count").to_numpy()[order]
    best = told.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    ends = runs.filter(pc.is_null(runs.column("docs")))
    data = np.frombuffer(unpack(ends.column("data")[0].as_py()), "<u4").astype(np.int64)
    stops, places = np.cumsum(data[1 : 1 + data[0]]), data[1 + data[0] :]

    def by_stop(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values))[stops], prepend=0)

    sums, highest = (by_stop(values[places] if len(pair) else np.zeros(0, np.int64), stops) for values in (count, best))
    out = []
    own = runs.filter(pc.is_valid(runs.column("docs")))
    for docs, units in zip(own.column("docs"), own.column("data")):
        rows = docs.values
        codes = np.frombuffer(unpack(units.as_py()), "<u4").astype(np.int64)
        texts = np.cumsum(rows.field("n_units").to_numpy())
        out.append(
            pa.table(
                {"key": rows.field("key")}
                | {c: rows.field(c) for c in _DIGEST}
                | {"n_best": by_stop(highest[codes], texts), "count_sum": by_stop(sums[codes], texts)}
                | {"groups_sha256": rows.field("groups_sha256")}
            )
        )
    return pa.concat_tables(out)


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's alignment: `key`, token, group and link counts, `n_best`, `count_sum` and the digest of its groups.

    The first pass tokenises and merges every text, and writes the texts' units, and once for each chunk of about 32 MB
    of text the links of its distinct units and its id pairs (compressed). Pairs are counted over the corpus, each chunk
    asks for its own pairs' counts by join, and the second pass sums them over units and texts. A link's count is how many links
    of the corpus hold its id pair; `n_best` counts links with the highest count of their B id, ties included.
    Null and empty texts, and texts that their tokens do not spell byte by byte, have zeros and the digest ''.
    Repeated rows and null keys are rows like others; other columns are left behind; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    outputs = (*_DIGEST, "n_best", "count_sum", "groups_sha256")
    if key in outputs:
        raise ValueError(f"rename the key column {key!r}: it has an output's name")
    kind = dict(docs.dtypes)[key]
    doc = f"struct<key:{kind}," + ",".join(f"{c}:bigint" for c in _DIGEST) + ",groups_sha256:string,n_units:bigint>"
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    aligned = stored(
        rows.mapInArrow(
            lambda batches: _align(a_path, b_path, batches),
            f"chunk bigint, docs array<{doc}>, data binary, pairs array<struct<pair:bigint,n:bigint>>",
        ),
        "aligned",
    )
    size_b = unit_encoder(a_path, b_path).b.size
    asked = aligned.where("pairs is not null").select("chunk", F.inline("pairs"))
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    # At most one row for each id of B.
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("highest"))
    judged = counts.withColumn("b", F.col("pair") % size_b).join(F.broadcast(highest), "b")
    best = judged.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = asked.select(F.col("chunk").alias("of_chunk"), "pair").join(best, "pair")
    runs = aligned.select("chunk", "docs", "data")
    schema = f"key {kind}, " + ", ".join(f"{c} bigint" for c in outputs[:-1]) + ", groups_sha256 string"
    scored = runs.groupBy("chunk").cogroup(told.groupBy("of_chunk")).applyInArrow(_score, schema)
    return scored.select(F.col("key").alias(key), *outputs)


def _listed(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(values))


def _spans(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = unit_encoder(a_path, b_path)
    for batch in slices(batches):
        for first, past, _ in byte_runs(batch.column(1), RUN_BYTES):
            found = Aligned(encoder, encoder.units(batch.column(1).slice(first, past - first)))
            before = lambda stops: np.append(0, stops[:-1])
            own = lambda values, of, stops: values - np.repeat(before(of), _per_text(stops))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, past - first),
                    _listed(found.a, found.stop_a),
                    _listed(found.b, found.stop_b),
                    _listed(own(found.cut_a + 1, found.stop_a, found.stop_groups), found.stop_groups),
                    _listed(own(found.cut_b + 1, found.stop_b, found.stop_groups), found.stop_groups),
                    _listed(own(found.links.a, found.stop_a, found.stop_links), found.stop_links),
                    _listed(own(found.links.b, found.stop_b, found.stop_links), found.stop_links),
                ],
                names=["key", "a_ids", "b_ids", "a_stops", "b_stops", "link_a", "link_b"],
            )


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment itself, without any shuffle: `key`, ids of both sides, where groups stop, and the links' token numbers."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    lists = ", ".join(f"{c} array<bigint>" for c in ("a_ids", "b_ids", "a_stops", "b_stops", "link_a", "link_b"))
    found = rows.mapInArrow(lambda batches: _spans(a_path, b_path, batches), f"key {dict(docs.dtypes)[key]}, {lists}")
    return found.withColumnRenamed("key", key)
