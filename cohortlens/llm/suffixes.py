"""Removal of long repeated byte strings, by growing names of strings around a sparse set of positions.

Ranking every byte position by pairs of ranks would shuffle many times the corpus. Instead every string of
the wanted length is represented by its anchor, the position with the least hash among its
first `spread` grams. The anchor depends on the string's bytes alone, so equal strings have
anchors at equal places, and only anchors (about two in `spread` + 1 positions) are ranked.
Names are hashes of byte strings around the anchor, and the strings grow from round
to round: from the core that all strings of an anchor share, over the cores of ever smaller
groups of them, to the strings themselves. After each round Spark sorts the names; what is
unique drops out, what is repeated as a whole is decided, and only the rest goes on with
longer names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import Rolling, byte_runs, runs, slices, text_bytes
from cohortlens.llm.store import stored
from cohortlens.shipping import ship_package

LENGTH = 200
# Routing of very frequent names: found in one of so many documents, seen so often there, at most so many of them.
_SAMPLE, _SEEN, _FREQUENT, _SALTS = 64, 16, 10_000, 64

_CORE, _FULL = Rolling(21), Rolling(22)


@dataclass(frozen=True)
class Shape:
    """How strings of `length` bytes are represented."""

    length: int
    spread: int
    gram: int

    @staticmethod
    def of(length: int) -> Shape:
        spread = 1
        while 2 * spread <= min(128, int(0.65 * length)):
            spread *= 2
        return Shape(length, spread, min(16, length - spread + 1))

    @property
    def sizes(self) -> list[int]:
        """Sizes of the groups of strings in the rounds after the first."""
        out = [self.spread // 4] if self.spread >= 4 else []
        while out and out[-1] > 1:
            out.append(max(1, out[-1] // 4))
        return out or [1]


def _pack(anchor: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """An anchor and the range of distances by which its strings start before it, as one long."""
    return (anchor << 16) | (least << 8) | most


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 255, place & 255


def _least_gram(values: np.ndarray, spread: int) -> np.ndarray:
    """For each position the first position of the least value among `spread` from there on."""
    place, width = np.arange(len(values), dtype=np.int32), 1
    while width < spread:
        later = values[width:] < values[:-width]
        place = np.where(later, place[width:], place[:-width])
        values = np.where(later, values[width:], values[:-width])
        width *= 2
    return place


def _anchors(shape: Shape, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, packed place in the text, core name and full name of each anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < shape.length:
        return none, none, none, none
    core, full = _CORE.prefix(data), _FULL.prefix(data)
    grams = _CORE.every(core, shape.gram)
    place = _least_gram(grams, shape.spread)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    start = np.flatnonzero(np.arange(len(place)) + shape.length <= ends[owner[: len(place)]])
    if not len(start):
        return none, none, none, none
    anchor = place[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    anchor, text = anchor[new], owner[first]
    base = (ends - np.diff(ends, prepend=0))[text]
    tail = shape.length - shape.spread + 1
    return (
        text,
        _pack(anchor - base, anchor - last, anchor - first),
        _CORE.between(core, anchor, anchor + tail).view(np.int64),
        _FULL.between(full, first, last + shape.length).view(np.int64),
    )


def _scan(shape: Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, place, core, full, decided) of every anchor; input: doc, text."""
    for batch in slices(batches):
        docs = batch.column(0).to_numpy()
        for first, _, data, ends in runs(batch.column(1)):
            text, place, core, full = _anchors(shape, data, ends)
            yield _rows(docs[first + text], place, core, full, np.zeros(len(text), bool))


def _rows(doc, place, core, full, decided) -> pa.RecordBatch:
    arrays = [pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(core, pa.int64()), pa.array(full, pa.int64()), pa.array(decided, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "place", "core", "full", "decided"])


_ROWS = "doc bigint, place bigint, core bigint, full bigint, decided boolean"


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of a column stay below a run's bytes."""
    for batch in batches:
        for first, past, _ in byte_runs(batch.column(column)):
            yield batch.slice(first, past - first)
    pa.default_memory_pool().release_unused()


def _refine(shape: Shape, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of groups of `size` strings; input: doc, place, decided and the bytes of all the place's strings."""
    for batch in _parts(batches, 3):
        doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        decided = batch.column(2).to_numpy(zero_copy_only=False)
        contexts = batch.column(3).to_pylist()
        lengths = np.array([len(x) for x in contexts], np.int64)
        data = np.frombuffer(b"".join(contexts), np.uint8)
        anchor, least, most = _unpack(place)
        parts = most // size - least // size + 1
        row = np.repeat(np.arange(len(doc)), parts)
        low = (least[row] // size + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
        own_low, own_high = np.maximum(low, least[row]), np.minimum(low + size - 1, most[row])
        at = (np.cumsum(lengths) - lengths + most)[row]  # where the anchor is in `data`
        core, full = _CORE.prefix(data), _FULL.prefix(data)
        # Strings of one group match at equal distances only, so the distance is part of the name.
        name = _CORE.between(core, at - low, at + shape.length - low - size + 1) + low.astype(np.uint64)
        whole = _FULL.between(full, at - own_high, at - own_low + shape.length)
        yield _rows(doc[row], _pack(anchor[row], own_low, own_high), name.view(np.int64), whole.view(np.int64), decided[row])


def _frequent(sample: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A bounded list of names that the sample shows to be frequent (and so repeated)."""
    counts = sample.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= _SEEN)
    return counts.orderBy(F.desc("n"), *keys).limit(_FREQUENT).select(*keys, F.lit(True).alias(name))


def _resolve(rows: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """Sort the names: (doc, place, decided, goes_on) of all rows that are decided now or go on.

    A row is decided if its full string occurs again, and goes on (one row for each full
    string) if its core is shared with other full strings. Rows with a frequent core are dealt
    by their full name, and frequent full names, known to be repeated, over several tasks;
    this only decides where rows meet, not what becomes of them.
    """
    sample = stored(sample, f"{label}-sample")
    cores = F.broadcast(_frequent(sample, ["core"], "often"))
    fulls = F.broadcast(_frequent(sample, ["core", "full"], "known"))
    routed = rows.join(cores, "core", "left").join(fulls, ["core", "full"], "left")
    salt = F.pmod(F.xxhash64("doc"), F.lit(_SALTS))
    route = (
        F.when(F.col("known"), F.xxhash64("core", "full", salt)).when(F.col("often"), F.xxhash64("core", "full")).otherwise(F.col("core"))
    )
    routed = routed.select("doc", "place", "core", "full", "decided", "often", "known", route.alias("route"))
    same_full = Window.partitionBy("route", "core", "full").orderBy("doc", "place")
    whole = same_full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = routed.select(
        "*", (F.row_number().over(same_full) == 1).alias("first"), (F.count("*").over(whole) > 1).alias("again")
    )
    # Counting firsts also keeps this window above the finer one, so that one sort serves both.
    fulls_of_core = F.sum(F.col("first").cast("int")).over(Window.partitionBy("route"))
    judged = counted.withColumn("mixed", (fulls_of_core > 1) | F.coalesce("often", "known", F.lit(False)))
    repeated = F.col("again") | F.coalesce("known", F.lit(False))
    out = judged.select(
        "doc",
        "place",
        (F.col("decided") | repeated).alias("decided"),
        (repeated & ~F.col("decided")).alias("news"),
        (F.col("first") & F.col("mixed")).alias("goes_on"),
    )
    return stored(out.where("news or goes_on"), label)


def _contexts(shape: Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, place, decided, bytes of all the place's strings); input: doc, text, list of (place, decided)."""
    for batch in _parts(batches, 1):
        data, ends = text_bytes(batch.column(1))
        base = ends - np.diff(ends, prepend=0)
        lists = batch.column(2)
        entries = lists.flatten()
        place = entries.field(0).to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        anchor, least, most = _unpack(place)
        start, stop = base[row] + anchor - most, base[row] + anchor - least + shape.length
        whole = data.tobytes()
        context = [whole[a:b] for a, b in zip(start.tolist(), stop.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column(0).to_numpy()[row]), entries.field(0), entries.field(1), pa.array(context, pa.binary())],
            names=["doc", "place", "decided", "context"],
        )


def _trim(shape: Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each context down to its narrower place; input: doc, place, decided, context, wide place."""
    for batch in _parts(batches, 3):
        _, least, most = _unpack(batch.column(1).to_numpy())
        _, _, wide = _unpack(batch.column(4).to_numpy())
        start, stop = wide - most, wide - least + shape.length
        cut = [x[a:b] for x, a, b in zip(batch.column(3).to_pylist(), start.tolist(), stop.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cut, pa.binary())], names=["doc", "place", "decided", "context"])


_CONTEXT = "doc bigint, place bigint, decided boolean, context binary"


def _sampled(df: DataFrame) -> DataFrame:
    return df.where(F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(_SAMPLE)) == 0)


def repeated_places(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, place) such that all strings of the places are exactly those that occur again.

    `texts` has a long `doc` that tells different texts apart, and `text`. It is read twice
    and shuffled once.
    """
    ship_package(texts.sparkSession)
    shape = Shape.of(length)
    texts = texts.select("doc", "text")

    def scan(some: DataFrame) -> DataFrame:
        return some.mapInArrow(lambda batches: _scan(shape, batches), _ROWS)

    judged = _resolve(scan(texts), scan(_sampled(texts)), "anchors")
    decided = [judged.where("news").select("doc", "place")]
    going = judged.where("goes_on").groupBy("doc").agg(F.collect_list(F.struct("place", "decided")).alias("places"))
    contexts = texts.join(going, "doc").mapInArrow(lambda batches: _contexts(shape, batches), _CONTEXT)
    for size in shape.sizes:
        contexts = stored(contexts, "contexts")

        def refine(some: DataFrame, size: int = size) -> DataFrame:
            return some.mapInArrow(lambda batches: _refine(shape, size, batches), _ROWS)

        judged = _resolve(refine(contexts), refine(_sampled(contexts)), f"strings-{size}")
        decided.append(judged.where("news").select("doc", "place"))
        left = judged.where("goes_on").select("doc", "place", "decided", F.shiftright("place", 16).alias("anchor"))
        if size > 1:
            # A context serves all groups cut from its place; the group tells which place that was.
            wide = contexts.select("doc", F.col("place").alias("wide"), "context", F.shiftright("place", 16).alias("anchor"))
            inside = (F.col("place").bitwiseAND(255) <= F.col("wide").bitwiseAND(255)) & (
                F.shiftright("place", 8).bitwiseAND(255) >= F.shiftright("wide", 8).bitwiseAND(255)
            )
            joined = left.join(wide, ["doc", "anchor"]).where(inside)
            contexts = joined.select("doc", "place", "decided", "context", "wide").mapInArrow(
                lambda batches: _trim(shape, batches), _CONTEXT
            )
    out = decided[0]
    for more in decided[1:]:
        out = out.unionAll(more)
    return out


def _cut(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text; the last two input columns are the text and its list of places."""
    for batch in slices(batches):
        kept, sizes, removed, spans, digests = [], [], [], [], []
        texts, lists = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for text, places in zip(texts, lists):
            data = (text.as_py() or "").encode()
            runs_of_text = []
            if places.is_valid:
                anchor, least, most = _unpack(places.values.to_numpy())
                start, stop = anchor - most, anchor - least + length
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                # A run ends where the next string starts behind all that came before.
                edge = np.flatnonzero(start[1:] > stop[:-1])
                runs_of_text = list(zip(start[np.append(0, edge + 1)].tolist(), stop[np.append(edge, len(stop) - 1)].tolist()))
            left, at = [], 0
            for start_of, stop_of in runs_of_text:
                left.append(data[at:start_of])
                at = stop_of
            left.append(data[at:])
            rest = b"".join(left)
            kept.append(rest)
            sizes.append(len(data))
            removed.append(len(data) - len(rest))
            spans.append([{"start": a, "stop": b} for a, b in runs_of_text])
            digests.append(hashlib.sha256(rest).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-2],
                pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, span),
                pa.array(digests, pa.string()),
            ],
            names=[*batch.schema.names[:-2], "kept_text", "n_bytes", "n_removed", "removed", "kept_sha256"],
        )


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: list[str] | None = None
) -> DataFrame:
    """Removes each byte covered by a `length`-byte string that also starts anywhere else.

    Texts are their UTF-8 bytes (null: empty), matches lie within one text, and all strings are
    judged on the input. Adds `n_bytes`, `n_removed`, `removed` (maximal runs as start and stop
    bytes), `kept_sha256` of the remaining bytes, and `kept_text`: those bytes as text,
    without what a cut left of a character. Both copies of a repeated row count, so its
    text goes as a whole if it is long enough. `keep` names the input columns to pass on (all
    by default); one with an output's name is replaced. A text is known by a 64-bit hash of
    key and text. An empty table gives no rows.
    """
    outputs = {
        "kept_text": "string",
        "n_bytes": "bigint",
        "n_removed": "bigint",
        "removed": "array<struct<start:bigint,stop:bigint>>",
        "kept_sha256": "string",
    }
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    types = dict(docs.dtypes)
    value = F.col(f"`{text}`").cast("string")
    doc = F.xxhash64(F.col(f"`{key}`"), value)
    found = repeated_places(docs.select(doc.alias("doc"), value.alias("text")), length)
    lists = found.groupBy("doc").agg(F.collect_list("place").alias("__places__")).withColumnRenamed("doc", "__doc__")
    passed = docs.select(*(F.col(f"`{c}`") for c in kept), doc.alias("__doc__"), value.alias("__text__"))
    joined = passed.join(lists, "__doc__", "left").select(*(F.col(f"`{c}`") for c in kept), "__text__", "__places__")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*((c, types[c]) for c in kept), *outputs.items()])
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = lambda batches: _cut(length, batches)
    return joined.mapInArrow(run, schema)
