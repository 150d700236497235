"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import with_text_columns
from cohortlens.llm.store import stored
from cohortlens.llm.tokens import END_ID, word_encoder

SEQUENCE_TOKENS = 2048
# Pieces of one length are numbered in so many independent groups at least, and in groups of about so many pieces.
_GROUPS, _GROUP_PIECES = 64, 200_000


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order) and how many sequences follow each.

    Lengths are placed longest first, always onto the shortest pack that exists; where it does
    not fit, it opens packs of its own. All packs of one pattern are handled as one count,
    so the work follows the number of distinct lengths.
    """
    done: list[tuple[tuple[int, ...], int]] = []
    open_packs: list[tuple[int, tuple[int, ...], int]] = []  # a heap by filled length

    def put(pattern: tuple[int, ...], filled: int, count: int) -> None:
        if filled == limit:
            done.append((pattern, count))
        else:
            heapq.heappush(open_packs, (filled, pattern, count))

    for length in sorted(histogram, reverse=True):
        waiting = histogram[length]
        while waiting:
            if open_packs and open_packs[0][0] + length <= limit:
                filled, pattern, count = heapq.heappop(open_packs)
                taken = min(count, waiting)
                if taken < count:
                    heapq.heappush(open_packs, (filled, pattern, count - taken))
                put((*pattern, length), filled + length, taken)
            else:
                taken = waiting
                put((length,), length, taken)
            waiting -= taken
    return done + [(pattern, count) for _, pattern, count in open_packs]


def _cut(limit: int, vocabulary: str, texts: pa.Array) -> list[pa.Array]:
    """Each text's pieces: start, length, checksum and the text's own number of ids."""
    end = np.array([END_ID], "<u4").tobytes()
    pieces = []
    for ids in word_encoder(vocabulary).encode_array(texts):
        data = ids + end
        total = len(data) // 4
        pieces.append(
            [
                {"start": at, "length": min(limit, total - at), "ids_crc32": zlib.crc32(data[4 * at : 4 * (at + limit)]), "doc_tokens": total}
                for at in range(0, total, limit)
            ]
        )
    fields = [(name, pa.int64()) for name in ("start", "length", "ids_crc32", "doc_tokens")]
    return [pa.array(pieces, pa.list_(pa.struct(fields)))]


def cut_documents(docs: DataFrame, key: str, text: str, vocabulary: str, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: the key, `start`, `length`, `ids_crc32` and `doc_tokens`.

    A document's ids end with the end id; it is cut every `limit` ids. Null and empty texts are
    the end id alone.
    """
    piece = "struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>"

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: _cut(limit, vocabulary, texts)

    cut = with_text_columns(docs, text, make, {"__pieces__": f"array<{piece}>"}, [key])
    return cut.select(F.col(f"`{key}`"), F.inline("__pieces__"))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """By length and rank in order: where the run of ranks starts, its first sequence and its offset."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        for length, offset in zip(pattern, accumulate(pattern, initial=0)):
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, offset))
            next_rank[length] = rank + count
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def _place(slots: tuple[np.ndarray, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lengths, ranks, sequences, offsets = slots
    first = {length: at for at, length in reversed(list(enumerate(lengths.tolist())))}
    past = {length: at + 1 for at, length in enumerate(lengths.tolist())}
    for batch in batches:
        names = batch.schema.names
        own, rank = (batch.column(names.index(n)).to_numpy() for n in ("length", "__rank__"))
        slot = np.zeros(len(own), np.int64)
        for length in np.unique(own).tolist():
            rows = np.flatnonzero(own == length)
            low, high = first[length], past[length]
            slot[rows] = low + np.searchsorted(ranks[low:high], rank[rows], side="right") - 1
        sequence = pa.array(sequences[slot] + rank - ranks[slot])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], sequence, pa.array(offsets[slot])], names=[*names[:-1], "sequence_id", "offset"]
        )


def pack_documents(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = SEQUENCE_TOKENS
) -> DataFrame:
    """Every piece of every document with its `sequence_id` and `offset` in the sequence.

    `vocabulary` is the path of the tokenizer file. Pieces (see `cut_documents`) are written
    once. The driver sees the histogram of piece lengths (at most `limit` numbers) and
    answers with the patterns; each piece finds its place by its rank among the pieces of its
    length. Ranks are counted in groups by hash, so that a length that most pieces share is
    numbered by many tasks. Repeated documents are packed each on its own; a null key is a
    key like any other; an empty table gives no rows; other columns are left behind.
    """
    pieces = stored(cut_documents(docs, key, text, vocabulary, limit), "pieces")
    columns = pieces.columns
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(shortest_pack_first(histogram, limit)))
    groups = max(_GROUPS, sum(histogram.values()) // _GROUP_PIECES)
    grouped = pieces.withColumn("__group__", F.pmod(F.xxhash64(*columns), F.lit(groups)))
    counts = grouped.groupBy("length", "__group__").agg(F.count("*").alias("__n__"))
    before = F.sum("__n__").over(Window.partitionBy("length").orderBy("__group__")) - F.col("__n__")
    bases = counts.select("length", "__group__", before.alias("__base__"))
    nth = F.row_number().over(Window.partitionBy("length", "__group__").orderBy(*columns))
    numbered = grouped.withColumn("__nth__", nth).join(bases, ["length", "__group__"])
    ranked = numbered.select(*(F.col(f"`{c}`") for c in columns), (F.col("__base__") + F.col("__nth__") - 1).alias("__rank__"))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in ranked.dtypes[:-1]) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(lambda batches: _place(slots.value, batches), schema)
