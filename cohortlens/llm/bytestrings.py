"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.shipping import ship_package

# Texts are taken in runs of about this many bytes, which bounds the arrays derived from them.
# A longer single text is a run of its own.
RUN_BYTES = 1 << 19

# Rows of an Arrow batch that are worked on together; a batch can hold 64 MB of text.
SLICE_ROWS = 1024

_U = np.uint64
_MIXER = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = (x ^ (x >> _U(32))) * _MIXER
    x = (x ^ (x >> _U(32))) * _MIXER
    return x ^ (x >> _U(32))


class Rolling:
    """Polynomial hashes modulo 2^64 of any substring, after one pass over the symbols."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.symbols = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, base in (("_up", self.base), ("_down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base & (2**64 - 1), np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array, or of an array of 64-bit symbols."""
        self._powers(len(symbols) + 1)
        values = self.symbols[symbols] if symbols.dtype == np.uint8 else symbols
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(values * self._up[: len(symbols)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * self._down[start])

    def every(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hash of the substring of `width` symbols at each position."""
        count = len(prefix) - width
        return mix((prefix[width:] - prefix[:count]) * self._down[:count])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# 0-9, a-z and everything outside ASCII, after A-Z is lower-cased.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def lower_ascii(symbols: np.ndarray) -> np.ndarray:
    return _LOWER[symbols]


def word_spans(lowered: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each text has; words end where texts do."""
    inside = _WORD[lowered]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = text_ends[:-1]
    cuts = cuts[cuts < len(lowered)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    upto = np.searchsorted(starts, text_ends)
    return starts, ends, np.diff(upto, prepend=0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end, and where each text ends. Null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and past row, bytes and text ends of each run of rows of about `limit` bytes."""
    data, ends = text_bytes(texts)
    row = 0
    while row < len(ends):
        base = int(ends[row - 1]) if row else 0
        past = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield row, past, data[base : int(ends[past - 1])], ends[row:past] - base
        row = past


def byte_runs(values: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, int]]:
    """First and past row, and bytes, of runs of rows of about `limit` bytes of strings; a longer one is a run of its own."""
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        base = int(ends[row - 1]) if row else 0
        past = max(row + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield row, past, int(ends[past - 1]) - base
        row = past


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into small ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    # The worker lives on for other tasks; it should not keep what this one needed.
    pa.default_memory_pool().release_unused()


def with_text_columns(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: dict[str, str],
    keep: list[str] | None = None,
) -> DataFrame:
    """`keep` (all columns by default) and `fields` computed from the text column, batch by batch.

    `make` runs once in every task and returns the function from a batch's texts to one
    array per field. An input column with a field's name is replaced.
    """
    ship_package(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields]
    types = dict(df.dtypes)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = make()
        for batch in slices(batches):
            arrays = per_batch(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*kept, *fields])

    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias("__text__"))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*((c, types[c]) for c in kept), *fields.items()])
    return source.mapInArrow(compute, schema)
