"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. For all patterns of one length m, a shift table over blocks of two
words tells how far the end of the search window may move without passing over an
occurrence; where the shift is zero, the hash of the window's suffix block and of the
whole window selects the patterns, and their words are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import Rolling, lower_ascii, runs, text_bytes, with_text_columns, word_spans

WINDOW_WORDS = 10
# Benchmark items are searched for in blocks of about this many words, each a broadcast of its own.
BLOCK_WORDS = 1_000_000
# Frontiers of the search advance together, one for each so many window positions.
_STRETCH = 64

_BYTES, _WORDS = Rolling(11), Rolling(12)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each word the hash of the block that ends there (meaningless before the first full block)."""
    if size == 1 or not len(hashes):
        return hashes
    out = hashes.copy()
    out[1:] = hashes[1:] + hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    return out


class WordPatterns:
    """Search tables for patterns of exactly `length` words."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]):
        self.length = length
        self.block = min(2, length)
        self.texts = list(patterns)
        self.items = [patterns[t] for t in self.texts]
        # Each pattern is followed by a line feed, which is no word.
        joined = np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8)
        starts, ends, _ = word_spans(joined, np.array([len(joined)]))
        words = _BYTES.between(_BYTES.prefix(joined), starts, ends)
        grid = words.reshape(len(self.texts), length)
        bits = max(10, int(grid.size * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, np.int32)
        blocks = _blocks(words, self.block).reshape(grid.shape)
        for last in range(self.block - 1, length):
            slots = (blocks[:, last] & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slots, length - 1 - last)
        first = np.arange(len(self.texts)) * length
        whole = _WORDS.between(_WORDS.prefix(words), first, first + length)
        order = np.argsort(whole, kind="stable")
        self.whole, self.order = whole[order], order

    def occurrences(self, data, starts, ends, words, prefix, first_word, word_counts):
        """Word positions where an occurrence starts, and the pattern's number."""
        m = self.length
        windows = np.maximum(word_counts - m + 1, 0)
        stretches = -(-windows // _STRETCH)
        text = np.repeat(np.arange(len(windows)), stretches)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = first_word[text] + nth * _STRETCH + m - 1
        past = np.minimum(at + _STRETCH, first_word[text] + word_counts[text])
        blocks = _blocks(words, self.block)
        found = []
        while len(at):
            step = self.shift[(blocks[at] & self.mask).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            alive = at < past
            at, past = at[alive], past[alive]
        end = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        begin = end - m + 1
        whole = _WORDS.between(prefix, begin, end + 1)
        slot = np.searchsorted(self.whole, whole)
        same = (slot < len(self.whole)) & (self.whole[np.minimum(slot, len(self.whole) - 1)] == whole)
        at_word, which = [], []
        for word, low, value in zip(begin[same].tolist(), slot[same].tolist(), whole[same]):
            shown = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(word, word + m))
            while low < len(self.whole) and self.whole[low] == value:
                if self.texts[self.order[low]] == shown:
                    at_word.append(word)
                    which.append(int(self.order[low]))
                low += 1
        return np.array(at_word, np.int64), np.array(which, np.int64)


def item_patterns(texts: list[str], window: int = WINDOW_WORDS) -> dict[int, dict[bytes, list[int]]]:
    """By length in words, every pattern and the numbers of the items that have it."""
    out: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for number, text in enumerate(texts):
        data, ends = text_bytes(pa.array([text], pa.string()))
        lowered = lower_ascii(data)
        starts, stops, _ = word_spans(lowered, ends)
        words = [lowered[a:b].tobytes() for a, b in zip(starts, stops)]
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if words else 0):
            have = out[length][b" ".join(words[at : at + length])]
            if not have or have[-1] != number:
                have.append(number)
    return out


def _benchmark_blocks(items: DataFrame, item_id: str, text: str, window: int):
    """(item ids, patterns) of successive blocks of items."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    for key, value in rows.toLocalIterator():
        ids.append(key or "")
        texts.append(value)
        size += value.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield ids, {n: dict(p) for n, p in item_patterns(texts, window).items()}
            ids, texts, size = [], [], 0
    if ids:
        yield ids, {n: dict(p) for n, p in item_patterns(texts, window).items()}


def _judge(tables: list, texts: pa.Array) -> list[pa.Array]:
    """The output columns of a batch of texts."""
    n_words, n_hit, hits, item_ids = [], [], [], []
    for first, past, data, text_ends in runs(texts):
        data = lower_ascii(data)
        starts, ends, counts = word_spans(data, text_ends)
        words = _BYTES.between(_BYTES.prefix(data), starts, ends)
        prefix = _WORDS.prefix(words)
        first_word = np.cumsum(counts) - counts
        cover = np.zeros(len(words) + 1, np.int64)
        found = defaultdict(set)
        for ids, patterns in tables:
            for table in patterns:
                at, which = table.occurrences(data, starts, ends, words, prefix, first_word, counts)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + table.length, -1)
                owner = np.searchsorted(first_word + counts, at, side="right")
                for row, pattern in zip(owner.tolist(), which.tolist()):
                    found[row].update(ids[i] for i in table.items[pattern])
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        per_text = total[first_word + counts] - total[first_word]
        n_words.append(counts)
        n_hit.append(per_text)
        for row in range(past - first):
            if per_text[row]:
                own = hit[first_word[row] : first_word[row] + counts[row]]
                edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                hits.append([{"first": a, "past": b} for a, b in zip(edges[::2], edges[1::2])])
            else:
                hits.append([])
            item_ids.append(sorted(found[row]) if row in found else [])
    hit_counts = np.concatenate(n_hit) if n_hit else np.zeros(0, np.int64)
    word_counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
    return [
        pa.array(word_counts, pa.int64()),
        pa.array(hit_counts, pa.int64()),
        pa.array(hits, span),
        pa.array(item_ids, pa.list_(pa.string())),
        pa.array(hit_counts > 0, pa.bool_()),
    ]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per document: `n_words`, `n_hit`, `hits`, `item_ids` and `contaminated`.

    A word is a run of `0-9`, `a-z` and characters beyond ASCII, after A-Z is lower-cased. An
    item's windows are its runs of `window` words, or all its words where it has fewer. `hits`
    are the runs of document words inside any occurrence, as (first, past) word numbers;
    `item_ids` are the items with an occurring window, as sorted strings. One pass over the
    documents and no shuffle; the benchmark goes to the workers in blocks. Null and empty
    texts have no words, items without words no windows; a null item id counts as an empty
    string; items with equal ids are one item; repeated documents are judged alike. Input
    columns with an output's name are replaced.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(block) for block in _benchmark_blocks(items, item_id, item_text, window)]
    fields = {
        "n_words": "bigint",
        "n_hit": "bigint",
        "hits": "array<struct<first:int,past:int>>",
        "item_ids": "array<string>",
        "contaminated": "boolean",
    }

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        tables = [(b.value[0], [WordPatterns(n, p) for n, p in b.value[1].items()]) for b in blocks]

        return lambda texts: _judge(tables, texts)

    return with_text_columns(docs, text, make, fields, keep)


def items_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
