"""A worker's memory of what words stand for, looked up for many different words at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# For each word a list of numbers per side: all numbers end to end, and how many each word has.
Learned = list[tuple[np.ndarray, np.ndarray]]


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of each place one after another; place k has `counts[k]` values from `starts[k]` on."""
    many = counts[places]
    shift = starts[places] - (np.cumsum(many) - many)
    return values[np.repeat(shift, many) + np.arange(int(many.sum()))]


def interleaved(parts: list[tuple[np.ndarray, Learned]]) -> Learned:
    """Learned lists of several groups of words in one order; each group comes with its words' numbers in that order."""
    order = np.argsort(np.concatenate([numbers for numbers, _ in parts]), kind="stable")
    out = []
    for side in range(len(parts[0][1])):
        values, counts = (np.concatenate([learned[side][k] for _, learned in parts]) for k in (0, 1))
        counts = counts.astype(np.int64)
        out.append((gather(values, np.cumsum(counts) - counts, counts, order), counts[order]))
    return out


class WordStore:
    """Lists of numbers by word. `learn` works out new words; of old ones the `size` last used stay."""

    def __init__(self, learn: Callable[[list[str]], Learned], sides: int, size: int):
        self.learn, self.size, self.turn = learn, size, 0
        self.words = pa.array([], pa.large_string())
        self.values = [np.zeros(0, np.uint32) for _ in range(sides)]
        self.counts = [np.zeros(0, np.int64) for _ in range(sides)]
        self.starts = [np.zeros(0, np.int64) for _ in range(sides)]
        self.used = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        if len(self.words) <= 2 * self.size:
            return
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.size])
        self.words = self.words.take(pa.array(keep))
        self.used = self.used[keep]
        for side, values in enumerate(self.values):
            self.values[side] = gather(values, self.starts[side], self.counts[side], keep)
            self.counts[side] = self.counts[side][keep]
            self.starts[side] = np.cumsum(self.counts[side]) - self.counts[side]

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some different words stands; good until the next call."""
        self._shrink()
        self.turn += 1
        at = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(at)
        found = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(missing)
        if len(new):
            found[found < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
            for side, (values, counts) in enumerate(self.learn(new.to_pylist())):
                self.values[side] = np.concatenate([self.values[side], values.astype(np.uint32)])
                self.counts[side] = np.concatenate([self.counts[side], counts.astype(np.int64)])
                self.starts[side] = np.cumsum(self.counts[side]) - self.counts[side]
        self.used[found] = self.turn
        return found

    def numbers(self, side: int, places: np.ndarray) -> np.ndarray:
        """The numbers of the words at some places, one word after another."""
        return gather(self.values[side], self.starts[side], self.counts[side], places)
