"""Ids of whole texts in a byte-level vocabulary (A) and a piece vocabulary (B), by remembered units.

No token of either vocabulary runs from a visible character on to a space or a line feed. So
a text whose words stand one space or line feed apart is cut before each of those, and the units, encoded
alone, give the ids of the whole. Any other text is a unit as a whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken

from cohortlens.llm.bytestrings import byte_letters
from cohortlens.llm.wordstore import Learned, WordStore, interleaved

# Units that stay in a worker's memory.
REMEMBERED = 200_000
# New words encoded at a time.
_JOINED = 4096

# Fixed value: the byte-level vocabulary's own split of texts.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts that are one unit: neighbouring or outer white space, or characters that may be white space or control.
_WHOLE = (
    r"[ \n][ \n]|[ \n]$|^[ \n]|[^\n !-~\x{A1}-\x{AC}\x{AE}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{52F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
)


# A unit without white space after its first character; only such units are cut apart again when joined.
_WORD = re.compile(r"[ \n][^ \n]+").fullmatch


class ByteVocabulary:
    """A tokenizer file of byte-level pair merges; strings of special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {token["content"] for token in told.get("added_tokens", []) if token["special"]}
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): number for token, number in told["model"]["vocab"].items() if token not in special
        }
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, number in ranks.items():
            self.bytes_of[number] = token
        self._encode = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, units: list[str]) -> list[list[int]]:
        return [self._encode(unit) for unit in units]


class PieceVocabulary:
    """A piece model that puts a space before each text and spells unknown characters in bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes_of = []
        for number in range(self.size):
            piece = self.model.id_to_piece(number)
            spelled = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes_of.append(bytes([int(spelled[1], 16)]) if spelled else piece.replace("▁", " ").encode())

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit; one that begins with a line feed loses the model's own space."""
        ids = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [own if u[0] == " " else own[1:] for u, own in zip(units, ids)]


@dataclass
class Units:
    """The units of a run of texts: the different ones, each text's codes into them, and their ids end to end."""

    names: pa.Array
    codes: np.ndarray
    per_text: np.ndarray
    a: np.ndarray
    b: np.ndarray
    per_a: np.ndarray
    per_b: np.ndarray


class UnitEncoder:
    """Encodes units with both vocabularies and remembers them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteVocabulary(a_path), PieceVocabulary(b_path)
        self.a_bytes = np.array([len(x) for x in self.a.bytes_of], np.int64)
        self.b_bytes = np.array([len(x) for x in self.b.bytes_of], np.int64)
        # Units whose joined tokens are not the unit have no ids.
        self.store = WordStore(self._learn, 2, REMEMBERED)

    def _learn(self, units: list[str]) -> Learned:
        """Ids of new units in A and B; words are encoded joined, the vocabularies cut them apart again."""
        word = np.array([bool(_WORD(u)) for u in units])
        rest, numbers = np.flatnonzero(~word), np.flatnonzero(word)
        parts = [(rest, self._alone([units[i] for i in rest.tolist()]))]
        for at in range(0, len(numbers), _JOINED):
            some = [units[i] for i in numbers[at : at + _JOINED].tolist()]
            parts.append((numbers[at : at + _JOINED], self._joined(some) or self._alone(some)))
        return interleaved(parts)

    def _joined(self, words: list[str]) -> Learned | None:
        """Ids by one call; None if they can't be told apart by word."""
        # The space in front is the one that B puts there itself.
        text = " a" + "".join(words)
        stops = np.cumsum([2, *(len(w.encode()) for w in words)])
        sides = []
        for vocabulary, lengths in ((self.a, self.a_bytes), (self.b, self.b_bytes)):
            ids = np.array(vocabulary.encode([text])[0], np.int64)
            ends = np.cumsum(lengths[ids])
            cuts = np.searchsorted(ends, stops)
            spelled = b"".join([vocabulary.bytes_of[i] for i in ids.tolist()]) == text.encode()
            if not spelled or not np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], stops):
                return None
            sides.append((ids[cuts[0] + 1 :], np.diff(cuts)))
        return sides

    def _alone(self, units: list[str]) -> Learned:
        sides: list[list] = [[], []]
        for unit, *both in zip(units, self.a.encode(units), self.b.encode(units)):
            spelled = unit.encode()
            same = all(b"".join([v.bytes_of[i] for i in ids]) == spelled for v, ids in zip((self.a, self.b), both))
            for side, ids in zip(sides, both):
                side.append(np.array(ids if same else [], np.int64))
        return [(np.concatenate([np.zeros(0, np.int64), *side]), np.array([len(x) for x in side], np.int64)) for side in sides]

    def ids(self, names: pa.Array) -> tuple[np.ndarray, ...]:
        """The ids of different units in A and B, and how many each has."""
        places = self.store.places(names)
        found = [self.store.numbers(side, places).astype(np.int64) for side in (0, 1)]
        return *found, *(self.store.counts[side][places] for side in (0, 1))

    def units(self, texts: pa.Array) -> Units:
        """Cuts the texts; null and empty texts, and those that their tokens do not spell, have no units."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _WHOLE)
        cut = pc.if_else(whole, pa.scalar("", pa.large_string()), texts)
        parts = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        told = parts.flatten().dictionary_encode()
        first_line = pc.starts_with(told.dictionary, "\n")
        space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        names = pc.if_else(first_line, told.dictionary, pc.binary_join_element_wise(space, told.dictionary, none))
        codes = told.indices.to_numpy().astype(np.int64)
        per_text = parts.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(per_text) - per_text
        # A blanked text has one empty part, which is dropped or stands for the whole text.
        blank = np.flatnonzero(pc.equal(cut, "").to_numpy(zero_copy_only=False))
        is_whole = whole.to_numpy(zero_copy_only=False)[blank]
        distinct = texts.take(pa.array(blank[is_whole])).dictionary_encode()
        codes[first[blank[is_whole]]] = len(names) + distinct.indices.to_numpy()
        names = pa.concat_arrays([names, pc.binary_join_element_wise(space, distinct.dictionary, none)])
        keep = np.ones(len(codes), bool)
        keep[first[blank[~is_whole]]] = False
        per_text[blank[~is_whole]] = 0
        codes = codes[keep]

        a, b, per_a, per_b = self.ids(names)
        wrong = per_a[codes] == 0
        if wrong.any():
            text = np.repeat(np.arange(len(per_text)), per_text)
            bad = np.zeros(len(per_text), bool)
            bad[text[wrong]] = True
            codes, per_text = codes[~bad[text]], np.where(bad, 0, per_text)
        return Units(names, codes, per_text, a, b, per_a, per_b)


@lru_cache(maxsize=1)
def unit_encoder(a_path: str, b_path: str) -> UnitEncoder:
    """The worker's encoder of two vocabulary files; its memory lasts over tasks."""
    return UnitEncoder(a_path, b_path)
