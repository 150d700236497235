"""Token ids of whole texts with a public word-level BPE vocabulary."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from cohortlens.llm.bytestrings import byte_letters, byte_runs
from cohortlens.llm.wordstore import Learned, WordStore, interleaved

END_ID = 1

# Words that stay in a worker's memory.
REMEMBERED = 250_000
# Unknown words encoded at a time, and bytes of text worked on together.
_JOINED, _RUN_BYTES = 4096, 1 << 22
# Stands for the end of a piece; no plain word has it.
_MARK = "\x01"
# Visible Latin-1, space and line feed: lower-casing and character classes are beyond doubt.
_PLAIN = re.compile("[ \n!-~\xa1-\xff]*").fullmatch
# Fixed value: the vocabulary's own split into pieces, for lower-cased plain text.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \n{_LETTERS}{_NUMBERS}]+").findall


class WordEncoder:
    """Ids of texts, by words that were met before.

    The vocabulary never joins anything across its pieces, nor across a space or a line feed. So
    texts are cut at those, and each distinct word of a run is looked up once. The pieces of new plain words
    are merged in bulk; any other word is encoded as it stands.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()

        def spelled(token: str) -> bytes:
            last = token.endswith("</w>")
            return bytes(letters[c] for c in token.removesuffix("</w>")) + _MARK.encode() * last

        # A piece's last byte and its mark are one symbol from the start, so these pairs merge before all others.
        ranks = {spelled(token): number for token, number in vocabulary.items() if "<|" not in token}
        order = sorted(ranks, key=lambda token: (not (len(token) == 2 and token.endswith(_MARK.encode())), ranks[token]))
        mark = [] if _MARK.encode() in ranks else [_MARK.encode()]
        self.numbers = np.array([*(ranks[token] for token in order), *(0 for _ in mark)], np.uint32)
        self.ends = np.array([token.endswith(_MARK.encode()) for token in [*order, *mark]])
        merged = {token: rank for rank, token in enumerate([*order, *mark])}
        self.merge = tiktoken.Encoding("pieces", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks=merged, special_tokens={}).encode_ordinary
        self.store = WordStore(self._learn, 1, REMEMBERED)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> Learned:
        """Plain words in bulk, others one by one."""
        plain = [bool(_PLAIN(w)) and "<|" not in w for w in words]
        rest = np.flatnonzero(~np.array(plain))
        own = [self._ids(words[i]) for i in rest.tolist()]
        parts = [(rest, [(np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64))])]
        numbers = np.flatnonzero(plain)
        for at in range(0, len(numbers), _JOINED):
            some = numbers[at : at + _JOINED]
            parts.append((some, [self._merged([words[i] for i in some.tolist()])]))
        return interleaved(parts)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [_PIECES(w.lower()) for w in words]
        per_word = np.array([len(p) for p in pieces], np.int64)
        joined = "".join([piece + _MARK for p in pieces for piece in p])
        merged = np.array(self.merge(joined), np.int64)
        # Tokens up to the end of each piece, and so of each word.
        stops = np.append(0, np.flatnonzero(self.ends[merged]) + 1)
        return self.numbers[merged], np.diff(stops[np.cumsum(per_word)], prepend=0)

    def encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has; null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        told = words.flatten().dictionary_encode()
        places = self.store.places(told.dictionary)[told.indices.to_numpy()]
        upto = np.append(0, np.cumsum(self.store.counts[0][places]))
        stops = np.cumsum(words.value_lengths().to_numpy().astype(np.int64))
        return self.store.numbers(0, places), np.diff(upto[stops], prepend=0)

    def encode_array(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers, run by run."""
        for first, past, _ in byte_runs(texts, _RUN_BYTES):
            ids, counts = self.encode_run(texts.slice(first, past - first))
            data, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for a, b in zip([0, *stops], stops):
                yield data[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return list(self.encode_array(pa.array(texts, pa.large_string())))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file; its memory lasts over tasks."""
    return WordEncoder(path)
