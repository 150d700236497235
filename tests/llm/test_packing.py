import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm.packing import pack_documents, shortest_pack_first
from cohortlens.llm.tokens import word_encoder
from tests.llm.helpers import awkward_texts, docs_table, empty_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_remembered_ids_are_the_tokenizers_own(tokenizer):
    rng = random.Random(3)
    parts = ["a", "B", "'s", "É", "é", " ", "\n", "\t", "　", "Σ", "ς", "1", "½", "²", "!", "<|endoftext|>", "İ", "\xa0", "한", "ᄒ", "ᅡ", "\x1c", "\x85", "😀", "ß", "µ", "\xad", "'LL", "ÿ", "€"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, word_encoder(PATH).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_length_once(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randint(1, 100) for _ in range(rng.randint(0, 400)))
    patterns = shortest_pack_first(dict(histogram), 100)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 100 and count > 0 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += count
    assert used == histogram


@pytest.mark.parametrize("limit", [16, 2048])
def test_every_id_lies_in_one_place(spark, tokenizer, limit):
    rows = awkward_texts() + [(100 + i, "same text") for i in range(50)]
    pieces = pack_documents(docs_table(spark, rows), PATH, limit=limit).collect()
    want = Counter()
    ids = {}
    for key, text in rows:
        own = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids[key] = own
        for start in range(0, len(own), limit):
            part = own[start : start + limit]
            want[key, start, len(part), zlib.crc32(part.tobytes()), len(own)] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit


def test_little_padding(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("the of and to in is it that was for on are".split(), k=int(rng.lognormvariate(5.5, 1))))) for i in range(1500)]
    pieces = pack_documents(docs_table(spark, rows), PATH).collect()
    used = Counter()
    for p in pieces:
        used[p["sequence_id"]] += p["length"]
    padding = sum(2048 - n for n in used.values() if n & (n - 1))
    assert padding < 0.03 * sum(used.values())


def test_empty_table(spark):
    assert pack_documents(empty_docs(spark), PATH).count() == 0
