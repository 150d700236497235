import hashlib
import random
from collections import Counter

import pytest

from cohortlens.llm.suffixes import Shape, remove_repeats
from tests.llm.helpers import awkward_texts, docs_table, empty_docs


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        kept = bytes(c for c, gone in zip(b, covered) if not gone)
        spans = sum(1 for i, gone in enumerate(covered) if gone and not (i and covered[i - 1]))
        out.append((len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length):
    got = remove_repeats(docs_table(spark, rows), length=length).collect()
    want = sorted(zip((k for k, _ in rows), brute([t for _, t in rows], length)), key=str)
    assert sorted(((r["doc_id"], (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"])) for r in got), key=str) == want
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert r["fingerprint"] == "own"
    return want


@pytest.mark.parametrize("length", [1, 5, 12, 40, 200])
def test_equals_brute_force(spark, length):
    rng = random.Random(length)
    base = ["".join(rng.choices("ab é", k=rng.randint(0, 3 * length))) for _ in range(15)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, length) :] for _ in range(rng.randint(0, 4)))) for i in range(80)]
    rows += [(100, "ab" * length), (101, "x" * (2 * length)), (102, rows[3][1]), (103, None), (104, ""), (104, "q" * length), (104, "q" * length)]
    want = check(spark, rows, length)
    assert any(w[1][1] for w in want)


def test_awkward_texts(spark):
    check(spark, awkward_texts(), 60)


def test_a_passage_in_many_documents(spark):
    """Most rows share one passage in contexts of their own, so its names are frequent."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=500))
    rows = [(i, "".join(rng.choices("ijklmn ", k=90)) + passage + "".join(rng.choices("opqrst ", k=90))) for i in range(2500)]
    rows += [(5000 + i, passage) for i in range(1500)]
    got = remove_repeats(docs_table(spark, rows)).collect()
    assert all(r["n_removed"] >= len(passage) for r in got)
    want = dict(zip((k for k, _ in rows), brute([t for _, t in rows], 200)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got} == want


def test_text_without_cut_characters(spark):
    text = "é" * 150
    rows = [(1, "a" + text + "z"), (2, "b" + text + "y")]
    kept = {r["doc_id"]: r["kept_text"] for r in remove_repeats(docs_table(spark, rows)).collect()}
    assert kept == {1: "az", 2: "by"}


@pytest.mark.parametrize("length", range(1, 260, 7))
def test_shapes_fit(length):
    shape = Shape.of(length)
    assert shape.spread + shape.gram - 1 <= length and shape.spread <= 128 and shape.gram >= 1
    assert shape.sizes[-1] == 1 and shape.sizes == sorted(shape.sizes, reverse=True)


def test_empty_table(spark):
    assert remove_repeats(empty_docs(spark)).count() == 0
