import random

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm.bytestrings import text_bytes
from cohortlens.llm.minhash import least_agreement, minhash_components, shingle_sets, signatures
from tests.llm.helpers import awkward_texts, docs_table, empty_docs, words


def naive_set(text):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        own = own.replace(c, " ")
    parts = [w for w in own.split(" ") if w]
    if len(parts) < 5:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}


def brute(rows, percent=85):
    """The wanted rows: key, set size, component id, kept."""
    sets = [naive_set(text) for _, text in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    lead = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lead[find(i)] = min(key, lead.get(find(i), key))
    return sorted(((key, len(s), lead.get(find(i)), key == lead.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, base, most):
    own = list(base)
    for _ in range(rng.randint(0, most)):
        own[rng.randrange(len(own))] = "w" + str(rng.randrange(10**6))
    return " ".join(own)


@pytest.mark.parametrize("block", [4, 256])
def test_components_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = awkward_texts()
    # Groups whose pairs lie on both sides of the threshold, so that leaders do not settle them.
    for size, most in ((60, 4), (150, 8), (150, 3), (40, 3)):
        base = words(rng, size).split()
        rows += [(1000 + len(rows) + i, edited(rng, base, most)) for i in range(40)]
    got = minhash_components(docs_table(spark, rows), block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    sizes = {}
    for r in got:
        sizes[r["component_id"]] = sizes.get(r["component_id"], 0) + 1
    assert max(sizes.values()) > 20 and len(sizes) > 40


def test_shingle_sets_and_signatures():
    rng = random.Random(2)
    texts = [text for _, text in awkward_texts()] + ["", "a b c d e f g a b c d e f g", "A\tB c\nd E", "a b c d e"]
    data, ends = text_bytes(pa.array(texts))
    names, counts = shingle_sets(data, ends)
    assert counts.tolist() == [len(naive_set(t)) for t in texts]
    stops = np.cumsum(counts)
    sets = [frozenset(names[a:b].tolist()) for a, b in zip(stops - counts, stops)]
    assert sets[-1] == sets[-2]
    for i, a in enumerate(texts):
        j = rng.randrange(len(texts))
        assert len(sets[i] & sets[j]) == len(naive_set(a) & naive_set(texts[j]))
    signed = signatures(names, counts)
    assert len(signed) == sum(c > 0 for c in counts) and (signed[-1] == signed[-2]).all()


def test_signatures_estimate_similarity():
    rng = random.Random(9)
    base = words(rng, 4000).split()
    data, ends = text_bytes(pa.array([" ".join(base), " ".join(base[:3600]), words(rng, 500)]))
    names, counts = shingle_sets(data, ends)
    signed = signatures(names, counts)
    assert 0.82 < (signed[0] == signed[1]).mean() < 0.97
    assert (signed[0] == signed[2]).mean() < 0.05
    assert 0.6 < least_agreement() / 240 < 0.75


def test_awkward_tables(spark):
    assert minhash_components(empty_docs(spark)).count() == 0
    rows = [(None, None), (None, "a b c"), (5, "A  b\nc"), (5, "A  b\nc"), (4, ""), (4, " ")]
    got = sorted((tuple(r) for r in minhash_components(docs_table(spark, rows)).collect()), key=str)
    want = [(None, 0, None, True), (None, 1, 5, False), (5, 1, 5, True), (5, 1, 5, True), (4, 0, 4, True), (4, 0, 4, True)]
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError, match="rename"):
        minhash_components(empty_docs(spark), key="kept")
