import random

import numpy as np
import pytest
import xxhash

from cohortlens.llm.components import connected_components, local_components
from cohortlens.llm.simhash import keep_one_per_component, near_edges, simhash_components, with_fingerprints
from tests.llm.helpers import awkward_texts, docs_table, empty_docs, words


def naive_fingerprint(text):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts, word = [], ""
    for c in own + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                parts.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] if len(parts) >= 3 else [" ".join(parts)] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, reach):
    """The smallest index of each value's component."""
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, rng.randint(60, 200)).split() for _ in range(12)]
    rows = awkward_texts()
    for i in range(150):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = "other"
        rows.append((100 + i, " ".join(own)))
    got = simhash_components(docs_table(spark, rows)).collect()
    assert len(got) == len(rows)
    values = [naive_fingerprint(text) for _, text in rows]
    roots = brute_components(values, 3)
    lead = {}
    for (key, _), root in zip(rows, roots):
        if key is not None:
            lead[root] = min(key, lead.get(root, key))
    want = sorted(((key, value, lead.get(root)) for (key, _), value, root in zip(rows, values, roots)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in got), key=str) == want
    # A third of the rows are near copies, so this is no empty exercise.
    assert len(set(roots)) < 0.8 * len(rows)


@pytest.mark.parametrize("shard", [8, 64, 100_000])
def test_shards_lose_no_link(spark, shard):
    rng = np.random.default_rng(shard)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = []
    for _ in range(900):
        value = int(rng.choice(centres))
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            value ^= 1 << int(bit)
        values.append(value)
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(3)
    edges = [(r["a"], r["b"]) for r in near_edges(table, 3, shard).collect()]
    assert all((a % 2**64 ^ b % 2**64).bit_count() for a, b in edges)
    at = {v: i for i, v in enumerate(signed)}
    label = local_components(len(signed), np.array([at[a] for a, _ in edges], int), np.array([at[b] for _, b in edges], int))
    assert label.tolist() == brute_components(values, 3)


def test_distributed_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes = sorted({x for e in edges for x in e})
    at = {v: i for i, v in enumerate(nodes)}
    label = local_components(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    want = {nodes[i]: nodes[root] for i, root in enumerate(label) if root != i}
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["a"]: r["b"] for r in found} == want and len(found) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = awkward_texts()
    docs = docs_table(spark, rows)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    components = {r["component_id"] for r in simhash_components(docs).collect()}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(components, key=str)


def test_components_with_one_smallest_key_keep_a_row_each(spark):
    rng = random.Random(6)
    texts = [words(rng, 80) for _ in range(5)]
    # Three texts with null keys alone, and a key on two unrelated texts, each with a copy under another key.
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (9, texts[3]), (7, texts[4]), (8, texts[4])]
    kept = keep_one_per_component(docs_table(spark, rows)).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert simhash_components(empty_docs(spark)).count() == 0
    assert keep_one_per_component(empty_docs(spark)).count() == 0
    assert with_fingerprints(empty_docs(spark)).count() == 0
