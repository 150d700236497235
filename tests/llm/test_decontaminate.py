import random
import re

import pytest

from cohortlens.llm.decontaminate import WordPatterns, find_contamination
from tests.llm.helpers import awkward_texts, docs_table, empty_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for key, text in docs:
        own = split(text)
        hit, ids = set(), set()
        for item, item_text in items:
            theirs = split(item_text)
            size = min(window, len(theirs))
            windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if theirs else set()
            for i in range(len(own) - size + 1) if windows else ():
                if tuple(own[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids.add(str(item) if item is not None else "")
        out.append((key, len(own), len(hit), sorted(ids)))
    return out


def rows_of(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    docs = awkward_texts() + [(200 + i, " ".join(rng.choices(["a", "b", "C!", "é", "ab"], k=rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(["a", "b", "c", "é", "ab"], k=rng.randint(0, 14)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "word"), (33, "Two words"), (32, "word"), (None, "no key but a text"), (34, "?!"), (10, "word")]
    items += [(40, (docs[5][1] or "")[300:900])]
    found = find_contamination(docs_table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=window)
    assert rows_of(found) == sorted(brute(docs, items, window), key=str)
    for row in found.collect():
        assert row["contaminated"] == (row["n_hit"] > 0) == bool(row["hits"])
        assert sum(h["past"] - h["first"] for h in row["hits"]) == row["n_hit"]
        assert row["fingerprint"] == "own"


def test_shifts_never_pass_an_occurrence():
    table = WordPatterns(3, {b"a b c": [0], b"b c d": [1]})
    assert int(table.shift.max()) == 2 and int(table.shift.min()) == 0


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(empty_docs(spark), items).count() == 0
    docs = docs_table(spark, awkward_texts())
    assert find_contamination(docs, items).where("contaminated").count() == 0


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr("cohortlens.llm.decontaminate.BLOCK_WORDS", 5)
    docs = awkward_texts()
    items = [(i, text) for i, (_, text) in enumerate(docs) if text]
    found = find_contamination(docs_table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=4)
    assert rows_of(found) == sorted(brute(docs, items, 4), key=str)
