import pytest

from cohortlens.llm.licenses import TEMPLATES, TEXTS, scan_licenses
from tests.llm.helpers import awkward_texts, docs_table, empty_docs
from tests.llm.test_decontaminate import split


def brute(text, threshold):
    best = {}
    for line in (text or "").split("\n"):
        own = split(line)
        grams = set(zip(own, own[1:]))
        found = []
        for spdx, notices in TEMPLATES.items():
            for notice in notices:
                theirs = split(notice)
                their_grams = set(zip(theirs, theirs[1:]))
                if grams:
                    score = 2 * len(grams & their_grams) / (len(grams) + len(their_grams))
                    if score >= threshold:
                        found.append((-score, spdx))
        if found:
            score, spdx = min(found)
            best[spdx] = max(-score, best.get(spdx, 0))
    return sorted(best.items(), key=lambda pair: (-pair[1], pair[0]))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_equals_brute_force(spark, threshold):
    rows = awkward_texts()
    notices = [n for own in TEMPLATES.values() for n in own]
    rows += [(300 + i, f"Some text.\n{n.upper()}\nmore text") for i, n in enumerate(notices)]
    rows += [(400 + i, " ".join(n.split()[1:])) for i, n in enumerate(notices)]
    rows += [(500, "\n".join(notices)), (501, notices[0] + " and then a long sentence about something else that goes on and on"), (502, notices[0])]
    got = scan_licenses(docs_table(spark, rows), threshold=threshold)
    found = sorted(((r["doc_id"], [(x["license"], x["score"]) for x in r["licenses"]]) for r in got.collect()), key=str)
    assert found == sorted(((k, brute(t, threshold)) for k, t in rows), key=str)


def wrapped(text, width=9):
    own = text.split()
    return "\n".join(" ".join(own[i : i + width]) for i in range(0, len(own), width))


def test_notices_across_and_within_lines_are_found(spark):
    notices = [(spdx, n) for group in (TEMPLATES, TEXTS) for spdx, own in group.items() for n in own]
    rows = [(i, f"Some words before it.\n{wrapped(n)}\nAnd words after it.") for i, (_, n) in enumerate(notices)]
    rows += [(100 + i, f"This tool, as its authors say, {n} See the file for more.") for i, (_, n) in enumerate(notices)]
    rows += [(900, "The code is released under the MIT License. See there. Its docs are licensed under CC BY 4.0. Enjoy."), (901, "plain text of the work")]
    got = {r["doc_id"]: [(x["license"], x["score"]) for x in r["licenses"]] for r in scan_licenses(docs_table(spark, rows), texts=TEXTS).collect()}
    for i, (spdx, _) in enumerate(notices):
        assert got[i][0] == got[100 + i][0] == (spdx, 1.0)
    assert got[900] == [("CC-BY-4.0", 1.0), ("MIT", 1.0)] and got[901] == []


def test_empty_table(spark):
    assert scan_licenses(empty_docs(spark)).count() == 0
