import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortlens.llm.alignment import align_documents, alignments, lockstep
from cohortlens.llm.bytestrings import byte_letters
from cohortlens.llm.subwords import unit_encoder
from tests.llm.helpers import awkward_texts, docs_table, empty_docs, words

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    "plain words, a \"quote\" and it's 42 of 1234567 things",
    "line one\nline two\nthird",
    "two  spaces\n\nand blank   lines \n here ",
    " leading space",
    "tab\tand\r\nreturns\x0b\x0c",
    "no-break space, thin space, soft­hyphen",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "한국어 문장과 ÄÖÜ ß ñandú Ελληνικά Русский 漢字かな",
    "emoji 👩‍👩‍👧 and ▁ a lower one eighth block",
    "\x00 zero \x1c control",
    "x" * 300,
    "\n",
    " ",
]


@pytest.fixture(scope="module")
def plain():
    """The ids of a text in both vocabularies, straight from the libraries."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = byte_letters()

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode())
        spelled = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != spelled or b"".join(bytes_b) != spelled:
            return [], [], [], []
        return ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()

    return both


def brute(tokens):
    """Groups and links of one text, from ends of tokens."""
    ids_a, ids_b, ends_a, ends_b = tokens
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    links = [
        (i, j) for i in range(len(ids_a)) for j in range(len(ids_b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]
    ]
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = []
    for low, high in zip([0, *cuts], cuts):
        sides = [[i for i, e in zip(ids, ends) if low < e <= high] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
        groups.append("|".join(",".join(map(str, side)) for side in sides))
    return ";".join(groups), links


def test_units_give_the_ids_of_whole_texts(plain):
    rng = random.Random(5)
    texts = [*ODD, *(text for _, text in awkward_texts() if text)]
    texts += ["".join(rng.choices("ab é\n.'s1한", k=rng.randint(1, 60))) for _ in range(400)]
    encoder = unit_encoder(*PATHS)
    units = encoder.units(pa.array(texts))
    at = 0
    for text, many in zip(texts, units.per_text.tolist()):
        codes = units.codes[at : at + many]
        at += many
        starts_a, starts_b = np.cumsum(units.per_a) - units.per_a, np.cumsum(units.per_b) - units.per_b
        got_a = [i for c in codes for i in units.a[starts_a[c] : starts_a[c] + units.per_a[c]].tolist()]
        got_b = [i for c in codes for i in units.b[starts_b[c] : starts_b[c] + units.per_b[c]].tolist()]
        want = plain(text)
        assert (got_a, got_b) == (want[0], want[1]), text
    assert at == len(units.codes)


@pytest.mark.parametrize("long", [2, 7, 1000])
def test_lockstep_links_every_overlap(long):
    rng = random.Random(long)
    ends_a, ends_b, stops, want, base, past_a, past_b = [], [], [], [], 0, 0, 0
    for _ in range(40):
        size = rng.randint(1, 60)
        a, b = (sorted({*rng.choices(range(1, size + 1), k=rng.randint(0, size)), size}) for _ in range(2))
        _, links = brute((a, b, a, b))
        want += [(past_a + i, past_b + j, a[i] == b[j]) for i, j in links]
        ends_a += [base + e for e in a]
        ends_b += [base + e for e in b]
        base, past_a, past_b = base + size, past_a + len(a), past_b + len(b)
        stops.append(past_a)
    found = lockstep(np.array(ends_a), np.array(ends_b), np.array(stops), long)
    assert list(zip(found.a.tolist(), found.b.tolist(), found.cut.tolist())) == want


def test_alignment_equals_brute_force(spark, plain):
    rng = random.Random(6)
    rows = [(k, t) for k, t in awkward_texts() if t is None or len(t) < 6000]
    rows += [(300 + i, t) for i, t in enumerate(ODD)] + [(400 + i, words(rng, 30)) for i in range(20)]
    docs = docs_table(spark, rows)
    tokens = [plain(text or "") for _, text in rows]
    found = [brute(t) for t in tokens]
    counts = Counter((t[0][i], t[1][j]) for t, (_, links) in zip(tokens, found) for i, j in links)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    want = []
    for (key, _), t, (groups, links) in zip(rows, tokens, found):
        own = [(t[0][i], t[1][j]) for i, j in links]
        want.append(
            (
                key,
                len(t[0]),
                len(t[1]),
                len(groups.split(";")) if groups else 0,
                len(links),
                sum(counts[p] == highest[p[1]] for p in own),
                sum(counts[p] for p in own),
                hashlib.sha256(groups.encode()).hexdigest() if groups else "",
            )
        )
    got = [tuple(r) for r in align_documents(docs.repartition(3), *PATHS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(not w[1] for w in want) and sum(w[1] > 0 for w in want) > 30


def test_real_outputs(spark, plain):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", "some words here"])]
    got = {r["doc_id"]: r for r in alignments(docs_table(spark, rows), *PATHS).collect()}
    for key, text in rows:
        tokens = plain(text or "")
        groups, links = brute(tokens)
        row = got[key]
        assert (row["a_ids"], row["b_ids"]) == (tokens[0], tokens[1])
        assert list(zip(row["link_a"], row["link_b"])) == links
        cut = zip([0, *row["a_stops"]], row["a_stops"], [0, *row["b_stops"]], row["b_stops"])
        shown = [",".join(map(str, tokens[0][p:q])) + "|" + ",".join(map(str, tokens[1][r:s])) for p, q, r, s in cut]
        assert ";".join(shown) == groups


def test_empty_table_and_clashing_key(spark):
    assert align_documents(empty_docs(spark), *PATHS).count() == 0
    with pytest.raises(ValueError, match="rename"):
        align_documents(empty_docs(spark).selectExpr("*", "doc_id AS n_a"), *PATHS, key="n_a")
    # Only nulls: rows with zeros, and no pair at all.
    docs = docs_table(spark, [(1, None), (None, "")])
    assert [tuple(r)[1:] for r in align_documents(docs, *PATHS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
