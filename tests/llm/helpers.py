"""Small tables with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

import random

# Names that operators use for outputs or inside; here they are columns of the input.
CLASHES = ("n_words", "fingerprint", "score", "removed", "length", "shard", "place", "core", "row", "host", "licenses")


def words(rng: random.Random, count: int) -> str:
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(count))


def awkward_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    long_text = words(rng, 6000)
    plain = words(rng, 80)
    rows: list[tuple[int | None, str | None]] = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, "Two Words"),
        (6, long_text),
        (7, plain),
        (7, plain),
        (8, plain + " end"),
        (9, long_text),
        (None, "no key but a text"),
        (10, "x" * 5000),
        (11, "ab " * 900),
        (12, "Zeichen <|endoftext|> und\x00\x1c ß 한국   ende!!"),
    ]
    rows += [(20 + i, words(rng, rng.randint(1, 120))) for i in range(30)]
    return rows


def docs_table(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"{name} string" for name in CLASHES)
    return spark.createDataFrame([(*row, *("own",) * len(CLASHES)) for row in rows], schema)


def empty_docs(spark):
    return docs_table(spark, [])
