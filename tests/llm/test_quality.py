import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import quality
from cohortlens.llm.bytestrings import runs
from cohortlens.llm.quality import FEATURES, in_fold, passage_features, score_quality, train_quality
from tests.llm.helpers import awkward_texts, docs_table, empty_docs, words


def corpus(seed, count):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(count):
        good = rng.random() < 0.7
        text = words(rng, rng.randint(20, 400)).capitalize() + "."
        if not good:
            kind = rng.randrange(3)
            text = {0: text.upper().replace(" ", "!! "), 1: text.replace(" ", " | "), 2: " ".join(w for w in text.split()[:20] for _ in range(9))}[kind]
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def labels_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int")


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus(1, 500)
    return docs, labels, train_quality(docs_table(spark, docs), labels_table(spark, labels), "quality")


def test_held_out_accuracy(spark, trained):
    docs, labels, model = trained
    graded = dict(labels)
    rows = score_quality(docs_table(spark, docs), model).select("doc_id", "score", in_fold("doc_id").alias("held_out")).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and len(held) > 50
    assert np.mean([(r["score"] >= 0.3) == graded[r["doc_id"]] for r in held]) > 0.97


def test_held_out_labels_change_nothing(spark, trained):
    docs, labels, model = trained
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    again = train_quality(docs_table(spark, docs), labels_table(spark, flipped), "quality")
    assert all(np.array_equal(model[name], again[name]) for name in model)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    passages = np.array([1, 3, 2, 4])
    features = rng.random((10, FEATURES)).astype(np.float64)
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    model = {k: v.astype(np.float64) for k, v in quality.fit(features.astype(np.float32), passages, labels).items()}

    def loss(m):
        out = quality._forward(m, features, passages)["out"]
        return -np.mean(labels * np.log(out) + (1 - labels) * np.log(1 - out))

    slopes = quality._gradient(model, quality._forward(model, features, passages), labels)
    for name in ("encode", "shift", "see", "gate", "weigh", "score", "bias"):
        at = tuple(rng.integers(0, n) for n in model[name].shape)
        up, down = ({**model, name: model[name].copy()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4 + quality._PENALTY * model[name][at]
        assert slopes[name][at] == pytest.approx(slope, abs=2e-6)


def test_passages_do_not_depend_on_their_neighbours():
    texts = [t or "" for _, t in awkward_texts()]
    together, alone = [], []
    for _, _, data, ends in runs(pa.array(texts)):
        together.append(passage_features(data, ends)[0])
    for text in texts:
        for _, _, data, ends in runs(pa.array([text])):
            alone.append(passage_features(data, ends)[0])
    assert np.allclose(np.concatenate(together), np.concatenate(alone), atol=1e-6)


def test_awkward_texts_have_scores(spark, trained):
    rows = awkward_texts()
    scored = score_quality(docs_table(spark, rows), trained[2]).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    empty = {r["score"] for r in scored if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert score_quality(empty_docs(spark), trained[2]).count() == 0


def test_without_usable_labels(spark):
    docs = docs_table(spark, awkward_texts())
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = train_quality(docs, labels, "quality")
    assert model is None and {r["score"] for r in score_quality(docs, model).collect()} == {0.5}


def test_contradicting_labels_and_repeated_keys(spark):
    docs, labels = corpus(3, 60)
    twice = docs_table(spark, docs + docs[:10] + [(docs[0][0], "another text")])
    again = labels_table(spark, labels + [(i, 1 - y) for i, y in labels[:5]])
    assert train_quality(twice, again, "quality") is not None
