"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network over its byte
and word statistics, gated attention learned from the document labels weighs the passages,
and the weighted mean of their encodings is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import Rolling, lower_ascii, runs, slices, with_text_columns
from cohortlens.shipping import ship_package

PASSAGE_WORDS = 64
ENCODED, GATES = 16, 8
# The classifier is fitted on at most so many labelled documents.
FITTED_DOCUMENTS = 3000
_STEPS, _RATE, _PENALTY = 200, 0.03, 1e-4

# One class for each ASCII byte, one for first bytes of longer characters, one for the others.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 128, 129
_CLASSES, _WORD_STATISTICS = 130, 7
FEATURES = _CLASSES + _WORD_STATISTICS

_HASH = Rolling(41)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def passage_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and each text's number of passages.

    A passage is the next `PASSAGE_WORDS` words (runs of bytes beyond the space) with what
    stands between them; a text without words is one passage of zeros.
    """
    inside = data > 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    words = np.diff(np.searchsorted(starts, ends), prepend=0)
    passages = np.maximum(-(-words // PASSAGE_WORDS), 1)
    out = np.zeros((int(passages.sum()), FEATURES), np.float32)
    if not len(starts):
        return out, passages
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data) + 1)] - 1
    last[before] = inside[before]
    stops = np.flatnonzero(last) + 1
    text = np.repeat(np.arange(len(ends)), words)
    place = np.arange(len(starts)) - (np.cumsum(words) - words)[text]
    passage = (np.cumsum(passages) - passages)[text] + place // PASSAGE_WORDS
    head = np.flatnonzero(np.diff(passage, prepend=-1))
    rows = passage[head]
    # A passage's bytes go from its first word to the end of its last.
    tail = np.append(head[1:], len(starts)) - 1
    size = stops[tail] - starts[head]
    byte = np.repeat(starts[head] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    owner = np.repeat(np.arange(len(rows)), size)
    counts = np.bincount(owner * _CLASSES + _CLASS[data[byte]], minlength=len(rows) * _CLASSES)
    out[rows, :_CLASSES] = np.sqrt(counts.reshape(len(rows), _CLASSES) / size[:, None])
    lowered = _HASH.prefix(lower_ascii(data))
    name = _HASH.between(lowered, starts, stops)
    length = (stops - starts).astype(np.float64)
    count = (tail - head + 1).astype(np.float64)

    def again(distance: int) -> np.ndarray:
        same = np.zeros(len(name))
        same[distance:] = (name[distance:] == name[:-distance]) & (passage[distance:] == passage[:-distance])
        return _sums(same, head) / count

    order = np.lexsort((name, passage))
    new = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    distinct = _sums(new.astype(np.float64), head) / count
    mean = _sums(length, head) / count
    spread = np.sqrt(np.maximum(_sums(length * length, head) / count - mean * mean, 0))
    capital = _sums(((data[starts] >= 0x41) & (data[starts] <= 0x5A)).astype(np.float64), head) / count
    statistics = [again(1), again(2), distinct, np.log1p(mean), np.log1p(spread), capital, np.log1p(count)]
    out[rows, _CLASSES:] = np.stack(statistics, axis=1)
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(model: dict, features: np.ndarray, passages: np.ndarray) -> dict:
    bag = np.repeat(np.arange(len(passages)), passages)
    first = np.cumsum(passages) - passages
    x = (features - model["mean"]) / model["scale"]
    encoded = np.tanh(x @ model["encode"] + model["shift"])
    seen, gate = np.tanh(encoded @ model["see"]), _sigmoid(encoded @ model["gate"])
    raw = (seen * gate) @ model["weigh"]
    weight = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
    weight /= _sums(weight, first)[bag]
    bags = _sums(weight[:, None] * encoded, first)
    score = _sigmoid(bags @ model["score"] + model["bias"])
    return {"bag": bag, "first": first, "x": x, "encoded": encoded, "seen": seen, "gate": gate, "weight": weight, "bags": bags, "out": score}


def _gradient(model: dict, state: dict, labels: np.ndarray) -> dict:
    bag, first, encoded, seen, gate, weight = (state[n] for n in ("bag", "first", "encoded", "seen", "gate", "weight"))
    error = ((state["out"] - labels) / len(labels)).astype(np.float32)
    d_bag = (error[:, None] * model["score"])[bag]
    d_weight = (d_bag * encoded).sum(axis=1)
    d_raw = weight * (d_weight - _sums(weight * d_weight, first)[bag])
    d_product = d_raw[:, None] * model["weigh"]
    d_seen = d_product * gate * (1 - seen * seen)
    d_gate = d_product * seen * gate * (1 - gate)
    d_encoded = weight[:, None] * d_bag + d_seen @ model["see"].T + d_gate @ model["gate"].T
    d_inner = d_encoded * (1 - encoded * encoded)
    out = {
        "encode": state["x"].T @ d_inner,
        "shift": d_inner.sum(axis=0),
        "see": encoded.T @ d_seen,
        "gate": encoded.T @ d_gate,
        "weigh": (seen * gate).T @ d_raw,
        "score": state["bags"].T @ error,
        "bias": error.sum(keepdims=True),
    }
    return {name: value + _PENALTY * model[name] for name, value in out.items()}


def fit(features: np.ndarray, passages: np.ndarray, labels: np.ndarray) -> dict:
    """The model fitted by Adam on all given documents at once; the same input gives the same model."""
    rng = np.random.default_rng(7)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    model = {
        "mean": mean,
        # A statistic that hardly varies in the sample must not blow up elsewhere.
        "scale": np.maximum(scale, 0.02).astype(np.float32),
        "encode": (rng.standard_normal((FEATURES, ENCODED)) / np.sqrt(FEATURES)).astype(np.float32),
        "shift": np.zeros(ENCODED, np.float32),
        "see": (rng.standard_normal((ENCODED, GATES)) / np.sqrt(ENCODED)).astype(np.float32),
        "gate": (rng.standard_normal((ENCODED, GATES)) / np.sqrt(ENCODED)).astype(np.float32),
        "weigh": np.zeros(GATES, np.float32),
        "score": (rng.standard_normal(ENCODED) / np.sqrt(ENCODED)).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    first: dict = {}
    second: dict = {}
    for step in range(1, _STEPS + 1):
        for name, slope in _gradient(model, _forward(model, features, passages), labels).items():
            first[name] = 0.9 * first.get(name, 0) + 0.1 * slope
            second[name] = 0.999 * second.get(name, 0) + 0.001 * slope * slope
            move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            model[name] = (model[name] - _RATE * move).astype(np.float32)
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, passages, features, label); input: key, text, label."""
    for batch in slices(batches):
        for first, past, data, ends in runs(batch.column(1)):
            features, passages = passage_features(data, ends)
            cuts = np.cumsum(passages)[:-1]
            blobs = [x.tobytes() for x in np.split(features, cuts)]
            part = batch.slice(first, past - first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(passages, pa.int64()), pa.array(blobs, pa.binary()), part.column(2)],
                names=["key", "passages", "features", "label"],
            )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["key"], r["features"]))
    passages = np.array([r["passages"] for r in rows], np.int64)
    features = np.frombuffer(b"".join(r["features"] for r in rows), np.float32).reshape(-1, FEATURES)
    model = fit(features, passages, np.array([r["label"] for r in rows], np.float32)) if rows else None
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def in_fold(key: str, folds: int = 5) -> Column:
    """Whether crc32 of the key as text is divisible by `folds` (a null key counts as an empty text)."""
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def train_quality(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", limit: int = FITTED_DOCUMENTS
) -> dict | None:
    """The model learned from at most `limit` labelled documents outside the held-out fold.

    Which ones is decided by a hash of the key. Labels are 0 or 1; rows without a label or
    key are passed over, of contradicting labels of one key the smaller one counts, and of
    several texts of one key the one with the smallest hash. Null without any such document.
    """
    ship_package(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~in_fold(key))
    graded = usable.groupBy(F.col(f"`{key}`").cast("string").alias("key")).agg(F.min(label).cast("double").alias("label"))
    picked = F.broadcast(graded.orderBy(F.xxhash64("key"), "key").limit(limit))
    texts = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    bags = texts.join(picked, "key").groupBy("key").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.min("label").alias("label")
    )
    featured = bags.select("key", "text", "label").mapInArrow(_featurize, "key string, passages bigint, features binary, label double")
    # At most `limit` documents meet in the one task that fits the model.
    found = featured.repartition(1).mapInArrow(_train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _scores(model: dict | None, texts: pa.Array) -> list[pa.Array]:
    scores = []
    for _, _, data, ends in runs(texts):
        features, passages = passage_features(data, ends)
        scores.append(np.full(len(ends), 0.5) if model is None else _forward(model, features, passages)["out"].astype(np.float64))
    return [pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]


def score_quality(docs: DataFrame, model: dict | None, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the probability of label 1, from the whole text alone.

    Null and empty texts are scored as one passage of zeros; without a model every score is
    0.5; equal texts have nearly equal scores; an input column called `name` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: _scores(sent.value, texts)

    return with_text_columns(docs, text, make, {name: "double"}, keep)
