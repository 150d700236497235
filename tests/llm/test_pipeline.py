import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import queries
from cohortlens.llm.queries_texts import QUALITY_THRESHOLD
from cohortlens.llm.quality import score_quality, train_quality
from cohortlens.llm.simhash import simhash_components
from cohortlens.llm.store import stored
from tests.compare import difference, duck
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_quality import corpus
from tests.llm.test_suffixes import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def planted():
    """Clean, junk, copied, near-copied, repeating and contaminated documents."""
    rng = random.Random(6)
    docs, labels = corpus(6, 250)
    graded = dict(labels)
    good = [t for i, t in docs if graded[i]]
    passage = " ".join(rng.choice(good).split()[:60])
    rows = list(docs)
    rows += [(1000 + i, good[i]) for i in range(15)]
    rows += [(1100 + i, good[20 + i] + " addendum") for i in range(10)]
    rows += [(1200 + i, f"Lead {i}. {good[40 + i]} {passage} Tail {i} {good[60 + i]}") for i in range(10)]
    item = " ".join(good[90].split()[:14])
    rows += [(1300, "Begin " + " ".join(good[91].split()[:9]) + " " + item + " end of it all"), (1400, ""), (1401, None), (1000, good[0])]
    return rows, labels, [(7, item), (8, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels, items = planted()
    full = [(i, t, "en", "src", len(t or ""), "own") for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)

    def run(name, docs):
        return stored(stages[name](spark, docs, tables), "stage")

    accepted = run(names[0], docs)
    model = train_quality(docs, spark.read.parquet(f"{tables}/labels.parquet"), "quality")
    scores = score_quality(docs, model, name="s", keep=["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in accepted.collect()) == sorted(r["doc_id"] for r in scores if r["s"] >= QUALITY_THRESHOLD)
    assert accepted.columns == docs.columns and accepted.count() < docs.count()

    single = run(names[1], accepted)
    leads = {r["component_id"] for r in simhash_components(accepted).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(leads)
    assert single.columns == docs.columns and not {1000 + i for i in range(1, 15)} & leads

    cut = run(names[2], single)
    before = single.collect()
    want = dict(zip((r["doc_id"] for r in before), brute_repeats([r["text"] for r in before], 200)))
    for r in cut.collect():
        assert len((r["text"] or "").encode()) == want[r["doc_id"]][0] - want[r["doc_id"]][1]
        assert r["n_chars"] == len(r["text"] or "") and r["score"] == "own"
    assert cut.count() == len(before) and any(w[1] for w in want.values())

    clean = run(names[3], cut)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = [k for k, _, hit, _ in brute_contamination([(r["doc_id"], r["text"]) for r in cut.collect()], items, 10) if not hit]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(kept) and 1300 not in kept

    packed = run(names[4], clean)
    assert {r["doc_id"] for r in packed.collect()} == set(kept)
    whole = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, whole.select(packed.columns).collect())) == sorted(map(tuple, packed.collect()))


def test_columns_with_the_operators_names_pass_untouched(spark, tables):
    names = ("hits", "removed", "n_bytes", "__id__", "kept_text", "fingerprint", "score", "n_words", "contaminated", "n_removed")
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names)


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_queries_equal_their_sql(spark, sf, name):
    assert difference(duck(sf), queries.registered()[name](spark, sf), queries.oracles()[name]) is None


@pytest.mark.parametrize("name", sorted(queries.registered().keys() - queries.oracles().keys()))
def test_queries_without_sql_run(spark, sf, name):
    assert queries.registered()[name](spark, sf).count() > 0
