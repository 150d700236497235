"""A training corpus from the `documents` table: filter, deduplicate, decontaminate, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.decontaminate import find_contamination
from cohortlens.llm.packing import pack_documents
from cohortlens.llm.quality import score_quality, train_quality
from cohortlens.llm.queries_texts import QUALITY_THRESHOLD
from cohortlens.llm.simhash import keep_one_per_component
from cohortlens.llm.store import stored, table
from cohortlens.llm.suffixes import remove_repeats


def _apart(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents under column names that no operator uses, and the new names of key and text."""
    names = {c: f"document_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


def _restored(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The documents' own columns under their own names, but for the changed ones."""
    return df.select(*(changed.get(c, F.col(f"document_{i}")).alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = train_quality(docs, table(spark, sf_dir, "labels"), "quality")
    apart, _, text = _apart(docs)
    scored = score_quality(apart, model, text)
    return _restored(scored.where(F.col("score") >= QUALITY_THRESHOLD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    apart, key, text = _apart(docs)
    return _restored(keep_one_per_component(apart, key, text), docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once; an emptied one keeps its row.

    `n_chars`, where the documents have it, follows the text.
    """
    apart, key, text = _apart(docs)
    cut = remove_repeats(apart, key, text)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        old = F.col(f"document_{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(old).cast("bigint")
    return _restored(cut, docs, **new)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    apart, _, text = _apart(docs)
    found = find_contamination(apart, table(spark, sf_dir, "benchmark"), text)
    return _restored(found.where(~F.col("contaminated")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", contamination),
    ("packing", packing),
]

# No SQL trains the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
