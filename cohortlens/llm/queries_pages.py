"""Registered queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.html_text import extract_text, learn_weights
from cohortlens.llm.store import table
from cohortlens.llm.urls import filter_urls, labelled_table, train

# Host and path rules of the registered query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = filter_urls(pages, "url", RULES, train(labelled_table(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_text(pages, learn_weights(pages), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op2_url_filter": op2_url_filter, "op5_main_text": op5_main_text}
ORACLES: dict[str, str] = {}
