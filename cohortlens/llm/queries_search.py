"""Registered queries of benchmark decontamination and licence scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.decontaminate import find_contamination
from cohortlens.llm.licenses import TEMPLATES, TEXTS, THRESHOLD, scan_licenses
from cohortlens.llm.store import table


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH items AS (
  SELECT item_id, words, least(10, len(words)) AS m
  FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0
), patterns AS (
  SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS pattern
  FROM (SELECT *, unnest(generate_series(1, len(words) - m + 1)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents
), windows AS (
  SELECT rid, i, m, array_to_string(words[i:i + m - 1], ' ') AS pattern
  FROM (SELECT rid, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i
        FROM docs, (SELECT DISTINCT m FROM patterns) WHERE len(words) >= m)
), matches AS (
  SELECT rid, i, m, item_id FROM windows JOIN patterns USING (m, pattern)
), hit AS (
  SELECT rid, count(DISTINCT w) AS n_hit
  FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS w FROM (SELECT DISTINCT rid, i, m FROM matches))
  GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its best licence, that licence's score, and all licences found."""
    scanned = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"], texts=TEXTS)
    best = F.try_element_at("licenses", F.lit(1))
    return scanned.select(
        "doc_id",
        best["license"].alias("license"),
        F.round(best["score"], 6).alias("score"),
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.array_sort(F.transform("licenses", lambda x: x["license"])), ",").alias("licenses"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTICES = ", ".join(f"({_quoted(spdx)}, {_quoted(text)})" for spdx, texts in TEMPLATES.items() for text in texts)
_SET = "list_distinct(list_transform(generate_series(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1]))"

OP10_SQL = f"""
WITH templates AS (
  SELECT license, {_SET} AS grams FROM (SELECT license, {_WORDS} AS words FROM (VALUES {_NOTICES}) t(license, text))
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), lines AS (
  SELECT rid, nth, {_SET} AS grams
  FROM (SELECT rid, nth, {_WORDS} AS words FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS nth FROM docs))
  WHERE len(words) > 1
), scores AS (
  SELECT rid, nth, license, 2.0 * len(list_intersect(l.grams, t.grams)) / (len(l.grams) + len(t.grams)) AS score
  FROM lines l JOIN templates t ON 2 * least(len(l.grams), len(t.grams)) >= {THRESHOLD} * (len(l.grams) + len(t.grams))
), best AS (
  SELECT rid, license, max(score) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY rid, nth ORDER BY score DESC, license) AS place FROM scores WHERE score >= {THRESHOLD})
  WHERE place = 1 GROUP BY rid, license
), summary AS (
  SELECT rid, first(license ORDER BY score DESC, license) AS license, max(score) AS score, count(*) AS n,
    string_agg(license, ',' ORDER BY license) AS licenses
  FROM best GROUP BY rid
)
SELECT doc_id, license, round(score, 6) AS score, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN summary USING (rid)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate, "op10_license_scan": op10_license_scan}
ORACLES = {"op4_decontaminate": OP4_SQL, "op10_license_scan": OP10_SQL}
