"""Registered queries over documents: packing, near-duplicates, quality, repeated strings and token alignment."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.alignment import align_documents
from cohortlens.llm.minhash import PERCENT, minhash_components
from cohortlens.llm.packing import pack_documents
from cohortlens.llm.quality import in_fold, score_quality, train_quality
from cohortlens.llm.simhash import simhash_components
from cohortlens.llm.store import table
from cohortlens.llm.suffixes import remove_repeats


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


# Documents that score less are rejected.
QUALITY_THRESHOLD = 0.3


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"), "quality")
    scored = score_quality(docs, model, keep=["doc_id"])
    predicted = (F.col("score") >= QUALITY_THRESHOLD).cast("int")
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


# Every 400-character window of the bytes in hexadecimal, and the runs that repeated ones cover.
OP8_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents
), places AS (
  SELECT rid, i, hash(substr(h, 2 * i + 1, 400)) AS name
  FROM (SELECT rid, h, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM docs WHERE len(h) >= 400)
), again AS (
  SELECT rid, i FROM places JOIN (SELECT name FROM places GROUP BY name HAVING count(*) > 1) USING (name)
), marked AS (
  SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 200, true) AS starts FROM again
), runs AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT rid, i, sum(starts::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked) GROUP BY rid, run
), parts AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM runs
), cut AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM parts JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)
"""


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


# Every pair that shares a shingle is counted, and components are closed by reachability.
OP11_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT rid, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT rid, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), links AS (
  SELECT a, b FROM (
    SELECT x.rid AS a, y.rid AS b, count(*) AS same FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.rid <> y.rid GROUP BY x.rid, y.rid)
  JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b
  WHERE 100 * same >= {PERCENT} * (p.n + q.n - same)
), reach AS (
  SELECT rid AS a, rid AS b FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), found AS (
  SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN docs ON docs.rid = reach.b GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN found USING (rid) LEFT JOIN sizes USING (rid)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_documents(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    "op3_pack": op3_pack,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_repeats": op8_repeats,
    "op11_minhash": op11_minhash,
    "op12_alignment": op12_alignment,
}
ORACLES: dict[str, str] = {"op8_repeats": OP8_SQL, "op11_minhash": OP11_SQL}
