"""Registered queries over embeddings: exact top-k search and whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.store import table
from cohortlens.llm.vafile import exact_top_k, integer_vectors
from cohortlens.llm.whitening import whiten

NEIGHBOURS = 5
QUERY_EVERY = 50


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    whole = vectors.select("vec_id", integer_vectors(vectors, "embedding", strict=True).alias("vector"))
    return exact_top_k(whole, "vec_id", "vector", F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long can hold is null."""
    found = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {"op9_exact_top_k": op9_exact_top_k, "op13_whitening": op13_whitening}
ORACLES = {"op9_exact_top_k": OP9_SQL}
