"""Registered queries over exact small-sample tests and binned densities, next to their SQL.

Each subject's first visits are tested against its last ones, per measure: many small groups. SQL counts the
arrangements by recursion over lattice paths.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import hypothesis, plotdata
from cohortlens.plans.standins import COLUMNS, ERFC, TALL, VISITS, R, cte, query, round_all, rounded, visits

_SIDES = (
    "two AS (SELECT * FROM tall WHERE timepoint IN ('T0', 'T2') AND value IS NOT NULL), "
    "r AS (SELECT subject_id, measure, timepoint, value, rank() OVER (PARTITION BY subject_id, measure ORDER BY value) + "
    "(count(*) OVER (PARTITION BY subject_id, measure, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY subject_id, measure, value) AS t FROM two), "
    "sizes AS (SELECT subject_id, measure, count(*) FILTER (timepoint = 'T0') AS n1, count(*) FILTER (timepoint = 'T2') AS n2, "
    "sum(rk) FILTER (timepoint = 'T0') AS r1, sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2), "
    "u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 * n2 / 2.0 AS mu, sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS sd "
    "FROM sizes WHERE n1 > 0 AND n2 > 0)"
)
_P2 = f"CASE WHEN sd = 0 THEN 1.0 ELSE least(1.0, {ERFC(f'((greatest(u1, 2 * mu - u1) - mu - 0.5) / sd) / {math.sqrt(2)!r}')}) END"
# Arrangements of m and n values by their U: the next value is one of the first group, above all j of the second so far, or one of the second.
_COUNTS = (
    "ways AS (SELECT 0 AS s, 0 AS m, 0 AS n, 0 AS u, 1::DOUBLE AS c UNION ALL SELECT s, m, n, u, sum(c) FROM (SELECT s + 1 AS s, m + d AS m, n + 1 - d AS n, "
    "u + d * n AS u, c FROM ways, (VALUES (0), (1)) t(d) WHERE m + d <= (SELECT max(n1) FROM u WHERE ties = 0 AND least(n1, n2) <= 8) "
    "AND n + 1 - d <= (SELECT max(n2) FROM u WHERE ties = 0 AND least(n1, n2) <= 8)) GROUP BY ALL), "
    "tails AS (SELECT m AS n1, n AS n2, u, sum(c) OVER (PARTITION BY m, n ORDER BY u DESC) / sum(c) OVER (PARTITION BY m, n) AS tail FROM ways)"
)


@query(
    "mann_whitney_subjects",
    cte(VISITS, TALL, _SIDES, _COUNTS).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT subject_id, measure, n1, n2, {R('u1')} AS u1, {R(f'CASE WHEN tail IS NOT NULL THEN least(1.0, 2 * tail) ELSE {_P2} END')} AS p_value "
    "FROM (SELECT u.*, CASE WHEN ties = 0 AND least(u.n1, u.n2) <= 8 THEN tail END AS tail FROM u LEFT JOIN tails "
    "ON u.n1 = tails.n1 AND u.n2 = tails.n2 AND tails.u = greatest(u.u1, u.n1 * u.n2 - u.u1))",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(hypothesis.mann_whitney(visits(spark, sf), COLUMNS, method="auto", by=["subject_id"]))


_PATHS = (
    "steps AS (SELECT subject_id, measure, value, sum(count(*) FILTER (timepoint = 'T0')) OVER w AS c1, sum(count(*) FILTER (timepoint = 'T2')) OVER w AS c2 "
    "FROM two GROUP BY subject_id, measure, value WINDOW w AS (PARTITION BY subject_id, measure ORDER BY value)), "
    "d AS (SELECT subject_id, measure, n1, n2, max(abs(c1 * n2 - c2 * n1))::BIGINT AS k FROM steps JOIN u USING (subject_id, measure) GROUP BY ALL), "
    # The chance that a random path to a point stayed closer than k to the diagonal.
    "paths AS (SELECT DISTINCT n1, n2, k, 0 AS s, 0 AS i, 1::DOUBLE AS p FROM d UNION ALL SELECT n1, n2, k, s, i, sum(p) FROM ("
    "SELECT n1, n2, k, s + 1 AS s, i + d AS i, p * CASE WHEN d = 1 THEN i + 1 ELSE s + 1 - i END / (s + 1) AS p FROM paths, (VALUES (0), (1)) t(d) WHERE s < n1 + n2) "
    "WHERE i <= n1 AND s - i <= n2 AND abs(i * n2 - (s - i) * n1) < k GROUP BY ALL), "
    "ends AS (SELECT n1, n2, k, p FROM paths WHERE s = n1 + n2)"
)


@query(
    "ks_2sample_subjects",
    cte(VISITS, TALL, _SIDES, _PATHS).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT subject_id, measure, n1, n2, {R('k / (n1 * n2)::DOUBLE')} AS ks_d, {R('1 - coalesce(p, 0)')} AS p_value FROM d LEFT JOIN ends USING (n1, n2, k)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(hypothesis.ks_2sample(visits(spark, sf), COLUMNS, method="auto", by=["subject_id"]))


_CELLS, _POINTS = 4096, 50
_AT = f"(lo + g.point * (hi - lo) / {_POINTS - 1})"


@query(
    "kde_binned",
    cte(VISITS, TALL)
    + ", e AS (SELECT timepoint, measure, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*), -0.2) AS bw "
    "FROM tall WHERE value IS NOT NULL GROUP BY 1, 2), "
    f"placed AS (SELECT timepoint, measure, (value - lo) / (hi - lo) * {_CELLS} AS place FROM tall JOIN e USING (timepoint, measure) WHERE value IS NOT NULL), "
    f"parts AS (SELECT timepoint, measure, place, least(floor(place), {_CELLS - 1})::INT AS low FROM placed), "
    "nodes AS (SELECT timepoint, measure, node, sum(w) AS w FROM (SELECT timepoint, measure, low AS node, 1 - (place - low) AS w FROM parts UNION ALL "
    "SELECT timepoint, measure, low + 1, place - low FROM parts) GROUP BY 1, 2, 3) "
    f"SELECT timepoint, measure, g.point::INT AS point, {R(f'max({_AT})')} AS x, "
    f"{R(f'sum(w * exp(-0.5 * pow(({_AT} - lo - node * (hi - lo) / {_CELLS}) / bw, 2)) / (n * bw * {math.sqrt(2 * math.pi)!r}))', 8)} AS density "
    f"FROM nodes JOIN e USING (timepoint, measure) CROSS JOIN (SELECT unnest(range({_POINTS})) AS point) g GROUP BY 1, 2, 3",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = plotdata.kde_binned(visits(spark, sf), COLUMNS, ["timepoint"], _POINTS, _CELLS, few_groups=True)
    return k.withColumns({"x": rounded(F.col("x")), "density": rounded(F.col("density"), 8)})
