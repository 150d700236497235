"""Registered queries: sources, projection, cleaning, filters, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import columns as C
from cohortlens.operators import clean, describe, pairing
from cohortlens.plans.flows import (
    FIVE_GROUP_EDGES,
    FIVE_GROUP_LABELS,
    TWO_GROUP_EDGES,
    TWO_GROUP_LABELS,
    label_ratings,
)
from cohortlens.plans.standins import (
    COLUMNS,
    DIRTY,
    FLAT,
    GUESSED,
    U,
    VISITS,
    R,
    cte,
    dirty_visits,
    flat,
    guessed,
    query,
    round_all,
    rounded,
    table,
    visits,
)
from cohortlens.sources import visits as src

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


@query("read_visits", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = src.read_visits(spark, f"{sf}/events.parquet", EVENT_SCHEMA, "parquet")
    return df.select("event_id", "user_id", "event_type", "value")


@query(
    "inline_records",
    "SELECT r.segment, r.weight, count(c.c_custkey) AS n FROM (VALUES ('BUILDING', 2.0::DOUBLE), "
    "('MACHINERY', NULL), ('UNKNOWN', 1.0)) r(segment, weight) LEFT JOIN customer c "
    "ON c.c_mktsegment = r.segment GROUP BY r.segment, r.weight",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType().add("segment", "string").add("weight", "double")
    records = [
        {"segment": "BUILDING", "weight": 2.0},
        {"segment": "MACHINERY", "weight": float("nan")},
        {"segment": "UNKNOWN", "weight": 1.0},
    ]
    inline = src.inline_records(spark, records, schema)
    counts = describe.count_rows(table(spark, sf, "customer"), ["c_mktsegment"])
    return inline.join(counts, inline.segment == counts.c_mktsegment, "left").select(
        "segment", "weight", F.coalesce("n", F.lit(0)).alias("n")
    )


_EVENT_TYPES = (
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
    ("event_type", "string"), ("value", "double"), ("props", "string"),
)


@query(
    "profile_table",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
        f"count(*) - count({c}) AS nulls FROM events"
        for i, (c, t) in enumerate(_EVENT_TYPES)
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return src.profile_table(table(spark, sf, "events"))


@query("head_rows", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return src.head_rows(df, "event_id", 5)


@query("rename_columns", "SELECT event_id, user_id AS subject_id, value AS measure FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return src.rename_columns(df, {"user_id": "subject_id", "value": "measure", "absent": "x"})


@query("select_existing", "SELECT event_id, value FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.select_existing(table(spark, sf, "events"), ["event_id", "iron", "value"])


@query("drop_columns", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_columns(table(spark, sf, "part"), ["p_name", "absent"])


@query("select_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part")
    return df.select(*clean.numeric_columns(df))


@query(
    "coerce_numeric",
    cte(DIRTY) + "SELECT event_id, TRY_CAST(value_text AS DOUBLE) AS value_text FROM dirty",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "value_text")
    return clean.coerce_numeric(df, ["value_text", "absent"])


@query("truncate_to_int", "SELECT event_id, CAST(trunc(value - 50) AS INT) AS whole FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", C.truncate_to_int(F.col("value") - 50).alias("whole")
    )


@query(
    "map_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS code FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", C.map_values("o_orderstatus", {"F": 0, "O": 1}).alias("code")
    )


@query(
    "map_values_strict",
    "SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 "
    "END AS l_linestatus FROM lineitem",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    # The first column has a value without an entry and stays as it is.
    df = clean.map_values_strict(df, "l_returnflag", {"A": 0, "N": 1})
    return clean.map_values_strict(df, "l_linestatus", {"F": 0, "O": 1})


_FIVE_SQL = (
    "CASE WHEN rating < 0 THEN NULL WHEN rating <= 2 THEN 'E (1-2)' WHEN rating <= 4 THEN 'D (3-4)' "
    "WHEN rating <= 6 THEN 'C (5-6)' WHEN rating <= 8 THEN 'B (7-8)' WHEN rating <= 10 THEN 'A (9-10)' END"
)


@query("cut_bins", cte(VISITS) + f"SELECT event_id, {_FIVE_SQL} AS pain_group FROM visits")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).select(
        "event_id", C.cut_bins("rating", FIVE_GROUP_EDGES, FIVE_GROUP_LABELS).alias("pain_group")
    )


@query(
    "cut_2class",
    cte(VISITS) + "SELECT event_id, CASE WHEN rating BETWEEN 0 AND 6 THEN 'Not High Pain (1-6)' "
    "WHEN rating <= 10 THEN 'High Pain (7-10)' END AS pain_class FROM visits",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).select(
        "event_id", C.cut_bins("rating", TWO_GROUP_EDGES, TWO_GROUP_LABELS).alias("pain_class")
    )


@query(
    "label_ratings",
    cte(VISITS) + f", g AS (SELECT event_id, rating, {_FIVE_SQL} AS \"group\" FROM visits) "
    "SELECT event_id, rating, \"group\" FROM g WHERE \"group\" IN (SELECT \"group\" FROM g GROUP BY 1 "
    "HAVING count(*) >= 2)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return label_ratings(visits(spark, sf).select("event_id", "rating"), "rating")


_PAIR_SQL = (
    "paired AS (SELECT subject_id, "
    + ", ".join(
        f"avg(CASE WHEN timepoint = '{t}' THEN {m} END) AS {m}_{t}" for m in COLUMNS for t in ("T0", "T2")
    )
    + " FROM visits GROUP BY subject_id), kept AS (SELECT * FROM paired WHERE "
    + " AND ".join(f"coalesce({m}_T0, {m}_T2) IS NOT NULL" for m in COLUMNS)
    + ")"
)
_PAIR_COLS = [f"{m}_{t}" for m in COLUMNS for t in ("T0", "T2")]


@query(
    "pair_timepoints",
    cte(VISITS, _PAIR_SQL)
    + "SELECT subject_id, " + ", ".join(f"{R(c)} AS {c}" for c in _PAIR_COLS) + " FROM kept",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(pairing.pair_timepoints(visits(spark, sf), COLUMNS))


@query(
    "delta",
    cte(VISITS, _PAIR_SQL)
    + "SELECT subject_id, " + ", ".join(f"{R(f'{m}_T2 - {m}_T0')} AS {m}_Change" for m in COLUMNS)
    + " FROM kept",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    changed = pairing.with_changes(pairing.pair_timepoints(visits(spark, sf), COLUMNS), COLUMNS)
    return round_all(changed.select("subject_id", *[f"{m}_Change" for m in COLUMNS]))


@query(
    "join_measures",
    cte(VISITS)
    + "SELECT a.subject_id, a.n_click, b.n_view FROM (SELECT subject_id, count(*) AS n_click FROM visits "
    "WHERE kind = 'click' GROUP BY 1) a JOIN (SELECT subject_id, count(*) AS n_view FROM visits WHERE "
    "kind = 'view' GROUP BY 1) b USING (subject_id)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)

    def per(kind: str) -> DataFrame:
        return v.where(F.col("kind") == kind).groupBy("subject_id").agg(
            F.count(F.lit(1)).alias(f"n_{kind}")
        )

    return pairing.join_measures([per("click"), per("view")])


@query(
    "error_columns",
    cte(GUESSED)
    + f"SELECT key, {R('predicted - actual')} AS difference, {R('actual - predicted')} AS residual, "
    f"{R('abs(predicted - actual)')} AS abs_error, abs(predicted - actual) < 1.0 AS within_tolerance "
    "FROM guessed",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = C.error_columns("actual", "predicted")
    return round_all(
        guessed(spark, sf).select(
            "key", *[e[c].alias(c) for c in ("difference", "residual", "abs_error", "within_tolerance")]
        )
    )


@query(
    "percent_error",
    cte(GUESSED)
    + f"SELECT key, {R('CASE WHEN actual <> 0 THEN (predicted - actual) / actual * 100 END', 4)} AS pct_error "
    "FROM guessed",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = C.percent_error(F.col("predicted") - F.col("actual"), F.col("actual"), 12)
    return guessed(spark, sf).select("key", rounded(e, 4).alias("pct_error"))


@query("add_constant", "SELECT p_partkey, p_size, 1.0::DOUBLE AS const, 'all' AS grp FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", "p_size", F.lit(1.0).alias("const"), F.lit("all").alias("grp")
    )


@query(
    "align_schema",
    cte(DIRTY)
    + "SELECT event_id, TRY_CAST(value_text AS DOUBLE) AS value_text, CAST(NULL AS DOUBLE) AS iron, "
    "CAST(rating AS DOUBLE) AS rating FROM dirty",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("value_text", "iron", "rating")])
    return clean.align_schema(dirty_visits(spark, sf), schema, keep=["event_id"])


@query("filter_timepoint", cte(VISITS) + "SELECT event_id, subject_id, value FROM visits WHERE timepoint = 'T0'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.filter_timepoint(visits(spark, sf), "T0").select("event_id", "subject_id", "value")


@query("dropna_subset", cte(DIRTY) + "SELECT event_id, value, kind FROM dirty WHERE value IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_missing(dirty_visits(spark, sf).select("event_id", "value", "kind"), ["value"])


@query(
    "dropna_any",
    cte(DIRTY) + "SELECT event_id, value, kind FROM dirty WHERE value IS NOT NULL AND kind IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_missing(dirty_visits(spark, sf).select("event_id", "value", "kind"))


@query(
    "null_fractions",
    cte(DIRTY)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"{R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_fraction FROM dirty"
        for c in ("value", "kind", "sparse", "rating")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(
        clean.null_fractions(dirty_visits(spark, sf), ["value", "kind", "sparse", "rating"])
    )


@query("drop_sparse_columns", cte(DIRTY) + "SELECT event_id, value, kind FROM dirty")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_visits(spark, sf).select("event_id", "value", "kind", "sparse")
    return clean.drop_sparse_columns(df, 0.5, keep=["event_id"])


@query(
    "drop_rare_classes",
    "SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM "
    "customer GROUP BY 1 HAVING count(*) >= 60)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return clean.drop_rare_classes(df, "c_nationkey", 60)


@query(
    "size_guards",
    cte(FLAT) + "SELECT count(*) AS n, count(DISTINCT rating) AS classes FROM flat",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = flat(spark, sf)
    clean.check_trainable(df, "rating")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rating").alias("classes"))


@query(
    "dedupe_first",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return clean.dedupe_first(df, "user_id", ["event_id"])


@query(
    "sample_n",
    f"SELECT event_id, value FROM events ORDER BY {U('event_id', 42)}, event_id LIMIT 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.sample_n(table(spark, sf, "events").select("event_id", "value"), "event_id", 20)


@query(
    "threshold_features",
    cte(FLAT)
    + ", c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, y) AS corr FROM flat" for c in ("qty", "price", "discount", "tax")
    )
    + f") SELECT feature, {R('corr')} AS corr, {R('abs(corr)')} AS abs_corr FROM c WHERE abs(corr) >= 0.10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    corr = describe.corr_with_target(flat(spark, sf), ["qty", "price", "discount", "tax"], "y")
    return round_all(clean.threshold_features(corr, 0.10))


@query("lookup_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 7, 42)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.lookup_rows(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), [1, 7, 42], "o_custkey"
    )


@query(
    "exclude_keys",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders "
    "WHERE o_orderstatus = 'P')",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    partial = (
        table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
        .select(F.col("o_custkey").alias("c_custkey"))
    )
    return clean.exclude_keys(
        table(spark, sf, "customer").select("c_custkey", "c_acctbal"), partial, "c_custkey"
    )


@query(
    "stack_groups",
    cte(VISITS)
    + "SELECT event_id, value, 'T0' AS grp FROM visits WHERE timepoint = 'T0' UNION ALL "
    "SELECT event_id, value, 'T2' AS grp FROM visits WHERE timepoint = 'T2'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = visits(spark, sf)
    return clean.stack_groups(
        {t: clean.filter_timepoint(v, t).select("event_id", "value") for t in ("T0", "T2")}, "grp"
    )


