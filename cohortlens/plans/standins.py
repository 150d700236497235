"""Stand-ins for cohort tables, built from the given tables, in Spark and in SQL.

``events`` plays the visit table (subject, timepoint by day of month, one measure per event
type), ``lineitem`` the flat feature table with a planted target. Each Spark function has an
SQL twin of the same name in upper case for the independent check.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import ERFC_COEFFICIENTS, hash_uniform

MEASURES = ("click", "error", "purchase", "signup", "view")
COLUMNS = tuple(f"v_{m}" for m in MEASURES)
KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows where SQL can say it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int = 6) -> Column:
    """Round for comparison; the offset keeps exact halves off the rounding boundary."""
    return F.round(x + 3 * 10.0 ** -(digits + 2), digits) + 0.0


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def R(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE) + 3e-{digits + 2}, {digits}) + 0.0"


def U(key: str, seed: object) -> str:
    return f"(('0x'||substr(md5(CAST({key} AS VARCHAR)||'-{seed}'),1,8))::BIGINT/4294967296.0)"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("subject_id"),
        F.when(day <= 10, "T0").when(day <= 20, "T1").otherwise("T2").alias("timepoint"),
        F.col("event_type").alias("kind"),
        "value",
        F.least(F.lit(10), F.floor(F.col("value") / 10)).cast("int").alias("rating"),
        *[F.when(F.col("event_type") == m, F.col("value")).alias(f"v_{m}") for m in MEASURES],
    )


VISITS = (
    "visits AS (SELECT event_id, user_id AS subject_id, CASE WHEN day(ts) <= 10 THEN 'T0' "
    "WHEN day(ts) <= 20 THEN 'T1' ELSE 'T2' END AS timepoint, event_type AS kind, value, "
    "CAST(least(10, floor(value / 10)) AS INT) AS rating, "
    + ", ".join(f"CASE WHEN event_type = '{m}' THEN value END AS v_{m}" for m in MEASURES)
    + " FROM events)"
)

TALL = (
    "tall AS (SELECT event_id, subject_id, timepoint, 'v_' || kind AS measure, value FROM visits)"
)


def dirty_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits whose value arrives as text, some of it unreadable, with missing kinds."""
    v = visits(spark, sf_dir)
    return v.select(
        "event_id",
        "subject_id",
        "timepoint",
        F.when(F.col("event_id") % 13 == 0, "n/a")
        .otherwise(F.col("value").cast("string"))
        .alias("value_text"),
        F.when(hash_uniform("event_id", "n") >= 0.1, F.col("value")).alias("value"),
        F.when(hash_uniform("event_id", "k") >= 0.1, F.col("kind")).alias("kind"),
        F.when(hash_uniform("event_id", "s") >= 0.6, F.col("value")).alias("sparse"),
        "rating",
    )


DIRTY = (
    f"{VISITS}, dirty AS (SELECT event_id, subject_id, timepoint, CASE WHEN event_id % 13 = 0 THEN "
    f"'n/a' ELSE CAST(value AS VARCHAR) END AS value_text, CASE WHEN {U('event_id', 'n')} >= 0.1 "
    f"THEN value END AS value, CASE WHEN {U('event_id', 'k')} >= 0.1 THEN kind END AS kind, "
    f"CASE WHEN {U('event_id', 's')} >= 0.6 THEN value END AS sparse, rating FROM visits)"
)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a flat feature table with a planted rating and a continuous target."""
    li = table(spark, sf_dir, "lineitem").withColumn(
        "cents", F.round(F.col("l_extendedprice") * 100).cast("long")
    )
    keyed = li.withColumn("key", F.concat_ws("-", *KEY))
    signal = F.col("l_quantity") / 5 + 40 * F.col("l_discount") + 2 * hash_uniform("key", "t")
    return keyed.select(
        "key",
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        signal.alias("y"),
        F.least(F.lit(10), F.greatest(F.lit(0), F.floor(signal - 3))).cast("int").alias("rating"),
    )


_KEY_SQL = "l_orderkey||'-'||l_partkey||'-'||l_suppkey||'-'||l_linenumber||'-'||CAST(round(l_extendedprice*100) AS BIGINT)"
FLAT = (
    f"keyed AS (SELECT *, {_KEY_SQL} AS key FROM lineitem), signal AS (SELECT *, l_quantity / 5 + "
    f"40 * l_discount + 2 * {U('key', 't')} AS y FROM keyed), flat AS (SELECT key, l_quantity AS qty, "
    "l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, "
    "l_linestatus AS status, y, CAST(least(10, greatest(0, floor(y - 3))) AS INT) AS rating FROM signal)"
)


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction table: part prices and a noisy guess of each."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"),
        F.when(F.col("p_partkey") % 50 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("actual"),
        (F.col("p_retailprice") * (hash_uniform("p_partkey", "g") * 0.02 + 0.99)).alias("predicted"),
        F.col("p_size").cast("double").alias("size"),
    )


GUESSED = (
    "guessed AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 50 = 0 THEN 0.0::DOUBLE ELSE "
    f"p_retailprice END AS actual, p_retailprice * ({U('p_partkey', 'g')} * 0.02 + 0.99) AS predicted, "
    "p_size::DOUBLE AS size FROM part)"
)


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification table: customer segments and a guess that is right most of the time."""
    c = table(spark, sf_dir, "customer")
    u = hash_uniform("c_custkey", "g")
    return c.select(
        F.col("c_custkey").alias("key"),
        F.col("c_mktsegment").alias("actual"),
        F.when(u < 0.6, F.col("c_mktsegment"))
        .when(u < 0.8, F.lit("BUILDING"))
        .otherwise(F.lit("MACHINERY"))
        .alias("predicted"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
        F.round(u * F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.8), 2).alias("score"),
    )


GRADED = (
    f"graded AS (SELECT c_custkey AS key, c_mktsegment AS actual, CASE WHEN {U('c_custkey', 'g')} < 0.6 "
    f"THEN c_mktsegment WHEN {U('c_custkey', 'g')} < 0.8 THEN 'BUILDING' ELSE 'MACHINERY' END AS predicted, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label, "
    f"round({U('c_custkey', 'g')} * CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.8 END, 2) AS score "
    "FROM customer)"
)


def ERFC(x: str) -> str:
    """The complementary error function as SQL text."""
    poly = repr(ERFC_COEFFICIENTS[-1])
    t = f"(1.0::DOUBLE / (1 + abs({x}) / 2))"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({poly} * {t} + {c!r})"
    upper = f"({t} * exp({poly} - ({x}) * ({x})))"
    return f"CASE WHEN ({x}) >= 0 THEN {upper} ELSE 2 - {upper} END"


def KOLMOGOROV(lam: str) -> str:
    """Upper tail of the limiting Kolmogorov distribution as SQL text."""
    large = " + ".join(
        f"({2.0 * (-1) ** (k - 1)!r} * exp({-2.0 * k * k!r} * {lam} * {lam}))" for k in range(1, 101)
    )
    return f"CASE WHEN {lam} < 0.1 THEN 1.0 ELSE least(1.0, greatest(0.0, {large})) END"


def cte(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def listed(columns: Sequence[str]) -> str:
    return ", ".join(columns)
