"""URL filters: host and path rules, and a logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions and JVM-side pyspark.ml stages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM_SIZES = (3, 4)
BUCKETS = 1 << 14
PENALTY = 1e-3
PASSES = 60

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled table, as (host, path, 1 to block).
LABELLED = (
    ("www.example.com", "/en/1", 0),
    ("blog.example.com", "/en/20417", 0),
    ("news.example.net", "/de/88.html", 0),
    ("m.example.net", "/fr/1203/", 0),
    ("thewriter.example.net", "/en/553", 0),
    ("blog.theriver.example.com", "/es/1948.html", 0),
    ("www.station.example.net", "/en/30172", 0),
    ("nation.example.com", "/fr/77/", 0),
    ("m.weather.example.net", "/de/40061", 0),
    ("library.example.com", "/en/9012/", 0),
    ("www.university.example.net", "/en/61120.html", 0),
    ("blog.kitchen.example.com", "/en/15", 0),
    ("history.example.net", "/es/260", 0),
    ("www.thousand.example.com", "/en/48231", 0),
    ("science.example.net", "/en/7345", 0),
    ("m.garden.example.com", "/de/90114.html", 0),
    ("www.museum.example.net", "/fr/3108", 0),
    ("education.example.com", "/en/22075/", 0),
    ("thing.example.net", "/en/139002", 0),
    ("docs.example.net", "/en/204816", 0),
    ("blog.travel.example.net", "/es/5521/", 0),
    ("www.shoreline.example.com", "/en/180", 0),
    ("theatre.example.net", "/fr/19220.html", 0),
    ("together.example.com", "/en/66310", 0),
    ("whether.example.net", "/de/7120", 0),
    ("m.nearby.example.com", "/en/50607", 0),
    ("research.example.net", "/en/11/", 0),
    ("www.tradition.example.com", "/es/84019", 0),
    ("health.example.net", "/en/27331.html", 0),
    ("recipes.example.com", "/fr/402", 0),
    ("free-bets.example.net", "/en/612", 1),
    ("blog.cheap-pills.example.net", "/de/44120.html", 1),
    ("www.spam-farm.example.com", "/en/9034", 1),
    ("blog.casino-win.example.net", "/es/1803/", 1),
    ("casino-bonus.example.com", "/en/30172", 1),
    ("www.online-casino.example.net", "/fr/77", 1),
    ("free-casino-spins.example.com", "/en/553.html", 1),
    ("cheap-viagra.example.net", "/en/20417", 1),
    ("www.pills-online.example.com", "/de/88", 1),
    ("sports-bets.example.com", "/en/1203", 1),
    ("m.bets-win-free.example.net", "/fr/402/", 1),
    ("link-farm.example.com", "/en/180", 1),
    ("spam-links.example.net", "/es/260.html", 1),
    ("buy-cheap-meds.example.com", "/en/5521", 1),
    ("xxx-cams.example.net", "/en/61120", 1),
    ("www.free-porn.example.com", "/en/15/", 1),
    ("payday-loans-fast.example.net", "/en/27331", 1),
    ("replica-watches-cheap.example.com", "/de/7120", 1),
    ("win-free-iphone.example.net", "/en/84019.html", 1),
    ("jackpot-slots-win.example.com", "/en/66310", 1),
    ("ads-click.example.com", "/en/9012", 1),
    ("www.track-ads.example.net", "/fr/3108", 1),
    ("click-track.example.com", "/en/139002", 1),
    ("blog.ads-server.example.net", "/de/90114", 1),
    ("adult-chat.example.com", "/en/48231", 1),
    ("www.adult-x-videos.example.net", "/es/1948/", 1),
    ("m.x-adult.example.com", "/en/7345.html", 1),
    ("architecture.example.net", "/en/612", 0),
    ("adventure.example.com", "/en/1803", 0),
    ("www.tradesman.example.net", "/en/20988", 0),
    ("blog.thanks.example.com", "/de/44120", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.

    A rule is a host and a path prefix written together, such as ``example.org/es/``. It fits
    the host and its subdomains. Equal lengths go to the longer host, then the greater text.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    fits = []
    for rule, verdict in rules:
        rule_host, slash, rest = rule.partition("/")
        same = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        entry = F.struct(
            F.lit(len(rule)).alias("size"),
            F.lit(len(rule_host)).alias("host_size"),
            F.lit(rule).alias("rule"),
            F.lit(verdict).alias("verdict"),
        )
        fits.append(F.when(same & F.startswith(path, F.lit(slash + rest)), entry))
    return F.array_max(F.array_compact(F.array(*fits)))


def _grams(host: Column, path: Column) -> Column:
    """All character n-grams of ``^host/path$``; the marks show where an n-gram stands."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))

    return F.concat(*(of(size) for size in GRAM_SIZES))


def labelled_table(spark: SparkSession, rows: Sequence[tuple[str, str, int]] = LABELLED) -> DataFrame:
    entries = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(float(y)).alias("label")) for h, p, y in rows]
    return spark.range(1).select(F.inline(F.array(*entries))).coalesce(1)


def train(labelled: DataFrame) -> PipelineModel:
    """Ridge logistic regression on the n-grams of a small table (host, path, label)."""
    stages = [
        HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams__", outputCol="__counts__"),
        Normalizer(inputCol="__counts__", outputCol="__features__"),
        LogisticRegression(
            featuresCol="__features__",
            labelCol="label",
            probabilityCol="__probability__",
            rawPredictionCol="__raw__",
            predictionCol="__prediction__",
            regParam=PENALTY,
            maxIter=PASSES,
            standardization=False,
        ),
    ]
    grams = labelled.select(_grams(F.col("host"), F.col("path")).alias("__grams__"), "label")
    return Pipeline(stages=stages).fit(grams)


def filter_urls(
    urls: DataFrame,
    url: str,
    rules: Sequence[tuple[str, str]],
    model: PipelineModel,
    threshold: float = 0.5,
) -> DataFrame:
    """Adds `host`, `path`, `rule`, `score` (probability of block) and `verdict` to every row.

    A fitting rule decides (the longest one, `rule` names it); elsewhere a score of at least
    `threshold` blocks. Null URLs and URLs without ``://`` have an empty host and path and are
    scored as such; repeated rows are judged alike; an input column with an output's name is
    replaced; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    parts = urls.withColumns({"__url_host__": host, "__url_path__": path})
    parts = parts.withColumn("__grams__", _grams(F.col("__url_host__"), F.col("__url_path__")))
    found = best_rule(F.col("__url_host__"), F.col("__url_path__"), rules)
    score = vector_to_array("__probability__")[1]
    verdict = F.coalesce(F.col("__rule__.verdict"), F.when(score >= threshold, "block").otherwise("allow"))
    outputs = {
        "host": F.col("__url_host__"),
        "path": F.col("__url_path__"),
        "rule": F.col("__rule__.rule"),
        "score": score,
        "verdict": verdict,
    }
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in outputs]
    scored = model.transform(parts.withColumn("__rule__", found))
    return scored.select(*kept, *(column.alias(name) for name, column in outputs.items()))
