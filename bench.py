"""Headline queries, median of two runs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.plans import registry
from cohortlens.session import local_session

HEADLINE = (
    "pair_timepoints",
    "paired_change_corr",
    "describe",
    "corr_with_target",
    "mann_whitney",
    "ks_2sample",
    "biomarker_screen",
    "biomarker_screen_flat",
    "histogram_table",
    "boxplot_table",
    "classification_report",
    "regression_metrics",
    "roc_auc",
    "column_transformer",
    "stratified_kfold",
    "ols",
    "ols_inference",
    "robust_lm",
    "knn_classify",
    "random_forest_reg",
    "logistic",
    "grid_search_ridge",
    "knn_join_cells",
    "kde_table",
    "group_median",
    "threshold_regression",
    "gbt_reg",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cohortlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One untimed pass over a small query starts the workers and loads classes.
    registry.QUERIES["count_rows"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        took = []
        for _ in range(RUNS):
            start = time.monotonic()
            # The noop sink runs the whole query and moves no rows to the driver.
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - start)
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
