"""Time the headline queries; prints one JSON line.

Every query is computed completely: its result goes to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gridseries.catalog import all_queries

HEADLINE = [
    "weather_clean",
    "day_ahead_mape",
    "fix_data",
    "detect_derivatives",
    "null_out_extremes",
    "cluster_mean",
    "keep_first_duplicate",
    "availability_pct",
    "pivot_station",
    "lag_features",
    "regrid",
    "interpolate_limited",
    "scale_robust",
    "scale_quantile",
    "cv_splits",
    "train_per_fold",
    "predict_recurrent",
    "evaluate_folds",
    "rolling_mean",
    "nearest_place_join",
    "cluster_dbscan",
    "sweep_means",
    "arch_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridseries-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["daily_mean"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
