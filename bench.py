"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
Every query runs once to warm up and then ``BENCH_RUNS`` times; its time is the
median, from building the plan to the last row, all columns computed (Spark's
``noop`` sink). ``value`` is the sum. Names on the command line choose queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tidecast.plans.catalog import QUERIES

HEADLINE = [
    "lag_features",
    "lag_features_by_series",
    "lag_features_bucketed",
    "drop_warmup",
    "var_fit",
    "var_fit_mllib",
    "var_fit_wide",
    "var_fit_by_epoch",
    "var_fit_by_series",
    "var_predict_loaded",
    "var_predict_epoch",
    "var_predict_by_series",
    "var_scores_attached",
    "decode_observations",
    "replay_encode",
    "drift_gradual",
    "drift_abrupt",
    "serving_blend",
    "approach_scores",
    "approach_scores_drift",
    "layer_batch",
    "layer_speed",
    "layer_serving",
    "stream_decode",
    "stream_speed",
    "stream_batch",
    "stream_lag_continuous",
    "serving_join_stream",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(spark, sf_dir, name)
        times = [timed(spark, sf_dir, name) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time, median of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
