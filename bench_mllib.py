"""Time the ML-pipeline way of doing the speed layer's work against ours.

The pipeline way fits and evaluates one model per target and per group: two
pipelines and six evaluator passes for each epoch, as a micro-batch loop does.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.ml.evaluation import RegressionEvaluator

from bench import session
from tidecast.functions.names import predict_name
from tidecast.operators.lags import lag_features
from tidecast.operators.mllib import fit_pipelines, predict_pipelines
from tidecast.plans.catalog import QUERIES
from tidecast.plans.series import LAGS, TARGETS, hourly, table, with_epoch


def by_pipeline(lagged, targets) -> None:
    models, _ = fit_pipelines(lagged, targets, LAGS)
    predicted = predict_pipelines(lagged, models, LAGS)
    for t in targets:
        for metric in ("rmse", "mse", "mae"):
            RegressionEvaluator(
                labelCol=t, predictionCol=predict_name(t), metricName=metric
            ).evaluate(predicted)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 2)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    events = table(spark, sf_dir, "events")
    hours = with_epoch(hourly(events)).persist()
    epochs = [r["epoch_id"] for r in hours.select("epoch_id").distinct().collect()]

    def one_epoch(e):
        rows = hours.filter(f"epoch_id = {e}")
        by_pipeline(lag_features(rows, TARGETS, LAGS, ["TS"], max_rows=None), TARGETS)

    def ours(name):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    one_epoch(epochs[0])
    for name in ("var_scores_by_epoch", "var_predict_by_series"):
        ours(name)  # to warm up
    print(
        json.dumps(
            {
                "epochs": len(epochs),
                "epochs_by_pipeline": timed(lambda: [one_epoch(e) for e in epochs]),
                "epochs_ours": timed(lambda: ours("var_scores_by_epoch")),
                "all_users_ours": timed(lambda: ours("var_predict_by_series")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
