"""Predictions, scores, serving and drift."""

import datetime as dt
import math

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tidecast.functions.names import target_columns
from tidecast.operators.drift import inject_abrupt, inject_gradual
from tidecast.operators.fit import fit_var
from tidecast.operators.lags import lag_features
from tidecast.operators.predict import (
    merge_predictions,
    predict_var,
    residuals,
    stack_predictions,
)
from tidecast.operators.score import attach_scores, residual_cov, score
from tidecast.plans.layers import serving_layer
from tidecast.operators.serve import blend, by_topic, preview_latest, serving_join, time_extent

ORDER = ["ts", "id"]
BOTH = ["y1", "y2"]


@pytest.fixture
def lagged(series):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(80, 2))]
    df = series(rows).withColumn("g", F.when(F.col("id") % 7 > 0, F.floor(F.col("id") / 40)))
    return lag_features(df, BOTH, 2, ORDER, ["g"])


def test_targets_are_all_but_time():
    assert target_columns(["TS", "a", "b"], "ts") == ["a", "b"]
    assert target_columns(["ts", "a", "b"], "ts", ["b"]) == ["a"]


def test_stored_model_equals_fit_on_same_rows(lagged):
    whole = predict_var(lagged, BOTH, 2)
    assert same_rows(whole, predict_var(lagged, BOTH, 2, fit_var(lagged, BOTH, 2)))


def test_rows_without_group_get_null(lagged):
    predicted = predict_var(lagged, BOTH, 2, by=["g"])
    assert predicted.count() == lagged.count()
    assert predicted.filter("g IS NULL").filter("y1_Predict IS NOT NULL").isEmpty()
    assert predicted.filter("g IS NOT NULL AND y1_Predict IS NULL").isEmpty()


def test_filter_on_prediction_and_status(lagged):
    """Filters above the solved coefficients neither fail nor grow the plan."""
    predicted = predict_var(lagged, BOTH, 2, by=["g"])
    positive = [r for r in predicted.collect() if r["y1_Predict"] and r["y1_Predict"] > 0]
    assert predicted.filter("y1_Predict > 0").count() == len(positive)


def test_null_lag_gives_null_prediction(series):
    rows = [(float(i * i % 11),) for i in range(30)]
    rows[10] = (None,)
    lagged = lag_features(series(rows), ["y1"], 2, ORDER)
    predicted = {r["id"]: r["y1_Predict"] for r in predict_var(lagged, ["y1"], 2).collect()}
    assert [i for i, v in predicted.items() if v is None] == [11, 12]
    assert len(predicted) == 28


def test_merge_of_stacked_is_identity(lagged):
    predicted = predict_var(lagged, BOTH, 2).select("id", "ts", *BOTH, "y1_Predict", "y2_Predict")
    stacked = stack_predictions(predicted, BOTH, ["id", "ts"])
    assert stacked.count() == 2 * predicted.count()
    assert same_rows(merge_predictions(stacked, BOTH, ["id", "ts"]), predicted)
    one_sided = stacked.filter("NOT (target = 'y2' AND id = 20)")
    assert merge_predictions(one_sided, BOTH, ["id", "ts"]).filter("id = 20").isEmpty()


def test_scores_by_hand(series):
    df = series([(1.0, 0.0), (2.0, 0.0), (4.0, None)]).withColumns(
        {"y1_Predict": F.lit(2.0), "y2_Predict": F.lit(1.0)}
    )
    rows = {r["target"]: r for r in score(df, BOTH).collect()}
    assert (rows["y1"]["n"], rows["y1"]["mae"]) == (3, 1.0)
    assert rows["y1"]["mse"] == pytest.approx(5 / 3)
    assert rows["y1"]["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert (rows["y2"]["n"], rows["y2"]["mae"]) == (2, 1.0)
    attached = attach_scores(df, BOTH, target="y1").collect()
    assert len(attached) == 3
    assert {r["MSE_Score"] for r in attached} == {rows["y1"]["mse"]}
    assert {r["y2_RMSE"] for r in attached} == {1.0}


def test_residual_covariance(lagged):
    with_resid = residuals(predict_var(lagged, BOTH, 2), BOTH)
    e = np.array([[r["y1_resid"], r["y2_resid"]] for r in with_resid.collect()])
    expected = np.cov(e.T)
    n = len(e)
    for r in residual_cov(with_resid, BOTH, 2).collect():
        i, j = BOTH.index(r["target_a"]), BOTH.index(r["target_b"])
        assert r["cov"] == pytest.approx(expected[i, j])
        assert r["cov_adjusted"] == pytest.approx(expected[i, j] * (n - 1) / (n - 5))


PREDICTIONS = "TS timestamp_ntz, y double, y_Predict double, RMSE_Score double"
T = [dt.datetime(2024, 1, 1, h) for h in range(4)]


@pytest.mark.parametrize(
    ("speed_weight", "batch_weight", "expected"),
    [(0, 1, 30.0), (1, 0, 10.0), (0.5, 0.5, 20.0), (0.3, 0.3, 12.0), (-1, 2, 50.0)],
)
def test_blend_uses_weights_as_given(spark, speed_weight, batch_weight, expected):
    speed = spark.createDataFrame([(T[0], 1.0, 10.0, 0.5), (T[1], 1.0, 11.0, 0.5)], PREDICTIONS)
    batch = spark.createDataFrame([(T[0], 1.0, 30.0, 0.7), (T[2], 1.0, 31.0, 0.7)], PREDICTIONS)
    joined = serving_join(speed, batch, ["y"], ["TS"])
    rows = blend(joined, ["y"], ["TS"], speed_weight, batch_weight).collect()
    assert len(rows) == 1  # a time on one side only has no blend
    assert rows[0].asDict() == {
        "TS": T[0], "y": 1.0, "Speed_y": 10.0, "Batch_y": 30.0, "Wt_y": expected,
        "Speed_RMSE": 0.5, "Batch_RMSE": 0.7,
    }


def test_tied_times_are_kept_apart_by_observed_values(spark):
    messages = spark.createDataFrame(
        [
            (topic, f"2024-01-01 00:00:00,{y},{y + shift},0.5")
            for topic, shift in (("s", 1), ("b", 2))
            for y in (1.0, 2.0, 3.0)
        ],
        "topic string, value string",
    )
    by_time = serving_layer(messages, ["y"], "s", "b", 0.5, 0.5, on=["TS"])
    assert by_time.count() == 9
    apart = serving_layer(messages, ["y"], "s", "b", 0.5, 0.5)
    assert apart.columns == by_time.columns
    assert sorted(r["Wt_y"] for r in apart.collect()) == [2.5, 3.5, 4.5]


def test_blend_rounds_to_digits(spark):
    joined = spark.createDataFrame([(1, 1.23456, 2.0, 3.0)], "k int, y double, Speed_y double, Batch_y double")
    assert blend(joined, ["y"], ["k"], 0.5, 0.5).first()["y"] == 1.235
    assert blend(joined, ["y"], ["k"], 0.5, 0.5, digits=None).first()["y"] == 1.23456


def test_topics_extent_preview(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2)], "topic string, n int")
    assert by_topic(df, "a").count() == 2
    assert tuple(time_extent(df, "n").first()) == (1, 3)
    extents = {r["topic"]: (r["start_ts"], r["end_ts"]) for r in time_extent(df, "n", ["topic"]).collect()}
    assert extents == {"a": (2, 3), "b": (1, 1)}
    assert [r["n"] for r in preview_latest(df, ["n"], 2).collect()] == [3, 2]


def test_gradual_drift(series):
    rows = inject_gradual(series([(1.0, 2.345), (5.0, 6.0)]), BOTH, where=F.col("id") == 0)
    got = sorted((r["id"], r["step"], r["y1"], r["y2"]) for r in rows.collect())
    assert got == [(0, 1, 1.1, 2.44), (0, 2, 1.2, 2.54), (0, 3, 1.3, 2.64), (1, 0, 5.0, 6.0)] or got == [
        (0, 1, 1.1, 2.45), (0, 2, 1.2, 2.55), (0, 3, 1.3, 2.65), (1, 0, 5.0, 6.0)
    ]


def test_abrupt_drift(series):
    df = series([(float(i), 0.0) for i in range(400)])
    moved = inject_abrupt(df, BOTH, F.col("id"), seed=3)
    jumps = [
        (round((r["y1"] - r["id"]) * 10), round(r["y2"] * 10)) for r in moved.orderBy("id").collect()
    ]
    assert len(jumps) == 400
    for column in zip(*jumps):
        assert set(column) == set(range(1, 11))
        assert max(column.count(v) for v in range(1, 11)) < 80
    assert len(set(jumps)) > 60  # the columns jump independently
    assert same_rows(moved, inject_abrupt(df.repartition(7), BOTH, F.col("id"), seed=3))
    other = inject_abrupt(df, BOTH, F.col("id"), seed=4)
    assert not same_rows(moved, other)


def test_abrupt_drift_in_steps_accumulates(series):
    rows = inject_abrupt(series([(0.0, 0.0)]), BOTH, F.col("id"), seed=1, steps=3).orderBy("step").collect()
    y = [r["y1"] for r in rows]
    assert len(y) == 3 and 0 < y[0] < y[1] < y[2]


def test_odd_readings_leave_other_rows_alone(series):
    """A NaN gives null predictions where it is a lag, and no score of its row."""
    values = [(float(i * 7 % 11), float(i * i % 13)) for i in range(60)]
    values[30] = (float("nan"), values[30][1])
    lagged = lag_features(series(values), ["y1", "y2"], 2, ["ts", "id"])
    predicted = predict_var(lagged, ["y1", "y2"], 2)
    assert {r["id"] for r in predicted.filter("y1_Predict IS NULL").collect()} == {31, 32}
    assert predicted.filter("isnan(y1_Predict) OR isnan(y2_Predict)").isEmpty()
    found = {r["target"]: r for r in score(predicted, ["y1", "y2"]).collect()}
    assert (found["y1"]["n"], found["y2"]["n"]) == (55, 56)
    assert all(np.isfinite(r[m]) for r in found.values() for m in ("mae", "mse", "rmse"))


def test_gradual_drift_is_rounded_at_each_step(series):
    """A step that rounding swallows changes nothing, however often it is taken."""
    df = series([(1.0,), (2.5,)])
    for steps in (3, 6):
        moved = inject_gradual(df, ["y1"], step=0.004, steps=steps)
        assert {r["y1"] for r in moved.collect()} == {1.0, 2.5}
