"""What the plans must look like for the work to scale."""

import re

import pytest
from conftest import executed_plan

from tidecast.operators.lags import lag_features
from tidecast.operators.predict import predict_var
from tidecast.operators.score import attach_scores
from tidecast.plans.catalog import QUERIES
from tidecast.plans.series import LAGS, TARGETS, hourly, with_epoch


@pytest.fixture
def predicted(events):
    rows = events.select("user_id", "ts", "event_id", "value")
    lagged = lag_features(rows, ["value"], 2, ["ts", "event_id"], ["user_id"])
    return attach_scores(predict_var(lagged, ["value"], 2, by=["user_id"]), ["value"], ["user_id"])


def test_fit_predict_score_share_one_scan_and_shuffle(predicted):
    plan = executed_plan(predicted)
    # One scan and shuffle for all rows with a user; the other scan is of rows
    # without one, whose filter is pushed into the files.
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) <= 3
    assert plan.count("FileScan") <= 2
    assert "ReusedExchange" in plan
    assert "PushedFilters: [IsNotNull(user_id)]" in plan


def test_epoch_layers_scan_events_once(events):
    lagged = lag_features(
        with_epoch(hourly(events)), TARGETS, LAGS, ["TS"], ["epoch_id"], max_rows=None
    )
    scored = attach_scores(predict_var(lagged, TARGETS, LAGS, by=["epoch_id"]), TARGETS, ["epoch_id"])
    plan = executed_plan(scored)
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_fit_combines_before_the_shuffle(spark, sf_dir):
    plan = executed_plan(QUERIES["var_fit_by_series"](spark, sf_dir))
    assert "partial_covar_pop" in plan
    assert plan.count("Exchange hashpartitioning(user_id") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "Python" not in plan


def test_tails_are_limited_before_the_shuffle(spark, sf_dir):
    plan = executed_plan(QUERIES["lag_features_bucketed"](spark, sf_dir))
    assert "row_number(), 2, Partial" in plan
    window = [line for line in plan.splitlines() if "Window [lag(value" in line]
    assert window and all("__cell_0" in line for line in window)


@pytest.mark.parametrize("name", ["drift_gradual", "drift_abrupt", "decode_observations", "replay_encode"])
def test_row_operators_do_not_shuffle(spark, sf_dir, name):
    plan = executed_plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan
    assert "Python" not in plan


def test_topic_filter_reaches_the_files(spark, sf_dir):
    assert "EqualTo(topic,click)" in executed_plan(QUERIES["topic_demux"](spark, sf_dir))


def test_preview_is_a_top_n(spark, sf_dir):
    assert "TakeOrderedAndProject" in executed_plan(QUERIES["preview_latest"](spark, sf_dir))
