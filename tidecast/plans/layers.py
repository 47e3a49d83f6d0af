"""The three layers as plain DataFrame functions.

They serve tables as they are and micro-batches through ``streaming.layers``.
``epoch`` names the micro-batch column: lags start afresh in every epoch, and
the speed layer fits one model per epoch. With ``epoch=None`` a series runs on
through the whole input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidecast.functions.codec import Field, decode, encode, prediction_fields
from tidecast.functions.columns import col, cols
from tidecast.functions.names import predict_name
from tidecast.operators.cells import MAX_ROWS
from tidecast.operators.lags import lag_features
from tidecast.operators.predict import predict_var
from tidecast.operators.score import attach_scores
from tidecast.operators.serve import blend, by_topic, serving_join

SCORES = ["MAE_Score", "MSE_Score", "RMSE_Score"]


def _groups(by: Sequence[str], epoch: str | None) -> list[str]:
    return [*by, *([epoch] if epoch else [])]


def batch_layer(
    observations: DataFrame,
    coefficients: DataFrame,
    targets: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    epoch: str | None = "epoch_id",
    model_by: Sequence[str] = (),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Predict with a stored model: one for all series, or one per ``model_by``."""
    groups = _groups(by, epoch)
    lagged = lag_features(observations, targets, p, order, groups, max_rows=max_rows)
    return predict_var(lagged, targets, p, coefficients, model_by)


def speed_layer(
    observations: DataFrame,
    targets: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    epoch: str | None = "epoch_id",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Fit a model to each epoch of each series and predict those same rows."""
    groups = _groups(by, epoch)
    lagged = lag_features(observations, targets, p, order, groups, max_rows=max_rows)
    return predict_var(lagged, targets, p, by=groups)


def scored_rows(
    predicted: DataFrame, targets: Sequence[str], keys: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Prediction rows: keys, each target with its prediction, and the scores of
    the row's group for the last target."""
    pairs = [c for t in targets for c in (t, predict_name(t))]
    return attach_scores(predicted, targets, by).select(*cols([*keys, *pairs, *SCORES]))


def prediction_messages(
    rows: DataFrame,
    targets: Sequence[str],
    time: str = "TS",
    digits: int | None = None,
    rmse: bool = True,
    keys: Sequence[Field] = (),
) -> DataFrame:
    """Prediction rows as messages."""
    fields = prediction_fields(targets, time, rmse=rmse, keys=keys)
    return encode(rows, [f for f, _ in fields], digits=digits)


def serving_layer(
    messages: DataFrame,
    targets: Sequence[str],
    speed_topic: str,
    batch_topic: str,
    speed_weight: float,
    batch_weight: float,
    time: str = "TS",
    digits: int | None = 3,
    on: Sequence[str] | None = None,
    keys: Sequence[Field] = (),
) -> DataFrame:
    """Blend the two layers' prediction messages.

    They are joined on their time, keys and observed targets, which both layers repeat, so
    that messages of different observations with one time stay apart; give keys with a
    tie-break if observations can be equal. ``on=[time]`` joins on time alone.
    """
    served, _ = served_and_rejected(
        messages, targets, speed_topic, batch_topic, speed_weight, batch_weight, time, digits, on, keys
    )
    return served


def served_and_rejected(
    messages: DataFrame,
    targets: Sequence[str],
    speed_topic: str,
    batch_topic: str,
    speed_weight: float,
    batch_weight: float,
    time: str = "TS",
    digits: int | None = 3,
    on: Sequence[str] | None = None,
    keys: Sequence[Field] = (),
) -> tuple[DataFrame, DataFrame]:
    """``serving_layer`` and the messages of both topics that cannot be read."""
    fields = prediction_fields(targets, time, keys=keys)
    join = joined_on(on, time, keys, targets)
    both = messages.filter(col("topic").isin(speed_topic, batch_topic))
    good, rejected = decode(both, fields, keep=["topic"])
    speed, batch = (by_topic(good, topic).drop("topic") for topic in (speed_topic, batch_topic))
    joined = serving_join(speed, batch, targets, join)
    return blend(joined, targets, join, speed_weight, batch_weight, digits), rejected


def joined_on(
    on: Sequence[str] | None, time: str, keys: Sequence[Field], targets: Sequence[str]
) -> list[str]:
    """The columns that predictions are joined on, unless the caller names others."""
    return list(on or [time, *[k for k, _ in keys], *targets])
