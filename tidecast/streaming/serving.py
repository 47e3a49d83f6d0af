"""Serving as a stream: both prediction streams joined on their time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.codec import Field, decode, prediction_fields
from tidecast.functions.columns import col
from tidecast.operators.serve import blend, by_topic, serving_join
from tidecast.plans.layers import joined_on

# A watermark needs a timestamp with zone; the time itself stays a join key.
_EVENT = "__event"


def serving_stream(
    messages: DataFrame,
    targets: Sequence[str],
    speed_topic: str,
    batch_topic: str,
    speed_weight: float,
    batch_weight: float,
    delay: str | None,
    time: str = "TS",
    digits: int | None = 3,
    on: Sequence[str] | None = None,
    keys: Sequence[Field] = (),
    unmatched: bool = False,
) -> DataFrame:
    """The blend of ``serving_layer`` on a stream, joined on the same columns.

    The two predictions of a time may come in different micro-batches. A
    prediction waits until the watermark, the latest time seen in the slower
    stream less ``delay``, has passed it; then its state is dropped, and a partner
    that comes later finds nothing. The caller must know how late partners can be.
    With ``unmatched`` it comes out then, without a blend, and the column ``missing`` has the topic
    whose prediction did not come (null for pairs); predictions that come later still are dropped
    by Spark and counted in the query's progress, so served, unmatched and dropped are all there were.
    With ``delay=None`` predictions wait for ever: no pair is lost, but the state is
    never dropped either, so it is for streams that end.
    """
    if unmatched and delay is None:
        raise ValueError("without a delay every prediction waits for its partner")
    fields = prediction_fields(targets, time, keys=keys)
    names = joined_on(on, time, keys, targets)

    def side(topic: str) -> DataFrame:
        good, _ = decode(by_topic(messages, topic), fields)
        if delay is None:
            return good
        return good.withColumn(_EVENT, col(time).cast("timestamp")).withWatermark(_EVENT, delay)

    join = names if delay is None else [*names, _EVENT]
    joined = serving_join(side(speed_topic), side(batch_topic), targets, join, "full_outer" if unmatched else "inner")
    blended = blend(joined, targets, join, speed_weight, batch_weight, digits).drop(_EVENT)
    if not unmatched:
        return blended
    # Predictions that can be read are never null.
    no_speed, no_batch = (col(f"{side}_{targets[0]}").isNull() for side in ("Speed", "Batch"))
    return blended.withColumn("missing", F.when(no_speed, speed_topic).when(no_batch, batch_topic))
