"""Serving: separate the prediction topics, join them, blend, look at the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.columns import col, cols
from tidecast.functions.names import predict_name, quote


def by_topic(messages: DataFrame, topic: str) -> DataFrame:
    """The messages of one topic; filter before decoding, so only they are parsed."""
    return messages.filter(col("topic") == topic)


def serving_join(
    speed: DataFrame, batch: DataFrame, targets: Sequence[str], on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join of the two layers' prediction rows.

    Observed values are the speed layer's. Predictions become ``Speed_<t>`` and
    ``Batch_<t>``, the row scores ``Speed_RMSE`` and ``Batch_RMSE`` if both have
    them.
    """
    scored = "RMSE_Score" in speed.columns and "RMSE_Score" in batch.columns

    def side(df: DataFrame, prefix: str, observed: bool) -> DataFrame:
        return df.selectExpr(
            *cols(on),
            *(cols([t for t in targets if t not in on]) if observed else []),
            *[f"{quote(predict_name(t))} AS {quote(f'{prefix}_{t}')}" for t in targets],
            *([f"RMSE_Score AS {prefix}_RMSE"] if scored else []),
        )

    return side(speed, "Speed", True).join(side(batch, "Batch", False), list(on), how)


def blend(
    joined: DataFrame,
    targets: Sequence[str],
    on: Sequence[str],
    speed_weight: float,
    batch_weight: float,
    digits: int | None = 3,
) -> DataFrame:
    """Append ``Wt_<t>``, the weighted sum of both predictions, and round all values.

    The weights are used as given; they need not sum to one.
    """
    values = {}
    for t in targets:
        speed, batch = quote(f"Speed_{t}"), quote(f"Batch_{t}")
        values[t] = quote(t)
        values[f"Speed_{t}"] = speed
        values[f"Batch_{t}"] = batch
        values[f"Wt_{t}"] = (
            f"double({float(speed_weight)!r}) * {speed} + double({float(batch_weight)!r}) * {batch}"
        )
    values |= {c: c for c in ("Speed_RMSE", "Batch_RMSE") if c in joined.columns}
    return joined.selectExpr(
        *cols([c for c in on if c not in targets]),
        *[
            f"{sql if digits is None else f'round({sql}, {digits})'} AS {quote(name)}"
            for name, sql in values.items()
        ],
    )


def time_extent(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """First and last time, per group if ``by`` is given."""
    return df.groupBy(*cols(by)).agg(
        F.min(col(time)).alias("start_ts"), F.max(col(time)).alias("end_ts")
    )


def preview_latest(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The n latest rows, as a DataFrame; a top-n, not a full sort."""
    return df.orderBy(*[col(o).desc() for o in order]).limit(n)
