"""Running the layers on streams.

Two ways to run them:

* ``start_layer`` hands every micro-batch to a handler (``foreachBatch``). A
  handler is a function of ``(rows, epoch_id)`` that writes by epoch, so a
  replayed micro-batch replaces its earlier output.
* ``to_files`` writes a streaming plan straight to a table through the exactly-
  once file sink. ``land_observations`` does so for decoded messages, split by
  an epoch taken from the event time, and ``land_rejected`` for those that cannot be
  read. ``continuous.stream_lags`` makes lags in such a plan, ``speed`` has the speed layer's
  fits as streaming state, and a stored model is joined to the lags as it is.

Both need a checkpoint location and go on from it after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidecast.functions.codec import Field, decode, encode, observation_fields
from tidecast.functions.columns import cols
from tidecast.functions.names import quote
from tidecast.operators.lags import continue_lags
from tidecast.operators.predict import predict_var
from tidecast.plans.layers import (
    batch_layer,
    prediction_messages,
    scored_rows,
    served_and_rejected,
    speed_layer,
)
from tidecast.plans.series import with_epoch
from tidecast.sources.messages import with_message_ids, write_messages
from tidecast.sources.tables import EPOCH, append_epoch

Handler = Callable[[DataFrame, int], None]
# Columns of the envelope that put messages with one time in order.
ARRIVAL = ["partition", "offset"]


@dataclass
class Sinks:
    """Where a layer writes. Anything left out is not written.

    With ``tail``, a table of each epoch's last rows, the batch layer's lags go
    on from one micro-batch to the next; otherwise they start afresh in each.
    """

    predictions: str | None = None
    tail: str | None = None
    master: str | None = None
    rejects: str | None = None
    topic: str | None = None
    message_format: str = "kafka"
    message_options: dict[str, str] = field(default_factory=dict)


def _deliver(rows: DataFrame, targets, time, epoch_id: int, sinks: Sinks, keys) -> None:
    rows = rows.persist()
    try:
        if sinks.predictions:
            append_epoch(rows, sinks.predictions, epoch_id)
        if sinks.topic:
            values = prediction_messages(rows, targets, time, keys=keys)
            values = with_message_ids(values, F.lit(epoch_id))
            write_messages(values, sinks.message_format, sinks.message_options, sinks.topic)
    finally:
        rows.unpersist()


class Observed:
    """A handler of observations: keep what was read, predict, deliver.

    Called with messages, as ``foreachBatch`` does, it decodes them once. ``rows`` takes
    observations that are decoded already, such as those of a landed epoch.
    ``predict(rows, epoch_id, order)`` gives the predictions and any rows that came too
    late to be predicted.
    """

    def __init__(self, targets: Sequence[str], time: str, sinks: Sinks, keys: Sequence[Field], predict):
        self.targets, self.time, self.sinks, self.keys = list(targets), time, sinks, list(keys)
        self.predict = predict

    def order(self, rows: DataFrame) -> list[str]:
        """Time, then keys and arrival if there are any; equal rows are told apart by nothing else."""
        own = [self.time, *[k for k, _ in self.keys], *[c for c in ARRIVAL if c in rows.columns]]
        return [*own, *self.targets]

    def __call__(self, messages: DataFrame, epoch_id: int) -> None:
        keep = [c for c in ARRIVAL if c in messages.columns]
        good, rejected = decode(messages, observation_fields(self.targets, self.time, self.keys), keep=keep)
        # One decoded copy serves both: a message is either read or rejected.
        both = good.withColumn("__bad", F.lit(False)).unionByName(
            rejected.drop(*keep).withColumn("__bad", F.lit(True)), allowMissingColumns=True
        ).persist()
        try:
            self.rows(
                both.filter("NOT __bad").select(*cols(good.columns)),
                epoch_id,
                both.filter("__bad").select("value", "bad_field"),
            )
        finally:
            both.unpersist()

    def rows(self, good: DataFrame, epoch_id: int, rejected: DataFrame | None = None) -> None:
        sinks = self.sinks
        if sinks.master:
            append_epoch(good.drop(*ARRIVAL), sinks.master, epoch_id)
        predicted, late = self.predict(good, epoch_id, self.order(good))
        if late is not None:
            fields = [f for f, _ in observation_fields(self.targets, self.time, self.keys)]
            values = encode(late, fields).withColumn("bad_field", F.lit("late"))
            rejected = values if rejected is None else rejected.unionByName(values)
        if sinks.rejects and rejected is not None:
            append_epoch(rejected, sinks.rejects, epoch_id)
        if not good.isEmpty():
            names = [self.time, *[k for k, _ in self.keys]]
            scored = scored_rows(predicted, self.targets, names, [])
            _deliver(scored, self.targets, self.time, epoch_id, sinks, self.keys)


def _tail(rows: DataFrame, path: str, names: Sequence[str], epoch_id: int) -> DataFrame:
    """The last rows before an epoch: those that the latest epoch before it left.

    Read with the rows' own schema, since an epoch may have left no file, or no epoch has
    been before.
    """
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField(EPOCH, T.IntegerType())])
    try:
        left = rows.sparkSession.read.schema(schema).parquet(path).filter(f"{EPOCH} < {epoch_id}")
    except AnalysisException:  # nothing written yet
        return rows.select(*cols(names)).limit(0)
    newest = left.agg(F.max(EPOCH).alias("__newest"))
    return left.join(newest, F.col(EPOCH) == F.col("__newest")).select(*cols(names))


def batch_handler(
    coefficients: DataFrame,
    targets: Sequence[str],
    p: int,
    sinks: Sinks,
    time: str = "TS",
    by: Sequence[str] = (),
    keys: Sequence[Field] = (),
) -> Observed:
    """Keep the observations in the master table; predict with the stored model.

    ``keys`` are the further fields of the messages, ``by`` those of them that name a series.
    """

    def within_epoch(rows: DataFrame, _: int, order: list[str]):
        return batch_layer(rows, coefficients, targets, p, order, by, epoch=None), None

    def over_epochs(rows: DataFrame, epoch_id: int, order: list[str]):
        names = list(dict.fromkeys([*by, *order, *targets]))
        before = _tail(rows, sinks.tail, names, epoch_id)
        lagged, late, after = continue_lags(rows, before, targets, p, order, by)
        append_epoch(after, sinks.tail, epoch_id)
        return predict_var(lagged, targets, p, coefficients), late

    return Observed(targets, time, sinks, keys, over_epochs if sinks.tail else within_epoch)


def speed_handler(
    targets: Sequence[str],
    p: int,
    sinks: Sinks,
    time: str = "TS",
    by: Sequence[str] = (),
    keys: Sequence[Field] = (),
) -> Observed:
    """Fit a model to each series of the micro-batch and predict with it."""

    def predict(rows: DataFrame, _: int, order: list[str]):
        return speed_layer(rows, targets, p, order, by, epoch=None), None

    return Observed(targets, time, sinks, keys, predict)


def serving_handler(
    targets: Sequence[str],
    speed_topic: str,
    batch_topic: str,
    speed_weight: float,
    batch_weight: float,
    sinks: Sinks,
    time: str = "TS",
    on: Sequence[str] | None = None,
    keys: Sequence[Field] = (),
) -> Handler:
    """Blend the predictions that came in the same micro-batch, joined as in ``serving_layer``.

    ``serving.serving_stream`` also joins those that came in different ones.
    """

    def handle(messages: DataFrame, epoch_id: int) -> None:
        messages = messages.persist()
        try:
            rows, rejected = served_and_rejected(
                messages, targets, speed_topic, batch_topic, speed_weight, batch_weight, time, on=on, keys=keys
            )
            if sinks.predictions:
                append_epoch(rows, sinks.predictions, epoch_id)
            if sinks.rejects:
                append_epoch(rejected, sinks.rejects, epoch_id)
        finally:
            messages.unpersist()

    return handle


def _triggered(writer, interval: str | None):
    """Every ``interval``, or once over all that is there if None."""
    if interval:
        return writer.trigger(processingTime=interval)
    return writer.trigger(availableNow=True)


def start_layer(
    messages: DataFrame, handler: Handler, checkpoint: str, interval: str | None
) -> StreamingQuery:
    """Start a handler on a message stream; the caller waits on the query."""
    writer = messages.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return _triggered(writer, interval).start()


def to_files(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = None,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Start a streaming plan that appends to a parquet table."""
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _triggered(writer, interval).start()


def land_observations(
    messages: DataFrame,
    targets: Sequence[str],
    path: str,
    checkpoint: str,
    interval: str | None = None,
    time: str = "TS",
    keys: Sequence[Field] = (),
) -> StreamingQuery:
    """Decode an observation stream into a table of event-day epochs.

    ``land_rejected`` lands the messages that this leaves out.
    """
    good, _ = decode(messages, observation_fields(targets, time, keys))
    return to_files(with_epoch(good, time), path, checkpoint, interval, ["epoch_id"])


def land_rejected(
    messages: DataFrame,
    fields: Sequence[Field],
    path: str,
    checkpoint: str,
    interval: str | None = None,
    keep: Sequence[str] = (),
) -> StreamingQuery:
    """The messages of a stream that cannot be read, with the field that is to blame."""
    _, rejected = decode(messages, fields, keep=keep)
    return to_files(rejected, path, checkpoint, interval)


def landed(
    spark: SparkSession,
    path: str,
    targets: Sequence[str],
    time: str = "TS",
    keys: Sequence[Field] = (),
) -> DataFrame:
    """The landed observations so far."""
    fields = [*observation_fields(targets, time, keys), ("epoch_id", "int")]
    schema = ", ".join(f"{quote(name)} {kind}" for name, kind in fields)
    return spark.read.schema(schema).parquet(path).select(*cols([name for name, _ in fields]))
