"""Message envelopes: read from and written to Kafka, or files of the same shape.

The file form has the schema of Spark's Kafka source, so a layer runs unchanged
on either. Kafka needs its connector on the session's class path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.columns import col

# Fixed value: the column names and types of Spark's Kafka source.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)


def _options(fmt: str, options: Mapping[str, str], topics: Sequence[str]) -> dict[str, str]:
    if fmt == "kafka":
        return {"startingOffsets": "earliest", "subscribe": ",".join(topics), **options}
    return dict(options)


def _renamed(df: DataFrame, fmt: str, topics: Sequence[str]) -> DataFrame:
    """The transport's own time becomes ``ingest_ts``, clear of the event time."""
    messages = df.withColumnRenamed("timestamp", "ingest_ts")
    if fmt != "kafka" and topics:
        messages = messages.filter(col("topic").isin(*topics))
    return messages


def read_messages(
    spark: SparkSession, fmt: str, options: Mapping[str, str], topics: Sequence[str] = ()
) -> DataFrame:
    """Messages at rest. For files, ``fmt`` is the file format and ``path`` an option."""
    reader = spark.read.format(fmt).options(**_options(fmt, options, topics))
    return _renamed((reader if fmt == "kafka" else reader.schema(ENVELOPE)).load(), fmt, topics)


def stream_messages(
    spark: SparkSession, fmt: str, options: Mapping[str, str], topics: Sequence[str] = ()
) -> DataFrame:
    """Messages as a stream from one or more topics, from the earliest on.

    How much a micro-batch takes is the caller's choice: ``maxOffsetsPerTrigger`` or
    ``maxFilesPerTrigger`` among the options. Landed epochs do not depend on it.
    """
    reader = spark.readStream.format(fmt).options(**_options(fmt, options, topics))
    return _renamed((reader if fmt == "kafka" else reader.schema(ENVELOPE)).load(), fmt, topics)


def to_envelope(values: DataFrame, topic: str) -> DataFrame:
    """``value`` text (and ``key``, if present) as envelope rows for the file form."""
    key = col("key").cast("binary") if "key" in values.columns else F.lit(None).cast("binary")
    return values.select(
        key.alias("key"),
        col("value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def with_message_ids(values: DataFrame, epoch: Column) -> DataFrame:
    """``values`` with a ``key`` that is the same whenever the same epoch is sent again.

    It has the epoch, a digest of the text and a number among equal texts of the epoch, so it
    does not depend on the order that rows come in.
    """
    number = "row_number() OVER (PARTITION BY __epoch, value ORDER BY value)"
    named = values.withColumn("__epoch", epoch).withColumn("__number", F.expr(number))
    key = F.concat_ws("-", "__epoch", F.md5(col("value").cast("binary")), "__number")
    return named.withColumn("key", key).drop("__epoch", "__number")


def once(messages: DataFrame, delay: str) -> DataFrame:
    """The messages without those that came before under the same topic and key.

    A stream keeps a key for ``delay`` of arrival time, so an epoch that is sent again within it is read
    once. Messages without a key are all kept.
    """
    keyed = messages.filter(col("key").isNotNull())
    if messages.isStreaming:
        keyed = keyed.withWatermark("ingest_ts", delay).dropDuplicatesWithinWatermark(["topic", "key"])
    else:
        keyed = keyed.dropDuplicates(["topic", "key"])
    return keyed.unionByName(messages.filter(col("key").isNull()))


def write_messages(
    values: DataFrame, fmt: str, options: Mapping[str, str], topic: str, mode: str = "append"
) -> None:
    """Send ``value`` text to a topic, or append it to envelope files at ``path``."""
    if fmt == "kafka":
        rows = values.select(*[col(c) for c in ("key", "value") if c in values.columns])
        rows.write.format("kafka").options(**options).option("topic", topic).save()
    else:
        to_envelope(values, topic).write.format(fmt).mode(mode).options(**options).save()
