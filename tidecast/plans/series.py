"""The series that the registered queries are run on, from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.names import quote

TARGETS = ["y1", "y2"]
LAGS = 2
TIME = "TS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(events: DataFrame) -> DataFrame:
    """Total ``click`` value (y1) and ``purchase`` value (y2) per hour with events.

    Combined on the map side. The result has one row per hour, so its length is
    bound by the calendar (8,784 rows a year) whatever the number of events.
    """

    hour = F.expr(f"CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS {TIME}")

    def total(kind: str, name: str):
        return F.expr(f"sum(if(event_type = '{kind}', value, 0.0D)) AS {name}")

    timed = events.filter("ts IS NOT NULL")
    return timed.groupBy(hour).agg(total("click", "y1"), total("purchase", "y2"))


def with_epoch(series: DataFrame, time: str = TIME) -> DataFrame:
    """A micro-batch number taken from the data: days since 1970-01-01.

    Never null (rows without a time get 0), so joins on it need no null filter.
    """
    day = f"coalesce(datediff(CAST({quote(time)} AS DATE), DATE '1970-01-01'), 0)"
    return series.withColumn("epoch_id", F.expr(day))
