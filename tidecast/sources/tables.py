"""Series, prediction and model tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.columns import col, cols
from tidecast.functions.names import quote

EPOCH = "epoch_id"


# Without these, CSV text keeps milliseconds only.
_CSV_TIMES = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header. Give a schema; without one, types are inferred
    by an extra pass over the file."""
    if schema is None:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.option("header", True).options(**_CSV_TIMES).schema(schema).csv(path)


def read_csv_lines(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The lines of a CSV file that fit the schema, and those that do not, as ``line``.

    A line does not fit if it has too many or too few fields or one that cannot be read; good
    and rejected lines are all there are. A record is one line. With ``header`` lines that are the columns'
    names are skipped, as each file's first line.
    """
    corrupt = "__line"
    names = [f.name for f in schema.fields]
    whole = ", ".join([f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema.fields] + [f"{corrupt} string"])
    options = {**_CSV_TIMES, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    lines = spark.read.text(path)
    if header:
        lines = lines.filter(col("value") != F.lit(",".join(names)))
    parsed = lines.select(F.from_csv("value", whole, options).alias("row")).select("row.*")
    good = parsed.filter(col(corrupt).isNull()).select(*cols(names))
    return good, parsed.filter(col(corrupt).isNotNull()).select(col(corrupt).alias("line"))


def with_file_order(rows: DataFrame, name: str = "row") -> DataFrame:
    """Rows of a file scan with their place in the files: by file name, then as they stand.

    Apply it to the scan itself. ``name`` is a bigint that sorts like the rows and has gaps: Spark
    reads a file in blocks, so it is the number of the block, by file and start, and the
    row's number within it. The blocks are counted in one task; there is a row for each.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    starts = placed.groupBy("__file", "__block").agg(F.min("__id").alias("__start"))
    order = "OVER (ORDER BY __file, __block)"
    numbered = starts.select("*", F.expr(f"bigint(row_number() {order}) AS __n"))
    joined = placed.join(numbered, ["__file", "__block"])
    place = F.shiftleft("__n", 33) + F.col("__id") - F.col("__start")
    return joined.withColumn(name, place).drop("__file", "__block", "__id", "__start", "__n")


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("header", header).options(**_CSV_TIMES).csv(path)


def append_epoch(df: DataFrame, path: str, epoch: int | None = None) -> None:
    """Add rows to a table, once per epoch.

    The table is partitioned by epoch, and writing an epoch again replaces its
    partition, so a replayed micro-batch adds nothing twice. Without ``epoch``
    the rows carry their own ``epoch_id``, and a write may hold several. They are
    then rebalanced by epoch: not every task writes a file to every partition,
    and AQE splits an epoch that is too large for one task.
    """
    rows = df.hint("rebalance", EPOCH) if epoch is None else df.withColumn(EPOCH, F.lit(epoch))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(EPOCH)
        .parquet(path)
    )


def write_model(coefficients: DataFrame, path: str, model_id: str) -> None:
    """Store a coefficient table as one model, replacing the model of that id only."""
    (
        coefficients.withColumn("model_id", F.lit(model_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_id")
        .parquet(path)
    )


def read_model(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """One model's coefficients; only its partition is read. An unknown id is an error."""
    model = spark.read.parquet(path).filter(col("model_id") == model_id).drop("model_id")
    if model.isEmpty():
        raise ValueError(f"no model {model_id!r} in {path}")
    return model


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*cols(columns)) if columns else table
