"""What the text operators share: tables, folds, the shared folder, Arrow loops."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidecast.sources.scratch import written

#: White space that separates words: blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = [
    "WORD", "fold", "free_name", "in_arrow", "lower_ascii", "slices", "table", "words", "written",
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def fold(doc_id: Column) -> Column:
    """0 to 4 by the crc32 of the id as text; 0 is held out. Null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """``fn`` over Arrow batches. Each batch is handled and sent on before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows of the given lengths into runs of about ``limit`` in sum, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
