"""Delimited messages: text to typed rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.columns import cols, finite, stacked
from tidecast.functions.names import quote

# The field order and the time text of the wire format.
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

Field = tuple[str, str]


def observation_fields(
    targets: Sequence[str], time: str = "TS", keys: Sequence[Field] = ()
) -> list[Field]:
    """``time,[key,...]x1,x2,...``; the keys name the series and tell tied rows apart."""
    return [(time, "timestamp_ntz"), *keys, *[(t, "double") for t in targets]]


def prediction_fields(
    targets: Sequence[str],
    time: str = "TS",
    prefix: str = "",
    rmse: bool = True,
    keys: Sequence[Field] = (),
) -> list[Field]:
    """``time,[key,...]x1,x1_hat,x2,x2_hat,...[,rmse]``; ``prefix`` renames the value fields."""
    fields = [(time, "timestamp_ntz"), *keys]
    for t in targets:
        fields += [(f"{prefix}{t}", "double"), (f"{prefix}{t}_Predict", "double")]
    return fields + ([("RMSE_Score", "double")] if rmse else [])


def _parsed(i: int, kind: str, time_pattern: str | None) -> str:
    part = f"get(__parts, {i})"
    if kind.startswith("timestamp") and time_pattern:
        return f"CAST(try_to_timestamp({part}, '{time_pattern}') AS {kind})"
    return f"try_cast({part} AS {kind})"


def _usable(name: str, kind: str) -> str:
    return finite(name) if kind in ("double", "float") else f"{quote(name)} IS NOT NULL"


def decode(
    df: DataFrame,
    fields: Sequence[Field],
    value: str = "value",
    keep: Sequence[str] = (),
    time_pattern: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split messages into ``(good, rejected)`` rows.

    ``good`` has the ``keep`` columns and the typed fields. A message with a
    missing, unreadable or non-finite field goes to ``rejected`` with its text
    and the name of the first such field; nothing raises. Fields past the last
    one are ignored. Without ``time_pattern`` times are read by a lenient cast,
    with it only by that pattern.
    """
    text = f"CAST({quote(value)} AS STRING)"
    split = df.selectExpr(
        *cols(keep), f"{text} AS __text", f"split(translate({text}, '\"', ''), ',') AS __parts"
    )
    # A one-row generator and not a projection: filters are not pushed through
    # it, which would read every message again for each field they look at.
    row = {name: _parsed(i, kind, time_pattern) for i, (name, kind) in enumerate(fields)}
    parsed = stacked(split, [*keep, "__text"], [row])
    usable = {name: _usable(name, kind) for name, kind in fields}
    good = parsed.filter(" AND ".join(usable.values())).drop("__text")
    cases = " ".join(f"WHEN NOT ({ok}) THEN '{name}'" for name, ok in usable.items())
    rejected = parsed.selectExpr(
        *cols(keep), "__text AS value", f"CASE {cases} END AS bad_field"
    ).filter("bad_field IS NOT NULL")
    return good, rejected


def _text(name: str, dtype: T.DataType, digits: int | None) -> str:
    c = quote(name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({c}, '{TIME_TEXT}')"
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and digits is not None:
        fixed = f"try_cast(round({c}, {digits}) AS DECIMAL(38, {digits}))"
        return f"coalesce(CAST({fixed} AS STRING), CAST({c} AS STRING))"
    return f"CAST({c} AS STRING)"


def encode(
    df: DataFrame,
    fields: Sequence[str],
    keep: Sequence[str] = (),
    quoted: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """One text ``value`` per row from ``fields``; a null field makes it null.

    ``digits`` writes doubles with that many decimals, otherwise as Spark's
    shortest text, which decodes to the same double. ``quoted`` makes the value
    a JSON string.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    value = f"concat({", ',', ".join(_text(f, types[f], digits) for f in fields)})"
    rows = df.selectExpr(*cols(keep), f"{value} AS value")
    if not quoted:
        return rows
    # The JSON escapes of a backslash and of a quote.
    escaped = F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return rows.withColumn("value", F.concat(F.lit('"'), escaped, F.lit('"')))
