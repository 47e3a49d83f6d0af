"""Compare a query with its SQL, both over the same parquet tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def _rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return list(frame.columns), sorted(rows, key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    names = {"M": "time", "f": "float", "i": "int", "O": "text", "b": "bool"}
    return {c: names.get(t.kind, t.kind) for c, t in frame.dtypes.items()}


def differences(actual: pd.DataFrame, expected: pd.DataFrame) -> list[str]:
    """What differs, exactly: names, kinds of types, number of rows, values."""
    a_names, a_rows = _rows(actual)
    e_names, e_rows = _rows(expected)
    if a_names != e_names:
        return [f"columns {a_names} != {e_names}"]
    if len(a_rows) != len(e_rows):
        return [f"{len(a_rows)} rows != {len(e_rows)}"]
    bad = [f"{a} != {e}" for a, e in zip(a_rows, e_rows) if a != e]
    if bad:
        return [f"{len(bad)} rows differ", *bad[:3]]
    return []
