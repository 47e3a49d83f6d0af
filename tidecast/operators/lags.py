"""Lag features, warm-up rows and row numbers along ordered series.

A lag counts rows, not time: gaps in time are not filled. Every operator takes
``order``, the columns that order a series; give a total order (time, then a
tie-break), or rows that tie are ordered arbitrarily.

Series are kept apart by ``by``. With none, all rows are one series. Series of
more than ``max_rows`` rows are cut into cells (see ``cells``), so no task sorts
more than about that many rows. ``max_rows=None`` skips the counting job; use
it where the caller knows that every series is short, as for one row per hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.columns import aggregate, col, cols, null_safe_join, window
from tidecast.functions.names import lag_name, quote
from tidecast.operators.cells import MAX_ROWS, TIE, in_cell, preceding_rows, sized, split_hot
from tidecast.sources.scratch import written

_ONE = "__all"


def _in_cells(df, by, order, max_rows):
    """``(df, by, cells, order)``; with no ``by`` and no cells ``by`` stays empty."""
    order = list(order)
    if max_rows is None:
        return df, list(by), [], order
    if by:
        out, cells = split_hot(df, by, order, max_rows)
        keys = list(by)
    elif df.count() <= max_rows:
        return df, [], [], order
    else:
        out, cells = split_hot(df.withColumn(_ONE, F.lit(0)), [_ONE], order, max_rows)
        if not cells:
            return df, [], [], order
        keys = [_ONE]
    return out, keys, cells, [*order, TIE] if TIE in out.columns else order


def lag_features(
    df: DataFrame,
    targets: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    keep_warmup: bool = False,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Append ``<target>_l<i>`` for i = 1..p, lag-major.

    The first p rows of a series, which lack some lag, are dropped;
    ``keep_warmup`` keeps them, with 0 for the lags they lack.
    """
    rows, keys, cells, order = _in_cells(df, by, order, max_rows)
    if cells:
        before = preceding_rows(rows, targets, p, order, keys, cells)
        rows = rows.withColumn("__copy", F.lit(False)).unionByName(
            before.withColumn("__copy", F.lit(True)), allowMissingColumns=True
        )
    over = window([*keys, *cells], order)
    lagged = rows.selectExpr(
        "*",
        *[
            f"lag({quote(t)}, {i}, 0) {over} AS {quote(lag_name(t, i))}"
            for i in range(1, p + 1)
            for t in targets
        ],
        f"lag(1, {p}, 0) {over} AS __full",
    )
    if cells:
        lagged = lagged.filter("NOT __copy").drop("__copy", *cells, TIE)
    if not keep_warmup:
        lagged = lagged.filter("__full = 1")
    return lagged.drop("__full", _ONE)


def row_index(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rid",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Append the position of each row in its series, counting from 0."""
    rows, keys, cells, order = _in_cells(df, by, order, max_rows)
    group = [*keys, *cells]
    numbered = rows.withColumn(name, F.expr(f"bigint(row_number() {window(group, order)} - 1)"))
    if not cells:
        return numbered
    # Rows ahead of each cell, by a running sum over the cell counts. Cells of
    # series that are not hot have null names and start at 0.
    counts = aggregate(
        rows.filter(in_cell(cells)), group, {"__n": "count(1)"}
    )
    ahead = f"sum(__n) {window(keys, cells)} - __n AS __start"
    starts = written(counts.selectExpr(*cols(group), ahead), "cell-starts")
    return (
        null_safe_join(numbered, sized(starts, starts.count()), group, "left")
        .withColumn(name, col(name) + F.coalesce("__start", F.lit(0)))
        .drop("__start", _ONE, *cells, TIE)
    )


def drop_warmup(
    df: DataFrame,
    p: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Rows from position p on, with ``rid`` and the ``const`` regressor.

    ``const`` is a constant 1 lagged by p: it would be 0 on the dropped rows.
    """
    indexed = row_index(df, order, by, max_rows=max_rows)
    const = (col("rid") >= p).cast("int").alias("const")
    return indexed.select("*", const).filter(col("rid") >= p)


def continue_lags(
    batch: DataFrame,
    tail: DataFrame,
    targets: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    max_rows: int | None = MAX_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lags of a micro-batch that go on from the rows before it.

    ``tail`` holds the last p rows of each series so far (by, order and target
    columns). Returns the lagged batch, the late rows, which sort before the end
    of the tail and so have no place in it, and the new tail.
    """
    kept = list(dict.fromkeys([*by, *order, *targets]))
    position = f"struct({', '.join(cols(order))})"
    newest = aggregate(tail, by, {"__newest": f"max({position})"})
    placed = null_safe_join(batch, newest, by, "left") if by else batch.crossJoin(newest)
    is_late = f"coalesce({position} <= __newest, false)"
    late = placed.filter(is_late).drop("__newest")
    both = (
        placed.filter(f"NOT {is_late}")
        .drop("__newest")
        .withColumn("__old", F.lit(False))
        .unionByName(
            tail.select(*cols(kept)).withColumn("__old", F.lit(True)), allowMissingColumns=True
        )
    )
    lagged = lag_features(both, targets, p, order, by, max_rows=max_rows)
    new_tail = last_rows(both.select(*cols(kept)), p, order, by)
    return lagged.filter("NOT __old").drop("__old"), late, new_tail


def last_rows(df: DataFrame, p: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last p rows of each series."""
    if not by:
        return df.orderBy(*[col(o).desc() for o in order]).limit(p)
    back = f"row_number() {window(by, order, descending=True)}"
    return df.withColumn("__back", F.expr(back)).filter(f"__back <= {p}").drop("__back")
