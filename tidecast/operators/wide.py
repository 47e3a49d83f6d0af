"""Vector autoregression with many features: blocked cross-products as rows.

``fit`` has a column for every pair of features, so its plan grows with their square. Here a row is one
vector, all lags and targets in an array, and what is summed are rows of a matrix:

1. Each task gathers, for every group it meets, the count, the means and the centred cross-products of its
   vectors, a block of rows at a time by one matrix product, and emits a row for each line i of the matrix.
   It holds at most ``HELD`` numbers before it emits what it has.
2. Lines of the same group and i are merged. Lines are keyed by i too, so a group that all tasks have
   rows of still merges in as many tasks as there are features, each with one line from each task.
3. The d + k lines of a group, a square of bounded size, are reduced to its coefficients.

The plan has the same size for any number of features. What comes out is the coefficient table of
``fit.fit_var``, with the same marks for lags that are constant or depend on others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidecast.functions.columns import cols
from tidecast.functions.names import lag_names, quote
from tidecast.operators.fit import TOLERANCE, terms

#: Numbers of unfinished matrices that a task holds.
HELD = 8_000_000
#: Rows of a block: their centred copy is what a product needs beside the matrix.
BLOCK = 4096

Moments = tuple[int, np.ndarray, np.ndarray]


def block_moments(x: np.ndarray) -> Moments:
    """Count, means and centred cross-products of the rows of ``x``."""
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of both parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] / n * b[0])


def reduced(square: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Solutions (d x targets) and which lags took part, from centred cross-products, lags first.

    A lag of which all but ``TOLERANCE`` is explained by the lags before it, or that never varies, is
    left out: its coefficient is 0. As in ``fit``, no rows are exchanged.
    """
    m, own = square[:d].copy(), square.diagonal()[:d].copy()
    used = np.zeros(d, bool)
    for s in range(d):
        used[s] = own[s] > 0 and m[s, s] > TOLERANCE * own[s]
        if not used[s]:
            m[s] = 0
            continue
        top = m[s] / m[s, s]
        m -= np.outer(m[:, s], top)
        m[s] = top
    return m[:, d:], used


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(keys: Sequence[tuple], values: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of key tuples and the other columns, in the types of ``schema``."""
    n = len(schema) - len(values)
    lists = [[k[i] for k in keys] for i in range(n)]
    columns = [pa.array(v, f.type) for v, f in zip(lists, schema)]
    return pa.RecordBatch.from_arrays(columns + [pa.array(values[f.name], f.type) for f in list(schema)[n:]], schema=schema)


def moment_lines(lagged: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()) -> DataFrame:
    """``by, line, n, mean, products``: for each task and group a row for each line of its matrix."""
    names = [*lag_names(targets, p), *targets]
    width = len(names)
    vector = f"array({', '.join(f'double({quote(n)})' for n in names)})"
    usable = "forall(__v, x -> coalesce(abs(x) < double('Infinity'), false))"
    rows = lagged.selectExpr(*cols(by), f"{vector} AS __v").filter(usable)
    doubles = T.ArrayType(T.DoubleType(), False)
    schema = T.StructType(
        [*(lagged.schema[b] for b in by)]
        + [T.StructField("line", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField("mean", doubles), T.StructField("products", doubles)]
    )
    arrow, most = to_arrow_schema(schema), max(HELD // (width * width), 1)

    def lines(held: dict[tuple, Moments]) -> Iterator[pa.RecordBatch]:
        for key, (n, mean, products) in held.items():
            yield _rows(
                [key] * width,
                {"line": range(width), "n": [n] * width, "mean": [mean] * width, "products": list(products)},
                arrow,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            x = _vectors(batch.column("__v"), width)
            places: dict[tuple, list[int]] = {}
            if by:
                for i, key in enumerate(zip(*(batch.column(b).to_pylist() for b in by))):
                    places.setdefault(key, []).append(i)
            for key, own in places.items() if by else [((), None)]:
                mine = x if own is None else x[own]
                for start in range(0, len(mine), BLOCK):
                    part = block_moments(mine[start : start + BLOCK])
                    held[key] = merged(held[key], part) if key in held else part
                if len(held) >= most:
                    yield from lines(held)
                    held = {}
        yield from lines(held)

    return rows.mapInArrow(run, schema)


def merged_lines(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each group and line, from those of all tasks."""
    schema = lines.schema
    arrow = to_arrow_schema(schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy().astype(float)
        column = lambda name: table[name].combine_chunks()
        means = _vectors(column("mean"), len(column("mean")[0]))
        total = n.sum()
        mean = n @ means / total
        apart = means - mean
        line = key[-1].as_py()
        products = _vectors(column("products"), means.shape[1]).sum(axis=0) + (n * apart[:, line]) @ apart
        one = {"line": [line], "n": [int(total)], "mean": [mean], "products": [products]}
        return pa.Table.from_batches([_rows([tuple(k.as_py() for k in key[:-1])], one, arrow)])

    return lines.groupBy(*cols(by), "line").applyInArrow(merge, schema)


def fit_var_wide(lagged: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()) -> DataFrame:
    """The coefficient table of ``fit_var`` (by, target, term, lag, coef, n_obs, status).

    Rows with a lag or target that is null or not finite take no part. A group with fewer rows than
    unknowns has null coefficients and the status ``short``; one without usable rows has no rows here
    (an empty table gives an empty one). Null keys are a group. Each group costs the square of the
    features in each task that has rows of it, so for very many groups with few features take ``fit_var``.
    """
    targets, by = list(targets), list(by)
    d, k, order = len(targets) * p, len(targets), terms(targets, p)
    lines = merged_lines(moment_lines(lagged, targets, p, by), by)
    schema = T.StructType(
        [*(lagged.schema[b] for b in by)]
        + [T.StructField("target", T.StringType()), T.StructField("term", T.StringType())]
        + [T.StructField("lag", T.IntegerType()), T.StructField("coef", T.DoubleType())]
        + [T.StructField("n_obs", T.LongType()), T.StructField("status", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("line")
        square = _vectors(table["products"].combine_chunks(), d + k)
        n, mean = table["n"][0].as_py(), np.array(table["mean"][0].as_py())
        short = n < d + 1
        x, used = reduced(square, d)
        varies = square.diagonal()[:d] > 0
        aliased = varies & ~used
        whole = "short" if short else "ok" if varies.all() or aliased.any() else "constant"
        statuses = [whole, *("aliased" if a and not short else whole for a in aliased)]
        coef = np.vstack([mean[d:] - mean[:d] @ x, x])
        values = {
            "target": [t for t in targets for _ in order],
            "term": [term for _ in targets for term, _ in order],
            "lag": [lag for _ in targets for _, lag in order],
            "coef": [None] * coef.size if short else coef.T.ravel(),
            "n_obs": [n] * coef.size,
            "status": statuses * k,
        }
        return pa.Table.from_batches([_rows([tuple(v.as_py() for v in key[: len(by)])] * coef.size, values, arrow)])

    if by:
        return lines.groupBy(*cols(by)).applyInArrow(solve, schema)
    return lines.groupBy().applyInArrow(solve, schema)
