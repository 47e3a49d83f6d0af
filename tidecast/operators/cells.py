"""Splitting hot series into ordered cells.

A window over one series runs in one task, so a series that holds a third of
all rows would hold up the whole job. Here such a series is cut along its own
sort order into cells of at most about ``max_rows`` rows:

1. Count rows per series (map-side combined). Only series above ``max_rows``
   go on; there can be at most N / max_rows of them.
2. For each hot series take min and max of its sort keys and cut the range of
   the first key that varies into equal steps. Count the cells, and cut those
   that are still too large again, inside their own range. Rows that tie on
   one key are cut by the next one. Times, dates and integers are such keys.
3. What is still too large, since its next key is a text, a decimal or a double or
   its rows tie on all keys, is cut by value: at quantiles of whole positions, the struct
   of all order columns and a hash of the row, which breaks ties (only rows equal in
   every column stay together). The quantiles are those of a uniform share of the
   positions, taken by hash, so the share of a union is the union of shares, a recomputed
   task takes the same, and a cell has about half of ``max_rows``. Rows find their cell by
   binary search. The hash (``__tie``) then is the last order column of the cells.

A cell is named by its step numbers (``__cell_0``, ``__cell_1``, ...), which
sort like the rows themselves; rows of other series have nulls there. The cut
tables are written to the shared folder, so a recomputed task cuts the same
way, and are broadcast only when their counted size is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.columns import aggregate, cols, null_safe_join, window
from tidecast.functions.names import quote
from tidecast.sources.scratch import written

MAX_ROWS = 8_000_000
_FIXED_ZONES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00"}
BROADCAST_ROWS = 200_000
#: Positions of the share that make a cell; its size varies by about one over the root of it.
SHARE = 256
TIE = "__tie"


def _integer_key(name: str, dtype: T.DataType, zone: str) -> str | None:
    """SQL: an integer that sorts like the column, or None if there is none."""
    c = quote(name)
    if isinstance(dtype, T.TimestampNTZType):
        if zone not in _FIXED_ZONES:
            # Field by field: a cast to timestamp does not keep the order where
            # the session zone changes its clocks.
            minutes = f"(unix_date(DATE({c})) * 1440L + hour({c}) * 60 + minute({c}))"
            return f"({minutes} * 60000000 + bigint(extract(SECOND FROM {c}) * 1000000))"
        return f"unix_micros(CAST({c} AS TIMESTAMP))"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({c})"
    if isinstance(dtype, T.DateType):
        return f"bigint(unix_date({c}))"
    if isinstance(dtype, T.IntegralType):
        return f"bigint({c})"
    return None


def _sort_keys(df: DataFrame, order: Sequence[str]) -> list[str]:
    """SQL of integer keys, in sort order, for the leading columns that have one.

    Each column gives two, its upper 62 bits and its lower 2, so that the
    difference of two keys is always a bigint. A null sorts below all of them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    keys: list[str] = []
    for name in order:
        key = _integer_key(name, types[name], zone)
        if key is None:
            break
        keys += [f"coalesce({key} >> 2, {-(2**61) - 1}L)", f"coalesce({key} & 3L, 0L)"]
    return keys


def _stats(rows: DataFrame, group: Sequence[str], n_keys: int) -> DataFrame:
    values = {"__n": "count(1)"}
    values |= {f"__lo{i}": f"min(__k{i})" for i in range(n_keys)}
    values |= {f"__hi{i}": f"max(__k{i})" for i in range(n_keys)}
    return aggregate(rows, group, values)


def _first_varying(n_keys: int, value: str) -> str:
    """SQL: ``value`` of the first sort key that is not constant in the cell."""
    if not n_keys:
        return "bigint(NULL)"
    cases = [f"WHEN __hi{i} > __lo{i} THEN {value.format(i)}" for i in range(n_keys)]
    return f"CASE {' '.join(cases)} END"


def _cuts(stats: DataFrame, group: Sequence[str], n_keys: int, max_rows: int) -> DataFrame:
    """Start and step for each group above ``max_rows``; nulls where no key varies."""
    lo, hi = _first_varying(n_keys, "__lo{}"), _first_varying(n_keys, "__hi{}")
    pieces = f"bigint(ceil(__n * 2 / {max_rows}))"
    return (
        stats.filter(f"__n > {max_rows}")
        .selectExpr(
            *cols(group),
            f"{_first_varying(n_keys, '{}')} AS __key",
            f"{lo} AS __start",
            f"({hi} - {lo}) div {pieces} + 1 AS __step",
        )
    )


def _numbered(rows, cuts, group, n_keys, how, name):
    """``rows`` with the number of each row's step, null outside the cut groups."""
    key = f"CASE __key {' '.join(f'WHEN {i} THEN __k{i}' for i in range(n_keys))} END"
    number = F.expr(f"({key} - __start) div __step")
    joined = null_safe_join(rows, cuts, group, how)
    return joined.withColumn(name, number).drop("__key", "__start", "__step")


def split_hot(
    df: DataFrame, by: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS
) -> tuple[DataFrame, list[str]]:
    """``df`` with cell columns, and their names; no names if no series is hot. With ``TIE`` among
    its columns some were cut by value, and that is then the last order column.

    ``by`` must name at least one column. Runs one counting job, and a few more
    over the hot series alone if there are any.
    """
    keys = _sort_keys(df, order)
    hot = aggregate(df, by, {"__n": "count(1)"}).filter(f"__n > {max_rows}").select(*cols(by))
    if hot.isEmpty():
        return df, []
    hot = written(hot, "hot-series")
    n_hot = hot.count()
    names = [f"__k{i}" for i in range(len(keys))]
    narrow = df.selectExpr(*cols(by), *[f"{k} AS {n}" for k, n in zip(keys, names)])
    rows = null_safe_join(narrow, sized(hot, n_hot), by, "left_semi")
    out = df.selectExpr("*", *[f"{k} AS {n}" for k, n in zip(keys, names)])
    cells: list[str] = []
    stuck: list[DataFrame] = []
    while True:
        group = [*by, *cells]
        found = written(_cuts(_stats(rows, group, len(keys)), group, len(keys), max_rows), "cell-cuts")
        n_large, n_cuts = found.agg(F.count("*"), F.count("__key")).first()
        if n_large > n_cuts:
            stuck.append(found.filter("__key IS NULL").select(*cols(group)))
        if n_cuts == 0:
            break
        name = f"__cell_{len(cells)}"
        cuts = sized(found.filter("__key IS NOT NULL"), n_cuts)
        rows = _numbered(rows, cuts, group, len(keys), "inner", name)
        out = _numbered(out, cuts, group, len(keys), "left", name)
        cells.append(name)
    out = out.drop(*names)
    if not stuck:
        return out, cells
    # A group that was stuck in an earlier round has nulls for the cells of later ones.
    missing = [F.lit(None).cast("bigint").alias(c) for c in cells]
    large = reduce(lambda a, b: a.unionByName(b), [t.select("*", *missing[len(t.columns) - len(by) :]) for t in stuck])
    return _by_value(out, group, order, written(large, "large-cells"), max_rows, cells)


def _hashed(df: DataFrame) -> str:
    """SQL: a hash of the row, without the columns that Spark does not hash."""
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return f"xxhash64({', '.join(cols(plain))})"


def _by_value(
    df: DataFrame, group: Sequence[str], order: Sequence[str], large: DataFrame, max_rows: int, cells: list[str]
) -> tuple[DataFrame, list[str]]:
    """``df`` with one more cell column for the ``large`` groups, cut by the positions of their rows."""
    position = f"struct({', '.join(cols([*order, TIE]))})"
    tied = df.withColumn(TIE, F.expr(_hashed(df)))
    # A cell of max_rows / 2 rows is to have SHARE positions in the share, on average.
    share = f"pmod(xxhash64({TIE}, 1), {max_rows}L) < {2 * SHARE}"
    taken = null_safe_join(tied, sized(large, large.count()), group, "left_semi").filter(share)
    over = window(group, [*order, TIE])
    every = min(SHARE, max(max_rows // 2, 1))
    ends = taken.selectExpr(*cols(group), f"{position} AS __pos", f"row_number() {over} AS __at").filter(f"__at % {every} = 0")
    cuts = written(ends.groupBy(*cols(group)).agg(F.expr("array_sort(collect_list(__pos)) AS __ends")), "value-cuts")
    total = cuts.agg(F.sum(F.size("__ends"))).first()[0]
    if not total:
        return df, cells
    name = f"__cell_{len(cells)}"
    middle = "shiftright(s.lo + s.hi, 1)"
    # The number of ends at or below the position.
    found = f"""CASE WHEN __ends IS NOT NULL THEN aggregate(
        sequence(0, int(log2(size(__ends)))), named_struct('lo', 0, 'hi', size(__ends)),
        (s, _) -> CASE WHEN s.lo >= s.hi THEN s
            WHEN __ends[{middle}] <= {position} THEN named_struct('lo', {middle} + 1, 'hi', s.hi)
            ELSE named_struct('lo', s.lo, 'hi', {middle}) END,
        s -> bigint(s.lo)) END"""
    joined = null_safe_join(tied, sized(cuts, total), group, "left")
    return joined.withColumn(name, F.expr(found)).drop("__ends"), [*cells, name]


def in_cell(cells: Sequence[str]) -> str:
    """SQL: the row's series is cut. Of some series only a later cell column is set."""
    return f"coalesce({', '.join(cols(cells))}) IS NOT NULL"


def sized(table: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a counted table if it is small; otherwise leave it to AQE."""
    return F.broadcast(table) if n_rows <= BROADCAST_ROWS else table


def preceding_rows(
    df: DataFrame,
    columns: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str],
    cells: Sequence[str],
) -> DataFrame:
    """For each cell of a hot series, copies of the p rows before it.

    The last p rows of each cell come from a ``row_number() <= p`` filter, which
    Spark limits on the map side. The rest works on those few rows only: a cell
    takes them from as many earlier cells as it needs.
    """
    group = cols([*by, *cells])
    kept = cols([*order, *[c for c in columns if c not in order]])
    back = window([*by, *cells], order, descending=True)
    tails = (
        df.filter(in_cell(cells))
        .selectExpr(*group, *kept, f"row_number() {back} AS __back")
        .filter(f"__back <= {p}")
        .groupBy(*group)
        .agg(F.expr(f"sort_array(collect_list(struct(__back, {', '.join(kept)}))) AS __tail"))
    )
    earlier = window(by, cells)
    tails_before = ", ".join(f"lag(__tail, {j}) {earlier}" for j in range(1, p + 1))
    return (
        tails.selectExpr(*group, f"array({tails_before}) AS __tails")
        .selectExpr(
            *group,
            f"inline(slice(flatten(filter(__tails, t -> t IS NOT NULL)), 1, {p}))",
        )
        .drop("__back")
    )
