"""Lags that run on across micro-batches, with the last rows of each series as state.

Series are dealt into shards by a hash of their key. A shard is one group of Spark's, with one state, and
its series are worked on together, so what a call of Python costs is paid for each shard and not for each series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidecast.functions.columns import col, cols
from tidecast.functions.names import lag_names

_TIMES = (T.TimestampType, T.TimestampNTZType)
# A watermark needs a timestamp with zone.
_EVENT = "__event"
_ONE = "__all"
_SHARD = "__shard"
#: Rows that go back to Spark at once.
PIECE = 10_000
#: Shards, unless the caller says how many.
SHARDS = 512


def _millis(duration: str) -> int:
    """A duration such as ``2 hours`` in milliseconds."""
    return int(pd.Timedelta(duration) / pd.Timedelta(milliseconds=1))


def stream_lags(
    observations: DataFrame,
    targets: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str],
    delay: str | None = None,
    grace: str = "1 day",
    idle: str | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """``lag_features`` on a stream: columns by, order, targets, lags and ``late``.

    Over all micro-batches the rows that are not late equal the batch result.
    Rows of a micro-batch may come in any order. A row that sorts before the
    series' last row that has come out comes out with ``late`` set and without lags, to be
    sent to a reject table. Order columns must be times or integers, not null.

    With ``delay`` (such as ``2 hours``) the first order column is a time, and a row waits in the state
    until one that is ``delay`` later has been seen in any series, so rows may also come in another
    order than that of time by up to ``delay``. Rows that come up to ``grace`` after that are late; those beyond
    are dropped by Spark and counted in the query's progress (``numRowsDroppedByWatermark``). The
    last ``delay`` of a stream that ends stays in the state until something later comes.
    With ``idle`` a series that has been quiet for so long in event time is forgotten; its next row starts anew.

    The state is p rows per series, and with ``delay`` those that wait. A task holds the order columns and
    targets of one shard's rows of one micro-batch at a time, whose size the source's rate limit bounds, and the
    shard's state, which is written again whenever one of its series has rows: give more ``shards`` for many
    millions of series. A checkpoint goes on with the number it began with only.
    """
    if not by:
        one = observations.withColumn(_ONE, F.lit(0))
        return stream_lags(one, targets, p, order, [_ONE], delay, grace, idle, shards).drop(_ONE)
    k = len(targets)
    kept = list(dict.fromkeys([*by, *order, *targets]))
    types = {f.name: f.dataType for f in observations.schema.fields}
    for c in order:
        if not isinstance(types[c], (*_TIMES, T.IntegralType)):
            raise ValueError(f"order column {c} must be a time or an integer")
    if (delay or idle) and not isinstance(types[order[0]], _TIMES):
        raise ValueError("with a delay the first order column must be a time")
    timed = delay is not None or idle is not None
    lags = lag_names(targets, p)
    # Keys travel as text, so that no null turns an integer into a float; null stays null.
    named = [c for c in kept if c not in order and c not in targets]
    texts = [f"{_SHARD}_{i}" for i in range(len(by))]

    def as_text(c: str) -> Column:
        return F.base64(col(c)) if isinstance(types[c], T.BinaryType) else col(c).cast("string")

    def from_text(c: str) -> Column:
        text = F.unbase64(col(c)) if isinstance(types[c], T.BinaryType) else col(c).cast(types[c])
        return text.alias(c)

    out = T.StructType(
        [T.StructField(c, T.DoubleType() if c in targets else T.StringType() if c in named else types[c]) for c in kept]
        + [T.StructField(c, T.DoubleType()) for c in lags]
        + [T.StructField("late", T.BooleanType())]
    )
    state_schema = T.StructType(
        [T.StructField(c, T.ArrayType(T.StringType())) for c in texts]
        + [
            T.StructField("begun", T.ArrayType(T.BooleanType())),
            T.StructField("position", T.ArrayType(T.LongType())),
            T.StructField("n_tail", T.ArrayType(T.LongType())),
            T.StructField("tail", T.ArrayType(T.DoubleType())),
            T.StructField("n_waiting", T.ArrayType(T.LongType())),
            T.StructField("waiting", T.ArrayType(T.LongType())),
            T.StructField("values", T.ArrayType(T.DoubleType())),
        ]
    )
    shard = F.pmod(F.xxhash64(*(as_text(c) for c in by)), F.lit(shards)).cast("int")
    rows = observations.select(
        *cols(dict.fromkeys([*order, *targets])), shard.alias(_SHARD), *(as_text(c).alias(t) for c, t in zip(by, texts))
    )
    wait = allowed = quiet = 0
    if timed:
        wait, allowed = (_millis(x) for x in (delay or "0 seconds", grace))
        quiet = _millis(idle) if idle else 0
        rows = rows.withColumn(_EVENT, col(order[0]).cast("timestamp")).withWatermark(_EVENT, f"{wait + allowed} milliseconds")
    piece = PIECE

    # All nested, so that what is sent to the workers needs no import from here.
    def as_positions(pdf: pd.DataFrame) -> np.ndarray:
        """The order columns as an integer matrix; times in microseconds."""
        columns = []
        for c in order:
            values = pdf[c].to_numpy()
            if np.issubdtype(values.dtype, np.datetime64):
                values = values.astype("datetime64[us]")
            columns.append(values.astype("int64"))
        return np.stack(columns, axis=1)

    def sorts_after(positions: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows that sort after the position beside them."""
        later = np.zeros(len(positions), dtype=bool)
        tied = ~later
        for i in range(len(order)):
            later |= tied & (positions[:, i] > last[:, i])
            tied &= positions[:, i] == last[:, i]
        return later

    def frames(keys: list, series, positions, values, lagged, late: bool) -> Iterator[pd.DataFrame]:
        for a in range(0, len(positions), piece):
            b = min(a + piece, len(positions))
            columns = {c: k[series[a:b]] for c, k in zip(by, keys)}
            for i, c in enumerate(order):
                if isinstance(types[c], _TIMES):
                    columns[c] = positions[a:b, i].astype("datetime64[us]")
                    if isinstance(types[c], T.TimestampType):
                        columns[c] = pd.DatetimeIndex(columns[c]).tz_localize("UTC")
                else:
                    columns[c] = positions[a:b, i]
            columns |= {t: values[a:b, j] for j, t in enumerate(targets)}
            for m, name in enumerate(lags):
                columns[name] = np.full(b - a, np.nan) if lagged is None else lagged[a:b, m]
            columns["late"] = np.full(b - a, late)
            yield pd.DataFrame({c: columns[c] for c in [*kept, *lags, "late"]})

    def numbered(keys: list) -> np.ndarray:
        """For each row the number of its series, by first appearance."""
        number = np.zeros(len(keys[0]), "int64")
        for k in keys:
            codes, found = pd.factorize(k, use_na_sentinel=False)
            number = pd.factorize(number * max(1, len(found)) + codes)[0]
        return number

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [[] for _ in state_schema]
        held_keys, (begun, last, n_tail, tail, n_waiting, waiting, kept_values) = held[: len(by)], held[len(by) :]
        n_held, o = len(begun), len(order)
        keys = [[np.array(k, dtype=object)] for k in held_keys]
        new_positions, new_values = [np.zeros((0, o), "int64")], [np.zeros((0, k))]
        for pdf in batches:
            if len(pdf):
                for i, c in enumerate(texts):
                    keys[i].append(pdf[c].to_numpy(dtype=object))
                new_positions.append(as_positions(pdf))
                new_values.append(np.stack([pdf[t].to_numpy().astype("float64") for t in targets], axis=1))
        positions, values = np.concatenate(new_positions), np.concatenate(new_values)
        keys = [np.concatenate(k) for k in keys]
        # The series of the state come first, in their order, then new ones.
        number = numbered(keys)
        n_series = int(number.max()) + 1 if len(number) else 0
        first = np.unique(number, return_index=True)[1]
        keys, series = [k[first] for k in keys], number[n_held:]

        def of_all(known, width=()) -> np.ndarray:
            grown = np.zeros((n_series, *width), "int64")
            grown[:n_held] = np.array(known, "int64").reshape(-1, *width)
            return grown

        begun, last, n_tail, n_waiting = of_all(begun).astype(bool), of_all(last, (o,)), of_all(n_tail), of_all(n_waiting)
        came = np.bincount(series, minlength=n_series) > 0
        behind = begun[series] & ~sorts_after(positions, last[series])
        yield from frames(keys, series[behind], positions[behind], values[behind], None, True)
        every = np.arange(n_series)
        series = np.concatenate([np.repeat(every, n_waiting), series[~behind]])
        positions = np.concatenate([np.array(waiting, "int64").reshape(-1, o), positions[~behind]])
        values = np.concatenate([np.array(kept_values, "float64").reshape(-1, k), values[~behind]])
        ranked = np.lexsort((*positions.T[::-1], series))
        series, positions, values = series[ranked], positions[ranked], values[ranked]
        out_now = np.ones(len(series), bool)
        if timed:
            # The latest time seen less the delay; everything up to it has come, or will be late.
            seen = state.getCurrentWatermarkMs() + allowed
            if delay is not None:
                out_now = positions[:, 0] <= seen * 1000
        # Of each series the tail and then what comes out now. The lag i of a row is i rows before it. Rows
        # with fewer than p rows before them are warm-up rows, and are dropped.
        owner = np.concatenate([np.repeat(every, n_tail), series[out_now]])
        n_old = len(owner) - int(out_now.sum())
        by_series = np.argsort(owner, kind="stable")
        owner, known = owner[by_series], np.concatenate([np.array(tail, "float64").reshape(-1, k), values[out_now]])[by_series]
        count = np.bincount(owner, minlength=n_series)
        rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        at = np.flatnonzero((by_series >= n_old) & (rank >= p))
        source = by_series[at] - n_old
        lagged = np.empty((len(at), len(lags)))
        for m in range(len(lags)):
            i, j = 1 + m // k, m % k
            lagged[:, m] = known[at - i, j]
        yield from frames(keys, owner[at], positions[out_now][source], known[at], lagged, False)
        if out_now.any():
            own = series[out_now]
            ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            last[own[ends]], begun[own[ends]] = positions[out_now][ends], True
        tails = rank >= count[owner] - p
        series, positions, values = series[~out_now], positions[~out_now], values[~out_now]
        n_waiting = np.bincount(series, minlength=n_series)
        keep = begun | (n_waiting > 0)
        due = []
        if timed:
            due += [int(positions[:, 0].min()) // 1000] if len(positions) else []
            if quiet:
                latest = np.where(begun, last[:, 0], 0)
                np.maximum.at(latest, series, positions[:, 0])
                until = latest // 1000 + quiet
                keep &= came | (n_waiting > 0) | (until >= seen)
                due += [int(until[keep].min())] if keep.any() else []
        if not keep.any():
            if state.exists:
                state.remove()
            return
        tails &= keep[owner]
        n_tail = np.bincount(owner[tails], minlength=n_series)
        columns = (begun[keep], last[keep].ravel(), n_tail[keep], known[tails].ravel(), n_waiting[keep], positions.ravel(), values.ravel())
        state.update((*(x[keep].tolist() for x in keys), *(x.tolist() for x in columns)))
        if due:
            # Timeouts come when the watermark is past them, and must be past it when set.
            state.setTimeoutTimestamp(max(min(due) - allowed, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    lagged = rows.groupBy(_SHARD).applyInPandasWithState(advance, out, state_schema, "append", timeout)
    return lagged.select(*(from_text(c) if c in named else col(c) for c in lagged.columns))
