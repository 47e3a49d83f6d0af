"""Lag features against a plain loop, whole and cut into cells."""

import datetime as dt
import random

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tidecast.operators.cells import split_hot
from tidecast.operators.lags import (
    continue_lags,
    drop_warmup,
    lag_features,
    last_rows,
    row_index,
)

ORDER = ["ts", "id"]


def by_loop(rows, p, n_targets, key=None):
    """(ts, id, ...) tuples with their lags, by brute force per series."""
    out, groups = [], {}
    for row in rows:
        groups.setdefault(row[key] if key is not None else 0, []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: ((r[0] is not None, r[0] or dt.datetime.min), r[1]))
        for n, row in enumerate(group):
            if n >= p:
                lags = [group[n - i][2 + j] for i in range(1, p + 1) for j in range(n_targets)]
                out.append((*row, *lags))
    return out


@pytest.fixture(scope="module")
def skewed():
    """One series with most rows, ties of every length, null times and null keys."""
    rng = random.Random(3)
    start = dt.datetime(2024, 3, 30, 23, 50)
    rows = []
    for i in range(300):
        ts = start + dt.timedelta(seconds=rng.choice([0, 0, 0, 1, 2, 900, 86_400 * 40]))
        if rng.random() < 0.15:
            ts = None
        key = rng.choice(["hot"] * 8 + ["cold", None])
        value = None if rng.random() < 0.05 else round(rng.uniform(-5, 5), 3)
        rows.append((ts, i, value, float(i), key))
    return rows


SCHEMA = "ts timestamp_ntz, id bigint, y1 double, y2 double, k string"


@pytest.mark.parametrize("max_rows", [None, 60, 7])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_lags_equal_loop(spark, skewed, max_rows, by):
    df = spark.createDataFrame(skewed, SCHEMA)
    lagged = lag_features(df, ["y1", "y2"], 3, ORDER, by, max_rows=max_rows)
    got = {r["id"]: tuple(r) for r in lagged.collect()}
    expected = {r[1]: r for r in by_loop(skewed, 3, 2, 4 if by else None)}
    assert got == expected


@pytest.mark.parametrize("max_rows", [None, 30])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_row_index_equals_position(spark, skewed, max_rows, by):
    df = spark.createDataFrame(skewed, SCHEMA)
    got = {r["id"]: r["rid"] for r in row_index(df, ORDER, by, max_rows=max_rows).collect()}
    expected, seen = {}, {}
    for row in sorted(skewed, key=lambda r: ((r[0] is not None, r[0] or dt.datetime.min), r[1])):
        key = row[4] if by else 0
        expected[row[1]] = seen.get(key, 0)
        seen[key] = expected[row[1]] + 1
    assert got == expected


def test_cells_hold_few_rows(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA)
    cut, cells = split_hot(df, ["k"], ORDER, 20)
    sizes = cut.filter("k = 'hot'").groupBy(*cells).count()
    assert sizes.agg(F.max("count")).first()[0] <= 20
    assert cut.filter("k = 'cold'").select(*cells).distinct().count() >= 1


def test_no_cells_without_hot_series(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA)
    assert split_hot(df, ["k"], ORDER, 10_000)[1] == []


def test_whole_range_of_bigint_keys(spark):
    rows = [(v, float(i)) for i, v in enumerate([-(2**63), -5, 0, 5, 2**62, 2**63 - 1])]
    df = spark.createDataFrame(rows, "id bigint, y1 double")
    whole = lag_features(df, ["y1"], 1, ["id"], max_rows=None)
    assert same_rows(lag_features(df, ["y1"], 1, ["id"], max_rows=2), whole)


def test_zone_with_clock_change(spark):
    """Local times around a clock change keep their order when cut."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        start = dt.datetime(2024, 3, 31, 1, 0)
        rows = [(start + dt.timedelta(minutes=3 * i), i, float(i)) for i in range(60)]
        df = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint, y1 double")
        got = lag_features(df, ["y1"], 1, ["ts"], max_rows=7)
        assert got.filter("y1_l1 <> y1 - 1").isEmpty()
        assert got.count() == 59
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unsplittable_order_still_right(spark):
    rows = [(c, float(i)) for i, c in enumerate("abcdef")]
    df = spark.createDataFrame(rows, "name string, y1 double")
    got = lag_features(df, ["y1"], 1, ["name"], max_rows=2)
    assert {r["name"]: r["y1_l1"] for r in got.collect()} == dict(zip("bcdef", range(5)))


VALUE_ORDERS = [
    (["name"], "concat('n', lpad(string(id % 211), 3, '0'), repeat('x', id % 3), id)"),
    (["name", "id"], "if(id % 9 = 0, NULL, concat('é', id % 4))"),
    (["name", "id"], "CAST(id % 50 AS DECIMAL(20, 3)) / 7"),
    (["name", "id"], "CASE id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') WHEN 2 THEN -0.0D ELSE id / 3 END"),
    (["day", "name", "id"], "concat('s', id % 5)"),
]


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize(("order", "name"), VALUE_ORDERS)
def test_cuts_by_text_decimal_and_double(spark, by, order, name):
    df = spark.range(1500).selectExpr("id", "DATE '2024-01-01' AS day", f"{name} AS name", "double(id) AS y1", "if(id % 3 = 0, 'cold', NULL) AS k")
    whole = lag_features(df, ["y1"], 2, order, by, max_rows=None)
    assert same_rows(lag_features(df, ["y1"], 2, order, by, max_rows=40), whole)
    assert same_rows(row_index(df, order, by, max_rows=40), row_index(df, order, by, max_rows=None))
    cut, cells = split_hot(df, by or ["day"], order, 40)
    assert cut.count() == 1500
    assert cut.groupBy(*(by or ["day"]), *cells).count().agg(F.max("count")).first()[0] <= 40


def test_cells_by_value_from_a_share(spark):
    """With more rows than the share takes, cells stay below twice the limit, ties on all order columns too."""
    df = spark.range(60_000).selectExpr("id", "concat('t', id % 3) AS name", "1 AS k")
    cut, cells = split_hot(df, ["k"], ["name"], 4000)
    sizes = [r["count"] for r in cut.groupBy(*cells).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 8000 and len(sizes) >= 15


def test_ties_across_cells_are_passed_on(spark):
    """Rows that tie are in some order: every row but the first is the one before exactly one other."""
    df = spark.range(500).selectExpr("'same' AS name", "double(id) AS y1")
    got = lag_features(df, ["y1"], 1, ["name"], max_rows=30).collect()
    assert len(got) == 499 and len({r["y1_l1"] for r in got}) == 499 and all(r["y1"] != r["y1_l1"] for r in got)


def test_cells_of_steps_and_by_value_together(spark):
    """One series is cut by times, another ties on them and is cut by the text."""
    df = spark.range(600).selectExpr("id % 2 AS k", "if(id % 2 = 0, id, 7) AS t", "concat('n', id) AS name", "double(id) AS y1")
    whole = lag_features(df, ["y1"], 2, ["t", "name"], ["k"], max_rows=None)
    assert same_rows(lag_features(df, ["y1"], 2, ["t", "name"], ["k"], max_rows=25), whole)
    assert same_rows(row_index(df, ["t", "name"], ["k"], max_rows=25), row_index(df, ["t", "name"], ["k"], max_rows=None))


def test_warmup_rows_show_zero(series):
    df = series([(5.0,), (6.0,), (7.0,)])
    rows = lag_features(df, ["y1"], 2, ORDER, keep_warmup=True).orderBy("id").collect()
    assert [(r["y1_l1"], r["y1_l2"]) for r in rows] == [(0.0, 0.0), (5.0, 0.0), (6.0, 5.0)]


def test_short_and_empty_input(series):
    df = series([(5.0,), (6.0,)])
    assert lag_features(df, ["y1"], 2, ORDER).isEmpty()
    assert lag_features(df.limit(0), ["y1"], 2, ORDER).isEmpty()


def test_drop_warmup_marks_constant(series):
    df = series([(float(i),) for i in range(5)])
    rows = drop_warmup(df, 2, ORDER).collect()
    assert sorted((r["rid"], r["const"]) for r in rows) == [(2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_lags_continue_over_batches(spark, skewed, by):
    rows = sorted([r for r in skewed if r[0]], key=lambda r: (r[0], r[1]))
    whole = lag_features(spark.createDataFrame(rows, SCHEMA), ["y1", "y2"], 3, ORDER, by)
    tail = spark.createDataFrame([], SCHEMA)
    parts = []
    for start in range(0, len(rows), 100):
        batch = spark.createDataFrame(rows[start : start + 100], SCHEMA)
        lagged, late, tail = continue_lags(batch, tail, ["y1", "y2"], 3, ORDER, by)
        assert late.isEmpty()
        parts += [tuple(r) for r in lagged.select(whole.columns).collect()]
        tail = spark.createDataFrame(tail.collect(), tail.schema)
    assert sorted(parts, key=repr) == sorted([tuple(r) for r in whole.collect()], key=repr)


def test_late_rows_are_set_apart(series):
    df = series([(float(i),) for i in range(6)])
    tail = last_rows(df.filter("id < 4"), 2, ORDER)
    lagged, late, _ = continue_lags(df.filter("id IN (1, 3, 4, 5)"), tail, ["y1"], 2, ORDER)
    assert sorted(r["id"] for r in late.collect()) == [1, 3]
    assert {r["id"]: r["y1_l1"] for r in lagged.collect()} == {4: 3.0, 5: 4.0}
