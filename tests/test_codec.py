"""Messages: what is read, what is rejected, and back again."""

import datetime as dt

import pytest

from tidecast.functions.codec import (
    TIME_PATTERN,
    decode,
    encode,
    observation_fields,
    prediction_fields,
)

FIELDS = observation_fields(["y1", "y2"])
T0 = dt.datetime(2024, 2, 3, 4, 5, 6)


def read(spark, texts, **kwargs):
    good, rejected = decode(spark.createDataFrame([(t,) for t in texts], "value string"), FIELDS, **kwargs)
    return good.collect(), {r["value"]: r["bad_field"] for r in rejected.collect()}


@pytest.mark.parametrize(
    "text",
    [
        '"2024-02-03 04:05:06,1.5,-2"',
        "2024-02-03 04:05:06,1.5,-2",
        '"2024-02-03 04:05:06.000000,1.5,-2.0"',
        "2024-02-03 04:05:06, 1.5 ,-2e0,extra",
    ],
)
def test_reads(spark, text):
    good, rejected = read(spark, [text])
    assert [tuple(r) for r in good] == [(T0, 1.5, -2.0)]
    assert rejected == {}


def test_fraction_and_month_survive(spark):
    good, _ = read(spark, ["2024-11-03 04:05:06.123456,1,2"], time_pattern=TIME_PATTERN)
    assert good[0]["TS"] == dt.datetime(2024, 11, 3, 4, 5, 6, 123456)


@pytest.mark.parametrize(
    ("text", "field"),
    [
        ("", "TS"),
        ("2024-02-03 04:05:06,1.5", "y2"),
        ("2024-02-03 04:05:06,abc,2", "y1"),
        ("2024-02-03 04:05:06,,2", "y1"),
        ("2024-02-03 04:05:06,1,NaN", "y2"),
        ("2024-02-03 04:05:06,Infinity,1", "y1"),
        ("2024-13-03 04:05:06,1,2", "TS"),
        ("yesterday,x,y", "TS"),
    ],
)
def test_rejects_with_first_bad_field(spark, text, field):
    good, rejected = read(spark, [text, "2024-02-03 04:05:06,1,2"])
    assert len(good) == 1
    assert rejected == {text: field}


def test_strict_pattern_rejects_other_forms(spark):
    good, rejected = read(spark, ["2024-02-03T04:05:06,1,2"], time_pattern=TIME_PATTERN)
    assert good == [] and list(rejected.values()) == ["TS"]
    assert len(read(spark, ["2024-02-03T04:05:06,1,2"])[0]) == 1


def test_null_and_binary_values(spark):
    df = spark.createDataFrame([(None, 1), (b"2024-02-03 04:05:06,1,2", 2)], "value binary, k int")
    good, rejected = decode(df, FIELDS, keep=["k"])
    assert [r["k"] for r in good.collect()] == [2]
    assert [(r["k"], r["value"], r["bad_field"]) for r in rejected.collect()] == [(1, None, "TS")]


@pytest.mark.parametrize("quoted", [False, True])
def test_decode_inverts_encode(spark, quoted):
    rows = [(T0, 0.1 + 0.2, -1e-17), (T0.replace(microsecond=7), 1e300, 5.0)]
    df = spark.createDataFrame(rows, "TS timestamp_ntz, y1 double, y2 double")
    good, _ = decode(encode(df, ["TS", "y1", "y2"], quoted=quoted), FIELDS)
    assert sorted(tuple(r) for r in good.collect()) == sorted(rows)


def test_null_field_makes_null_message(spark):
    df = spark.createDataFrame([(T0, None, 1.0)], "TS timestamp_ntz, y1 double, y2 double")
    assert encode(df, ["TS", "y1", "y2"]).first()["value"] is None
    assert encode(df, ["TS", "y1", "y2"], quoted=True, digits=2).first()["value"] is None


def test_fixed_digits_and_escapes(spark):
    df = spark.createDataFrame([(1.005, 'a"b\\c', 1e40)], "x double, s string, big double")
    assert encode(df, ["x"], digits=1).first()["value"] == "1.0"
    assert encode(df, ["big"], digits=6).first()["value"] == "1.0E40"
    assert encode(df, ["s"], quoted=True).first()["value"] == '"a\\"b\\\\c"'


def test_prediction_fields():
    assert [n for n, _ in prediction_fields(["a", "b"])] == [
        "TS", "a", "a_Predict", "b", "b_Predict", "RMSE_Score",
    ]
    assert [n for n, _ in prediction_fields(["a"], prefix="SP_", rmse=False)] == [
        "TS", "SP_a", "SP_a_Predict",
    ]
