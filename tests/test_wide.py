"""Fits over many features, against the narrow fit and against numpy."""

import numpy as np
import pytest

from tidecast.operators import wide
from tidecast.operators.fit import fit_var
from tidecast.operators.lags import lag_features
from tidecast.operators.mllib import fit_var_mllib


def series(spark, n=600, groups=3, spoil=True):
    rng = np.random.default_rng(5)
    rows = []
    for g in [*range(groups - 1), None]:
        y = rng.normal(1000, 1, (n if g != 1 else 4, 2)).cumsum(axis=0) / 7
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(y)]
    if spoil:
        rows[5] = (rows[5][0], rows[5][1], None, 1.0)
        rows[9] = (rows[9][0], rows[9][1], float("nan"), float("inf"))
    return spark.createDataFrame(rows, "g int, t int, y1 double, y2 double").repartition(5)


def coefficients(df, by):
    return {tuple(r[c] for c in [*by, "target", "term", "lag"]): (r["coef"], r["n_obs"], r["status"]) for r in df.collect()}


def assert_same(got, expected):
    assert got.keys() == expected.keys()
    for key, (coef, n, status) in expected.items():
        assert got[key][1:] == (n, status), key
        assert (got[key][0] is None) == (coef is None)
        assert coef is None or got[key][0] == pytest.approx(coef, rel=1e-6, abs=1e-6), key


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("held", [wide.HELD, 1])
def test_equals_the_narrow_fit(spark, monkeypatch, by, held):
    monkeypatch.setattr(wide, "HELD", held)
    monkeypatch.setattr(wide, "BLOCK", 7)
    rows = lag_features(series(spark), ["y1", "y2"], 2, ["t"], ["g"])
    assert_same(coefficients(wide.fit_var_wide(rows, ["y1", "y2"], 2, by), by), coefficients(fit_var(rows, ["y1", "y2"], 2, by), by))


def test_dependent_and_constant_lags_are_marked(spark):
    df = series(spark, spoil=False).selectExpr("g", "t", "y1", "y1 * 2 AS y2", "5.0D AS y3").filter("g = 0")
    rows = lag_features(df, ["y1", "y2"], 2, ["t"])
    got = coefficients(wide.fit_var_wide(rows, ["y1", "y2"], 2), [])
    assert_same(got, coefficients(fit_var(rows, ["y1", "y2"], 2), []))
    assert got["y1", "y2_l1", 1][2] == "aliased"
    still = lag_features(df, ["y1", "y3"], 1, ["t"])
    assert {v[2] for v in coefficients(wide.fit_var_wide(still, ["y1", "y3"], 1), []).values()} == {"constant"}


def test_empty_and_unusable_rows(spark):
    rows = lag_features(series(spark), ["y1"], 2, ["t"], ["g"])
    assert wide.fit_var_wide(rows.limit(0), ["y1"], 2, ["g"]).count() == 0
    assert wide.fit_var_wide(rows.selectExpr("t", "double(NULL) AS y1", "y1_l1", "y1_l2"), ["y1"], 2).count() == 0


def test_many_features_equal_the_pipelines(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    rows = lag_features(events, ["value"], 64, ["ts", "event_id"])
    got, twin = (coefficients(f(rows, ["value"], 64), []) for f in (wide.fit_var_wide, fit_var_mllib))
    assert len(got) == 65
    assert_same(got, twin)


def test_plan_does_not_grow_with_the_square(spark):
    """The text of the plan: four times the features, about four times the names, not sixteen times."""

    def size(p):
        rows = lag_features(series(spark, 50), ["y1"], p, ["t"])
        return len(wide.fit_var_wide(rows, ["y1"], p)._jdf.queryExecution().optimizedPlan().toString())

    assert size(80) < 6 * size(20)
