"""Fits against numpy and the ML pipeline, and their guards."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidecast.operators.fit import coef_matrix, fit_var, fit_wide, to_long, to_wide
from tidecast.operators.lags import lag_features
from tidecast.operators.mllib import (
    fit_pipelines,
    fit_var_mllib,
    load_pipelines,
    pipelines_of,
    predict_pipelines,
    read_pipelines,
    save_pipelines,
    table_of,
)
from tidecast.operators.predict import predict_var

ORDER = ["ts", "id"]


def by_numpy(values, p):
    """Intercept and lag-major coefficients per target, by least squares."""
    y = np.asarray(values, dtype=float)
    z = np.column_stack(
        [np.ones(len(y) - p)] + [y[p - i : len(y) - i] for i in range(1, p + 1)]
    )
    return np.linalg.lstsq(z, y[p:], rcond=None)[0].T


def coefs(table, target):
    rows = [r for r in table.collect() if r["target"] == target]
    order = {"const": -1}
    return [r["coef"] for r in sorted(rows, key=lambda r: (r["lag"], order.get(r["term"], r["term"])))]


def noisy(n, k, seed=0, offset=0.0):
    rng = np.random.default_rng(seed)
    return [tuple(float(v) + offset for v in row) for row in rng.normal(size=(n, k))]


@pytest.mark.parametrize(("k", "p"), [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)])
def test_fit_equals_numpy(series, k, p):
    values = noisy(120, k)
    targets = [f"y{j + 1}" for j in range(k)]
    table = fit_var(lag_features(series(values), targets, p, ORDER), targets, p)
    expected = by_numpy(values, p)
    for j, t in enumerate(targets):
        assert np.allclose(coefs(table, t), expected[j], atol=1e-9)
    assert {r["n_obs"] for r in table.collect()} == {120 - p}


def test_large_means_stay_accurate(series):
    values = noisy(200, 2, offset=1e8)
    lagged = lag_features(series(values), ["y1", "y2"], 2, ORDER)
    small = np.asarray(values) - 1e8
    expected = by_numpy(small, 2)
    table = fit_var(lagged, ["y1", "y2"], 2)
    for j, t in enumerate(["y1", "y2"]):
        assert np.allclose(coefs(table, t)[1:], expected[j][1:], atol=1e-5)


def test_recovers_known_process(series):
    """Two autoregressions of order 2 with known coefficients."""
    rng = np.random.default_rng(11)
    n = 3000
    a, b = np.zeros(n), np.zeros(n)
    for t in range(2, n):
        a[t] = 0.95 * np.sqrt(2) * a[t - 1] - 0.90 * a[t - 2] + rng.normal()
        b[t] = 0.5 * b[t - 2] + rng.normal()
    rows = list(zip(a.tolist(), b.tolist()))
    table = fit_var(lag_features(series(rows), ["y1", "y2"], 2, ORDER), ["y1", "y2"], 2)
    found = {(r["target"], r["term"]): r["coef"] for r in table.collect()}
    assert found["y1", "y1_l1"] == pytest.approx(0.95 * np.sqrt(2), abs=0.03)
    assert found["y1", "y1_l2"] == pytest.approx(-0.90, abs=0.03)
    assert found["y2", "y2_l2"] == pytest.approx(0.5, abs=0.05)
    assert found["y2", "y2_l1"] == pytest.approx(0.0, abs=0.05)


def test_guards_leave_other_groups_alone(series):
    """Short groups get nulls and a status; a lag that is constant or depends on others gets a zero."""
    rng = np.random.default_rng(5)
    good = rng.normal(size=(40, 2))
    groups = {
        "good": good,
        "constant": np.column_stack([good[:, 0], np.full(40, 7.0)]),
        "collinear": np.column_stack([good[:, 0], 2 * good[:, 0] + 1]),
        "short": good[:6],
    }
    parts = [
        series([tuple(map(float, r)) for r in v]).withColumn("g", F.lit(g))
        for g, v in groups.items()
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    lagged = lag_features(df, ["y1", "y2"], 2, ORDER, ["g"])
    table = fit_var(lagged, ["y1", "y2"], 2, ["g"])
    status = {r["g"]: r["status"] for r in table.collect() if r["status"] != "ok" or r["g"] == "good"}
    assert status == {
        "good": "ok",
        "constant": "constant",
        "collinear": "aliased",
        "short": "short",
    }
    assert table.filter("status = 'short' AND coef IS NOT NULL").isEmpty()
    alike = table.filter("g = 'collinear'")
    assert {r["term"] for r in alike.filter("status = 'aliased'").collect()} == {"y2_l1", "y2_l2"}
    assert alike.filter("status = 'aliased' AND coef <> 0").isEmpty()
    single = {r["term"]: r["coef"] for r in alike.filter("target = 'y1'").collect()}
    assert np.allclose([single[t] for t in ("const", "y1_l1", "y1_l2")], by_numpy(good[:, :1], 2)[0], atol=1e-9)
    stuck = table.filter("g = 'constant'")
    assert stuck.filter("term LIKE 'y2%' AND coef <> 0").isEmpty()
    own = by_numpy(good[:, :1], 2)[0]
    by_lag = {r["term"]: r["coef"] for r in stuck.filter("target = 'y1'").collect()}
    assert np.allclose([by_lag[t] for t in ("const", "y1_l1", "y1_l2")], own, atol=1e-9)
    assert [r["coef"] for r in stuck.filter("target = 'y2' AND term = 'const'").collect()] == [7.0]
    expected = by_numpy(good, 2)
    assert np.allclose(coefs(table.filter("g = 'good'"), "y1"), expected[0], atol=1e-9)


def test_collinear_lags_predict_as_least_squares(series):
    """A duplicate and a sum among four targets."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(80, 2)) * [1.0, 1e4]
    values = np.column_stack([a[:, 0], a[:, 0], a[:, 1], 2 - a.sum(axis=1)])
    names = [f"y{j + 1}" for j in range(4)]
    lagged = lag_features(series([tuple(map(float, r)) for r in values]), names, 2, ORDER)
    z = np.column_stack([np.ones(78), values[1:-1], values[:-2]])
    best = z @ np.linalg.lstsq(z, values[2:], rcond=1e-10)[0]
    got = predict_var(lagged, names, 2).orderBy(*ORDER).select(*[f"{n}_Predict" for n in names]).toPandas().to_numpy()
    assert np.allclose(got, best, rtol=1e-6, atol=1e-6)
    table = fit_var(lagged, names, 2)
    marked = {r["term"] for r in table.filter("status = 'aliased'").collect()}
    assert marked == {f"y{j}_l{i}" for j in (2, 4) for i in (1, 2)}
    stored = predict_var(lagged, names, 2, table).orderBy(*ORDER).select(*[f"{n}_Predict" for n in names])
    assert np.allclose(stored.toPandas().to_numpy(), got)


def test_unusable_rows_do_not_count(series):
    values = noisy(60, 1)
    values[20] = (None,)
    values[40] = (float("nan"),)
    table = fit_var(lag_features(series(values), ["y1"], 2, ORDER), ["y1"], 2)
    y = np.array([np.nan if v[0] is None else v[0] for v in values])
    z = np.column_stack([np.ones(58), y[1:-1], y[:-2]])
    keep = ~np.isnan(np.column_stack([z, y[2:]])).any(axis=1)
    expected = np.linalg.lstsq(z[keep], y[2:][keep], rcond=None)[0]
    assert {r["n_obs"] for r in table.collect()} == {int(keep.sum())}
    assert np.allclose(coefs(table, "y1"), expected, atol=1e-9)


def test_pipeline_twin(series, tmp_path):
    lagged = lag_features(series(noisy(150, 2, seed=2)), ["y1", "y2"], 2, ORDER)
    ours = fit_var(lagged, ["y1", "y2"], 2)
    twin = fit_var_mllib(lagged, ["y1", "y2"], 2)
    assert ours.dtypes == twin.dtypes
    for t in ("y1", "y2"):
        assert np.allclose(coefs(ours, t), coefs(twin, t), atol=1e-8)
    models, _ = fit_pipelines(lagged, ["y1", "y2"], 2)
    save_pipelines(models, str(tmp_path))
    loaded = load_pipelines(["y1", "y2"], str(tmp_path))
    by_pipeline = predict_pipelines(lagged, loaded, 2).orderBy("id").collect()
    by_table = predict_var(lagged, ["y1", "y2"], 2, ours).orderBy("id").collect()
    assert len(by_pipeline) == len(by_table) == 148
    for a, b in zip(by_pipeline, by_table):
        assert a["y1_Predict"] == pytest.approx(b["y1_Predict"], abs=1e-8)
        assert a["y2_Predict"] == pytest.approx(b["y2_Predict"], abs=1e-8)


def test_saved_pipelines_become_tables_and_back(spark, series, tmp_path):
    targets = ["y1", "y2"]
    lagged = lag_features(series(noisy(120, 2, seed=4)), targets, 2, ORDER)
    rows = lagged.selectExpr(*[f"double({c}) AS {c}" for c in ("y1", "y2", "y1_l1", "y1_l2", "y2_l1", "y2_l2")])
    # As another job may have saved them: the lags of one target first, not all targets at lag 1.
    mixed = VectorAssembler(inputCols=["y2_l2", "y2_l1", "y1_l2", "y1_l1"], outputCol="x")
    models = {t: Pipeline(stages=[mixed, LinearRegression(featuresCol="x", labelCol=t)]).fit(rows) for t in targets}
    save_pipelines(models, str(tmp_path / "a"))
    table = read_pipelines(spark, targets, 2, str(tmp_path / "a"))
    ours = fit_var(lagged, targets, 2)
    assert table.dtypes == ours.dtypes
    assert {r["n_obs"] for r in table.collect()} == {None}
    for t in targets:
        assert np.allclose(coefs(table, t), coefs(ours, t), atol=1e-8)

    built = pipelines_of(ours, targets, 2)
    save_pipelines(built, str(tmp_path / "b"))
    again = read_pipelines(spark, targets, 2, str(tmp_path / "b"), 118)
    assert sorted(again.collect()) == sorted(ours.collect())
    by_pipeline = predict_pipelines(lagged, built, 2).orderBy("id").collect()
    for a, b in zip(by_pipeline, predict_var(lagged, targets, 2, table).orderBy("id").collect()):
        assert a["y1_Predict"] == pytest.approx(b["y1_Predict"], abs=1e-8)


def test_models_that_are_no_tables_are_refused(spark, series):
    lagged = lag_features(series(noisy(60, 2, seed=5)), ["y1", "y2"], 1, ORDER)
    models, _ = fit_pipelines(lagged, ["y1", "y2"], 1)
    with pytest.raises(ValueError, match="other lags"):
        table_of(spark, models, 2)
    with pytest.raises(ValueError, match="not an assembler"):
        table_of(spark, {t: PipelineModel(m.stages[:1]) for t, m in models.items()}, 1)
    table = fit_var(lagged, ["y1", "y2"], 1)
    for bad in (table.filter("term <> 'const'"), table.union(table), table.withColumn("coef", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="not one coefficient"):
            pipelines_of(bad, ["y1", "y2"], 1)


def test_long_and_wide_are_inverse(series):
    df = series(noisy(90, 2)).withColumn("g", F.col("id") % 3)
    wide = fit_wide(lag_features(df, ["y1", "y2"], 2, ORDER, ["g"]), ["y1", "y2"], 2, ["g"])
    again = to_wide(to_long(wide, ["y1", "y2"], 2, ["g"]), ["y1", "y2"], 2, ["g"])
    key = lambda r: r["g"]
    assert sorted(wide.collect(), key=key) == sorted(again.select(wide.columns).collect(), key=key)


def test_matrix_has_one_row_per_target(series):
    table = fit_var(lag_features(series(noisy(50, 2)), ["y1", "y2"], 2, ORDER), ["y1", "y2"], 2)
    rows = {r["target"]: list(r)[1:] for r in coef_matrix(table, ["y1", "y2"], 2).collect()}
    expected = by_numpy(noisy(50, 2), 2)
    assert np.allclose(rows["y1"], expected[0], atol=1e-9)
    assert np.allclose(rows["y2"], expected[1], atol=1e-9)


def test_cut_series_fit_the_same(series):
    df = series(noisy(300, 2, seed=9))
    whole = fit_var(lag_features(df, ["y1", "y2"], 2, ORDER, max_rows=None), ["y1", "y2"], 2)
    cut = fit_var(lag_features(df, ["y1", "y2"], 2, ORDER, max_rows=20), ["y1", "y2"], 2)
    for t in ("y1", "y2"):
        assert np.allclose(coefs(whole, t), coefs(cut, t), atol=1e-10)
