"""One-step-ahead predictions from lag features and fitted or stored models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidecast.functions.columns import aggregate, cols, finite, join_back, stacked
from tidecast.functions.names import lag_names, predict_name, quote
from tidecast.operators.fit import coef_column, fit_wide, to_wide


def _dot(k: int, features: Sequence[str]) -> str:
    """SQL: the prediction of target k, null unless all lags are finite numbers."""
    products = [f"{coef_column(k, j)} * {quote(z)}" for j, z in enumerate(features, start=1)]
    usable = " AND ".join(finite(z) for z in features)
    return f"if({usable}, {' + '.join([coef_column(k, 0), *products])}, NULL)"


def predict_var(
    lagged: DataFrame,
    targets: Sequence[str],
    p: int,
    coefficients: DataFrame | None = None,
    by: Sequence[str] = (),
    keep_lags: bool = False,
) -> DataFrame:
    """Append ``<target>_Predict`` to every row.

    With ``coefficients`` (long or wide) the stored model is applied; without,
    a model is fitted to these same rows, one per ``by`` group. A row whose
    lags are not all numbers, or whose group has no model, gets nulls.

    Without ``by`` the model side is the one row of a global aggregate. With
    ``by`` it is an equi-join on the columns the lag window is partitioned by,
    so the rows are not moved again; AQE broadcasts the models if they turn
    out small, and splits groups that turn out hot.
    """
    features = lag_names(targets, p)
    names = [coef_column(k, j) for k in range(len(targets)) for j in range(len(features) + 1)]
    if coefficients is None:
        joined = join_back(
            lagged, by, lambda rows: fit_wide(rows, targets, p, by).select(*cols([*by, *names]))
        )
    else:
        long = "term" in coefficients.columns
        model = to_wide(coefficients, targets, p, by) if long else coefficients
        model = model.select(*cols([*by, *names]))
        if not by and not long:
            # One row whatever is given, so that rows are never multiplied by models.
            refuse = "raise_error('more than one model without a key')"
            one = {n: f"if(count(1) > 1, {refuse}, max({n}))" for n in names}
            model = aggregate(model, [], one)
        joined = lagged.join(model, list(by), "left") if by else lagged.crossJoin(model)
    kept = [c for c in lagged.columns if keep_lags or c not in features]
    return joined.selectExpr(
        *cols(kept),
        *[f"{_dot(k, features)} AS {quote(predict_name(t))}" for k, t in enumerate(targets)],
    )


def residuals(predicted: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Append ``<target>_resid``: observed less predicted."""
    return predicted.selectExpr(
        "*", *[f"{quote(t)} - {quote(predict_name(t))} AS {quote(t + '_resid')}" for t in targets]
    )


def stack_predictions(
    predicted: DataFrame, targets: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Long form: ``keep``, target, actual, prediction."""
    rows = [
        {
            "target": f"'{t}'",
            "actual": f"double({quote(t)})",
            "prediction": quote(predict_name(t)),
        }
        for t in targets
    ]
    return stacked(predicted, keep, rows)


def merge_predictions(long: DataFrame, targets: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Wide form again: one row per ``on`` key that has every target.

    One aggregation on the key in place of a self-join per target. ``on`` must
    identify a row; tied times therefore cannot multiply rows.
    """
    values = {}
    for i, t in enumerate(targets):
        values[t] = f"max(if(target = '{t}', actual, NULL))"
        values[predict_name(t)] = f"max(if(target = '{t}', prediction, NULL))"
        values[f"__has_{i}"] = f"bool_or(target = '{t}')"
    merged = aggregate(long, on, values)
    has = [f"__has_{i}" for i in range(len(targets))]
    return merged.filter(" AND ".join(has)).drop(*has)
