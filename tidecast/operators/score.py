"""Forecast errors: MAE, MSE and RMSE per target, and residual covariance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tidecast.functions.columns import aggregate, cols, finite, join_back, stacked
from tidecast.functions.names import predict_name, quote

_METRICS = ("n", "mae", "mse", "rmse")


def score_wide(
    predicted: DataFrame, predictions: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: ``<label>_n``, ``<label>_mae``, ``_mse`` and ``_rmse``.

    ``predictions`` maps a predicted column to its observed column; the predicted
    column's name is the label. All are gathered in one pass. Errors that are not finite
    numbers, from readings or predictions that are not, are left out.
    """
    values = {}
    for label, actual in predictions.items():
        error = f"({quote(actual)} - {quote(label)})"
        error = f"if(coalesce(abs({error}) < double('Infinity'), false), {error}, NULL)"
        values[f"{label}_n"] = f"count({error})"
        values[f"{label}_mae"] = f"avg(abs({error}))"
        values[f"{label}_mse"] = f"avg({error} * {error})"
        values[f"{label}_rmse"] = f"sqrt(avg({error} * {error}))"
    return aggregate(predicted, by, values)


def _metrics(label: str) -> dict[str, str]:
    return {m: quote(f"{label}_{m}") for m in _METRICS}


def score(predicted: DataFrame, targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group and target: n, mae, mse, rmse."""
    wide = score_wide(predicted, {predict_name(t): t for t in targets}, by)
    return stacked(
        wide, by, [{"target": f"'{t}'", **_metrics(predict_name(t))} for t in targets]
    )


def attach_scores(
    predicted: DataFrame,
    targets: Sequence[str],
    by: Sequence[str] = (),
    target: str | None = None,
) -> DataFrame:
    """Append the scores of each row's group to the row.

    Adds ``<target>_RMSE`` for every target, and ``MAE_Score``, ``MSE_Score`` and
    ``RMSE_Score`` of one ``target``, by default the last.
    """
    main = predict_name(target or targets[-1])

    def scores(rows: DataFrame) -> DataFrame:
        return score_wide(rows, {predict_name(t): t for t in targets}, by).selectExpr(
            *cols(by),
            *[f"{quote(predict_name(t) + '_rmse')} AS {quote(t + '_RMSE')}" for t in targets],
            *[f"{quote(f'{main}_{m}')} AS {m.upper()}_Score" for m in _METRICS[1:]],
        )

    return join_back(predicted, by, scores)


def compare_approaches(
    blended: DataFrame,
    targets: Sequence[str],
    approaches: Mapping[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group, approach and target: n, mae, mse, rmse.

    ``approaches`` maps an approach to the prefix of its prediction columns.
    """
    wide = score_wide(
        blended, {f"{prefix}_{t}": t for prefix in approaches.values() for t in targets}, by
    )
    rows = [
        {"approach": f"'{approach}'", "target": f"'{t}'", **_metrics(f"{prefix}_{t}")}
        for approach, prefix in approaches.items()
        for t in targets
    ]
    return stacked(wide, by, rows)


def residual_cov(
    with_residuals: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()
) -> DataFrame:
    """Residual covariance for each pair of targets, plain and adjusted.

    The adjusted form divides by the observations less the regressors of one
    equation, 1 + K p. All entries use the rows where every residual is a number.
    """
    names = [f"{t}_resid" for t in targets]
    k = len(targets)
    values = {"n_obs": "count(1)"}
    for i in range(k):
        for j in range(i, k):
            values[f"__c_{i}_{j}"] = f"covar_samp({quote(names[i])}, {quote(names[j])})"
    usable = with_residuals.filter(" AND ".join(finite(n) for n in names))
    wide = aggregate(usable, by, values)
    free = f"(n_obs - {1 + k * p})"
    rows = []
    for i in range(k):
        for j in range(k):
            cov = f"__c_{min(i, j)}_{max(i, j)}"
            rows.append(
                {
                    "target_a": f"'{targets[i]}'",
                    "target_b": f"'{targets[j]}'",
                    "cov": cov,
                    "cov_adjusted": f"{cov} * ((n_obs - 1) / if({free} > 0, {free}, NULL))",
                }
            )
    return stacked(wide, [*by, "n_obs"], rows)
