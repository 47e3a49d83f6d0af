"""Vector autoregression by least squares, as one aggregation.

With z = (all targets at lag 1, then lag 2, ...), every target is regressed on
z and an intercept. One aggregation per group gathers the count, the means and
the covariances of z with z and with the targets. These combine on the map
side, so a group shuffles one row per task however many rows it has, and being
centred they stay accurate when the means are large. The d x d normal equations
are then solved on that one row per group by array functions, so all groups of
all series are solved in parallel without leaving Spark SQL.

A group with fewer rows than unknowns gets status ``short`` and null coefficients. The solution
reveals the rank: a lag that is a linear combination of lags before it, as of two
sensors of one thing, tells nothing more. Its coefficient is 0 and marked ``aliased``, and the others
are fitted as without it, so the predictions are those of least squares. The same goes for a lag
that never varies, as of a sensor that is stuck; the status of its group is ``constant``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidecast.functions.columns import aggregate, cols, finite, stacked
from tidecast.functions.names import lag_names, quote

TOLERANCE = 1e-10
CONST = "const"


def coef_column(k: int, j: int) -> str:
    """Wide column of target k's coefficient j (0 is the intercept)."""
    return f"coef_{k}_{j}"


def terms(targets: Sequence[str], p: int) -> list[tuple[str, int]]:
    """``(term, lag)`` of each coefficient, intercept first."""
    lags = [(name, 1 + i // len(targets)) for i, name in enumerate(lag_names(targets, p))]
    return [(CONST, 0), *lags]


def usable(targets: Sequence[str], p: int) -> str:
    """SQL: the targets and all their lags are finite numbers."""
    return " AND ".join(finite(c) for c in [*lag_names(targets, p), *targets])


def moments(lagged: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()):
    """One row per group: count, means and covariances that the fit needs.

    ``m_i`` and ``y_k`` are means, ``a_i_j`` and ``b_i_k`` covariances of the
    lags with each other and with the targets.
    """
    d, k = len(targets) * p, len(targets)
    rows = lagged.filter(usable(targets, p)).selectExpr(
        *cols(by),
        *[f"double({quote(n)}) AS __z{i}" for i, n in enumerate(lag_names(targets, p))],
        *[f"double({quote(t)}) AS __y{j}" for j, t in enumerate(targets)],
    )
    values = {"n_obs": "count(1)"}
    values |= {f"m_{i}": f"avg(__z{i})" for i in range(d)}
    values |= {f"y_{j}": f"avg(__y{j})" for j in range(k)}
    values |= {
        f"a_{i}_{j}": f"covar_pop(__z{i}, __z{j})" for i in range(d) for j in range(i, d)
    }
    values |= {f"b_{i}_{j}": f"covar_pop(__z{i}, __y{j})" for i in range(d) for j in range(k)}
    return aggregate(rows, by, values)


def _solution(d: int, k: int) -> str:
    """SQL: the moments' d x (d + k) matrix with its left part reduced to one.

    Gauss-Jordan steps s = 0..d-1 over an array of rows, so the plan does not
    grow with d. The matrix is symmetric positive semidefinite: what is left of a diagonal element
    is the variance of that lag beyond what the lags before it explain, so no rows are
    exchanged. Where all but ``TOLERANCE`` of it is explained, or there was none, the lag is left out: its row
    becomes zeros, and so does its coefficient.
    """
    rows = ", ".join(
        "array("
        + ", ".join(
            [*[f"a_{min(i, j)}_{max(i, j)}" for j in range(d)], *[f"b_{i}_{j}" for j in range(k)]]
        )
        + ")"
        for i in range(d)
    )
    start = f"array({', '.join(f'a_{i}_{i}' for i in range(d))})"
    # First the pivot row, divided; then all other rows less their share of it.
    reduced = (
        "transform(m, (r, i) -> if(i = s, top, transform(r, (v, j) -> v - r[s] * top[j])))"
    )
    taken = f"transform(array(transform(m[s], v -> v / m[s][s])), top -> {reduced})[0]"
    left_out = "transform(m, (r, i) -> if(i = s, transform(r, v -> 0.0D), r))"
    varies = f"{start}[s] > 0 AND m[s][s] > {TOLERANCE} * {start}[s]"
    return f"aggregate(sequence(0, {d - 1}), array({rows}), (m, s) -> if({varies}, {taken}, {left_out}))"


def solve(moment_rows: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()):
    """Wide coefficients from ``moments``: by, n_obs, status, aliased, ``coef_<k>_<j>``.

    ``aliased`` has the numbers j of the lags that depend on those before them.
    """
    d, k = len(targets) * p, len(targets)
    means = [f"m_{i}" for i in range(d)]
    solved = moment_rows.selectExpr(
        *cols(by),
        "n_obs",
        *means,
        *[f"y_{j}" for j in range(k)],
        f"if(n_obs >= {d + 1}, {_solution(d, k)}, NULL) AS __x",
        f"{' OR '.join(f'a_{i}_{i} <= 0' for i in range(d))} AS __constant",
        f"array({', '.join(f'a_{i}_{i} > 0' for i in range(d))}) AS __varies",
    )
    names = [coef_column(j, i) for j in range(k) for i in range(d + 1)]
    values = {}
    for j in range(k):
        shares = " + ".join(f"__x[{i}][{d + j}] * {means[i]}" for i in range(d))
        values[coef_column(j, 0)] = f"y_{j} - ({shares})"
        values |= {coef_column(j, i + 1): f"__x[{i}][{d + j}]" for i in range(d)}
    aliased = f"filter(sequence(1, {d}), j -> __varies[j - 1] AND __x[j - 1][j - 1] = 0)"
    status = (
        "CASE WHEN __x IS NULL THEN 'short' "
        f"WHEN size({aliased}) > 0 THEN 'aliased' "
        "WHEN __constant THEN 'constant' ELSE 'ok' END AS status"
    )
    return solved.selectExpr(
        *cols(by), "n_obs", status, f"if(__x IS NULL, NULL, {aliased}) AS aliased", *[f"{sql} AS {name}" for name, sql in values.items()]
    )


def fit_wide(lagged: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()):
    """One row per group with all its coefficients, for joining back to rows."""
    return solve(moments(lagged, targets, p, by), targets, p, by)


def fit_var(lagged: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient table: by, target, term, lag, coef, n_obs, status.

    ``by`` fits one model per group: per series, per epoch, or both.
    """
    return to_long(fit_wide(lagged, targets, p, by), targets, p, by)


def to_long(wide: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()) -> DataFrame:
    def status(j: int) -> str:
        return f"if(status <> 'aliased', status, if(array_contains(aliased, {j}), 'aliased', 'ok'))"

    rows = [
        {"target": f"'{t}'", "term": f"'{term}'", "lag": str(lag), "coef": coef_column(k, j), "status": status(j)}
        for k, t in enumerate(targets)
        for j, (term, lag) in enumerate(terms(targets, p))
    ]
    long = stacked(wide, [*by, "n_obs"], rows)
    return long.select(*cols([*by, "target", "term", "lag", "coef", "n_obs", "status"]))


def to_wide(long: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()) -> DataFrame:
    """The inverse of ``to_long``, with the fixed set of terms and one shuffle."""
    values = {"n_obs": "max(n_obs)", "status": "min(status)"}
    marked = ", ".join(
        f"max(if(term = '{term}' AND status = 'aliased', {j}, NULL))"
        for j, (term, _) in enumerate(terms(targets, p))
        if j
    )
    values["aliased"] = f"if(min(status) = 'short', NULL, array_compact(array({marked})))"
    for k, t in enumerate(targets):
        for j, (term, _) in enumerate(terms(targets, p)):
            values[coef_column(k, j)] = f"max(if(target = '{t}' AND term = '{term}', coef, NULL))"
    return aggregate(long, by, values)


def coef_matrix(
    long: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()
) -> DataFrame:
    """One row per target: the intercept, then the coefficients in feature order."""
    values = {t: f"max(if(term = '{t}', coef, NULL))" for t, _ in terms(targets, p)}
    return aggregate(long, [*by, "target"], values)
