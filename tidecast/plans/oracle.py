"""SQL for DuckDB that gives each registered query's result its own way.

The fits here use raw sums with the intercept as a regressor, not the centred
moments of ``operators.fit``, so the two routes check each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidecast.functions.names import lag_name, lag_names
from tidecast.operators.drift import (
    _COLUMN_FACTOR,
    _MODULUS,
    _MULTIPLIER,
    _SHIFT,
    _STEP_FACTOR,
)
from tidecast.plans.catalog import (
    APPROACHES,
    BATCH_WEIGHT,
    LAGS,
    LINE_VALUES,
    PREVIEW_ROWS,
    SEED,
    SPEED_WEIGHT,
    TARGETS,
    TRAIN_UNTIL,
    WIDE_LAGS,
)

CUT = f"TIMESTAMP '{TRAIN_UNTIL}'"
TIME_FORMAT = "%Y-%m-%d %H:%M:%S.%f"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


HOURS = """hours AS MATERIALIZED (
    SELECT date_trunc('hour', ts) AS TS,
           sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS y1,
           sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS y2,
           date_diff('day', DATE '1970-01-01', CAST(date_trunc('day', any_value(ts)) AS DATE))
               ::INTEGER AS epoch_id
    FROM events WHERE ts IS NOT NULL GROUP BY 1)"""


def lagged(name: str, source: str, targets: Sequence[str], order: str, by: str = "") -> str:
    """CTE of ``source`` with lag columns, without the first rows of each series."""
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order})"
    lags = ", ".join(
        f"lag({t}, {i}) {over} AS {lag_name(t, i)}" for i in range(1, LAGS + 1) for t in targets
    )
    return (
        f"{name} AS MATERIALIZED (SELECT *, {lags} FROM {source} "
        f"QUALIFY row_number() {over} > {LAGS})"
    )


def fit(name: str, source: str, targets: Sequence[str], by: Sequence[str] = ()) -> str:
    """CTEs ending in ``name``: by, n_obs and ``c_<k>_<j>``, one row per group."""
    z = ["1", *lag_names(targets, LAGS)]
    m, k = len(z), len(targets)
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    sums = [f"sum({z[i]} * {z[j]})::DOUBLE AS a_{i}_{j}" for i in range(m) for j in range(m)]
    sums += [f"sum({z[i]} * {t})::DOUBLE AS b_{i}_{j}" for i in range(m) for j, t in enumerate(targets)]
    parts = [
        f"{name}_0 AS MATERIALIZED (SELECT {keys}count(*) AS n_obs, {', '.join(sums)} "
        f"FROM {source}{group})"
    ]
    for s in range(m):
        cells = [(f"a_{i}_{j}", i, f"a_{s}_{j}") for i in range(m) for j in range(s + 1, m)]
        cells += [(f"b_{i}_{j}", i, f"b_{s}_{j}") for i in range(m) for j in range(k)]
        pivot = f"nullif(a_{s}_{s}, 0)"
        steps = [
            f"{right} / {pivot} AS {cell}"
            if i == s
            else f"{cell} - a_{i}_{s} * {right} / {pivot} AS {cell}"
            for cell, i, right in cells
        ]
        parts.append(
            f"{name}_{s + 1} AS MATERIALIZED (SELECT {keys}n_obs, {', '.join(steps)} FROM {name}_{s})"
        )
    solution = [
        f"CASE WHEN n_obs >= {m} THEN b_{i}_{j} END AS c_{j}_{i}" for j in range(k) for i in range(m)
    ]
    parts.append(
        f"{name} AS MATERIALIZED (SELECT {keys}n_obs, {', '.join(solution)} FROM {name}_{m})"
    )
    return ",\n".join(parts)


def coefficients(source: str, targets: Sequence[str], by: Sequence[str] = ()) -> str:
    """The long coefficient table from the wide one."""
    keys = "".join(f"{b}, " for b in by)
    rows = []
    for k, t in enumerate(targets):
        for j, term in enumerate(["const", *lag_names(targets, LAGS)]):
            lag = 0 if j == 0 else 1 + (j - 1) // len(targets)
            rows.append(
                f"SELECT {keys}'{t}' AS target, '{term}' AS term, {lag}::INTEGER AS lag, "
                f"{r(f'c_{k}_{j}', 'coef')}, n_obs, "
                f"CASE WHEN n_obs < {1 + len(targets) * LAGS} THEN 'short' "
                f"WHEN c_{k}_{j} IS NULL THEN 'aliased' ELSE 'ok' END AS status FROM {source}"
            )
    return "\nUNION ALL ".join(rows)


def predicted(
    name: str, rows: str, model: str, targets: Sequence[str], using: Sequence[str] = ()
) -> str:
    """CTE of ``rows`` with ``<t>_Predict`` from the wide ``model``."""
    z = lag_names(targets, LAGS)
    values = ", ".join(
        f"c_{k}_0 + " + " + ".join(f"c_{k}_{j} * {x}" for j, x in enumerate(z, 1)) + f" AS {t}_Predict"
        for k, t in enumerate(targets)
    )
    join = f"LEFT JOIN {model} USING ({', '.join(using)})" if using else f"CROSS JOIN {model}"
    return f"{name} AS MATERIALIZED (SELECT {rows}.*, {values} FROM {rows} {join})"


LAGGED = lagged("lagged", "hours", TARGETS, "TS")
LAGGED_EPOCH = lagged("lagged_epoch", "hours", TARGETS, "TS", "epoch_id")
HISTORY = ",\n".join(
    [
        f"before AS MATERIALIZED (SELECT * FROM hours WHERE TS < {CUT})",
        lagged("lagged_before", "before", TARGETS, "TS"),
        fit("history", "lagged_before", TARGETS),
    ]
)
IN_SAMPLE = ",\n".join(
    [HOURS, LAGGED, fit("model", "lagged", TARGETS), predicted("pred", "lagged", "model", TARGETS)]
)
SPEED = ",\n".join(
    [
        fit("epochs", "lagged_epoch", TARGETS, ["epoch_id"]),
        predicted("speed", "lagged_epoch", "epochs", TARGETS, ["epoch_id"]),
    ]
)
BATCH = ",\n".join([HISTORY, predicted("batch", "lagged_epoch", "history", TARGETS)])
BOTH = ",\n".join([HOURS, LAGGED_EPOCH, SPEED, BATCH])
PAIRS = [c for t in TARGETS for c in (t, f"{t}_Predict")]


def errors(target: str, prediction: str) -> list[str]:
    e = f"({target} - {prediction})"
    return [
        f"count({e}) AS n",
        r(f"avg(abs({e}))", "mae"),
        r(f"avg({e} * {e})", "mse"),
        r(f"sqrt(avg({e} * {e}))", "rmse"),
    ]


def scores(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {key}'{t}' AS target, {', '.join(errors(t, f'{t}_Predict'))} FROM {source}{group}"
        for t in TARGETS
    )


def scored(name: str, source: str) -> str:
    """CTE of prediction rows with their epoch's scores of the last target."""
    e = f"({TARGETS[-1]} - {TARGETS[-1]}_Predict)"
    over = "OVER (PARTITION BY epoch_id)"
    return (
        f"{name} AS MATERIALIZED (SELECT TS, {', '.join(PAIRS)}, "
        f"avg(abs({e})) {over} AS MAE_Score, avg({e} * {e}) {over} AS MSE_Score, "
        f"sqrt(avg({e} * {e}) {over}) AS RMSE_Score FROM {source})"
    )


SCORED_COLUMNS = "TS, " + ", ".join(
    r(c, c) for c in [*PAIRS, "MAE_Score", "MSE_Score", "RMSE_Score"]
)
SCORED_BATCH = f"WITH {BOTH}, {scored('s', 'batch')} SELECT {SCORED_COLUMNS} FROM s"
SCORED_SPEED = f"WITH {BOTH}, {scored('s', 'speed')} SELECT {SCORED_COLUMNS} FROM s"


def joined(digits: int | None, weighted: bool) -> str:
    columns = ["TS"]
    for t in TARGETS:
        named = [
            (f"s.{t}", t),
            (f"s.{t}_Predict", f"Speed_{t}"),
            (f"b.{t}_Predict", f"Batch_{t}"),
        ]
        if weighted:
            named.append((f"{SPEED_WEIGHT} * s.{t}_Predict + {BATCH_WEIGHT} * b.{t}_Predict", f"Wt_{t}"))
        columns += [f"{e}::DOUBLE AS {n}" if digits is None else r(e, n, digits) for e, n in named]
    columns += [
        r("s.RMSE_Score", "Speed_RMSE", digits or 6),
        r("b.RMSE_Score", "Batch_RMSE", digits or 6),
    ]
    return f"SELECT {', '.join(columns)} FROM ss s JOIN bb b USING (TS)"


SERVING = f"WITH {BOTH}, {scored('ss', 'speed')}, {scored('bb', 'batch')}"
BLEND = f"{SERVING} {joined(3, True)}"


def gapped() -> str:
    """Pairs and lone predictions where each layer misses some hours."""
    columns = ["TS"]
    for t in TARGETS:
        weighted = f"{SPEED_WEIGHT} * s.{t}_Predict + {BATCH_WEIGHT} * b.{t}_Predict"
        columns += [
            r(f"coalesce(s.{t}, b.{t})", t, 3), r(f"s.{t}_Predict", f"Speed_{t}", 3),
            r(f"b.{t}_Predict", f"Batch_{t}", 3), r(weighted, f"Wt_{t}", 3),
        ]
    columns += [r("s.RMSE_Score", "Speed_RMSE", 3), r("b.RMSE_Score", "Batch_RMSE", 3)]
    return f"""SELECT {', '.join(columns)},
        CASE WHEN s.y1_Predict IS NULL THEN 'speed' WHEN b.y1_Predict IS NULL THEN 'batch' END AS missing
        FROM (SELECT * FROM ss WHERE hour(TS) % 7 <> 3) s
        FULL JOIN (SELECT * FROM bb WHERE hour(TS) % 11 <> 5) b USING (TS)"""


def approaches(source: str, by: str = "") -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {key}'{name}' AS approach, '{t}' AS target, {', '.join(errors(t, f'{prefix}_{t}'))} "
        f"FROM {source}{group}"
        for name, prefix in APPROACHES.items()
        for t in TARGETS
    )


def jump(key: str, column: int, step: str) -> str:
    salt = f"({SEED + column * _COLUMN_FACTOR} + {step} * {_STEP_FACTOR})"
    mixed = f"(({key}) % {_MODULUS})"
    for _ in range(2):
        mixed = f"(({mixed} * {_MULTIPLIER} + {salt}) % {_MODULUS})"
        mixed = f"xor({mixed}, {mixed} >> {_SHIFT})"
    return f"(({mixed} % 10) + 1)"


def gradual(columns: Sequence[str]) -> str:
    def value(c: str) -> str:
        one = f"round({c} + 0.1, 2)"
        two = f"round({one} + 0.1, 2)"
        three = f"round({two} + 0.1, 2)"
        return f"(CASE step WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END)"

    return ", ".join(r(value(c), c, 2) for c in columns)


def abrupt(columns: Sequence[str], key: str) -> str:
    return ", ".join(
        r(f"{c} + 0.1 * {jump(key, i, '1')}", c, 2) for i, c in enumerate(columns)
    )


HOUR_KEY = "(date_diff('day', DATE '1970-01-01', CAST(TS AS DATE)) * 24 + hour(TS))"
DRIFT = ",\n".join(
    [
        HOURS,
        HISTORY,
        f"""scenarios AS MATERIALIZED (
    SELECT 'none' AS scenario, TS, epoch_id, 0 AS step, y1, y2 FROM hours
    UNION ALL SELECT 'gradual', TS, epoch_id, 0, y1, y2 FROM hours WHERE TS < {CUT}
    UNION ALL SELECT 'gradual', TS, epoch_id, step, {gradual(TARGETS)}
        FROM hours CROSS JOIN generate_series(1, 3) AS g(step) WHERE TS >= {CUT}
    UNION ALL SELECT 'abrupt', TS, epoch_id, 0, y1, y2 FROM hours WHERE TS < {CUT}
    UNION ALL SELECT 'abrupt', TS, epoch_id, 1, {abrupt(TARGETS, HOUR_KEY)}
        FROM hours WHERE TS >= {CUT})""",
        lagged("drifted", "scenarios", TARGETS, "TS, step", "scenario, epoch_id"),
        fit("refits", "drifted", TARGETS, ["scenario", "epoch_id"]),
        predicted("ss", "drifted", "refits", TARGETS, ["scenario", "epoch_id"]),
        predicted("bb", "drifted", "history", TARGETS),
        "both_rows AS MATERIALIZED (SELECT s.scenario, "
        + ", ".join(
            f"s.{t} AS {t}, s.{t}_Predict AS Speed_{t}, b.{t}_Predict AS Batch_{t}, "
            f"{SPEED_WEIGHT} * s.{t}_Predict + {BATCH_WEIGHT} * b.{t}_Predict AS Wt_{t}"
            for t in TARGETS
        )
        + " FROM ss s JOIN bb b USING (scenario, TS, step))",
    ]
)


def covariance() -> str:
    rows = []
    for a in TARGETS:
        for b in TARGETS:
            cov = f"covar_samp({a} - {a}_Predict, {b} - {b}_Predict)"
            df = f"(count(*) - {1 + len(TARGETS) * LAGS})"
            rows.append(
                f"SELECT '{a}' AS target_a, '{b}' AS target_b, {r(cov, 'cov')}, "
                f"{r(f'{cov} * (count(*) - 1) / {df}', 'cov_adjusted')}, count(*) AS n_obs FROM pred"
            )
    return " UNION ALL ".join(rows)


def matrix() -> str:
    names = ["const", *lag_names(TARGETS, LAGS)]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS target, {', '.join(r(f'c_{k}_{j}', n) for j, n in enumerate(names))} FROM model"
        for k, t in enumerate(TARGETS)
    )


def fixed(x: str) -> str:
    return f"CAST(CAST(round({x}, 6) AS DECIMAL(18, 6)) AS VARCHAR)"


def time_text(x: str) -> str:
    return f"strftime({x}, '{TIME_FORMAT}')"


EVENT_LAGS = f"""SELECT event_id, ts, value,
    lag(value, 1) OVER w AS value_l1, lag(value, 2) OVER w AS value_l2
    FROM events WINDOW w AS (ORDER BY ts, event_id) QUALIFY row_number() OVER w > {LAGS}"""
USER_LAGS = lagged(
    "u",
    "(SELECT user_id, ts, event_id, value FROM events)",
    ["value"],
    "ts, event_id",
    "user_id",
)
USER_FIT = f"{USER_LAGS}, {fit('m', 'u', ['value'], ['user_id'])}"
# Readings that are not numbers are nulls here: every aggregate leaves them out.
NONFINITE = ",\n".join(
    [
        HOURS,
        "spoilt AS MATERIALIZED (SELECT TS, CASE WHEN hour(TS) % 7 = 3 THEN NULL ELSE y1 END AS y1, y2 FROM hours)",
        lagged("spoilt_lags", "spoilt", TARGETS, "TS"),
        f"usable AS MATERIALIZED (SELECT * FROM spoilt_lags WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*TARGETS, *lag_names(TARGETS, LAGS)])})",
        fit("model", "usable", TARGETS),
        predicted("pred", "spoilt_lags", "model", TARGETS),
    ]
)


def constant_fit() -> str:
    """The second target is always 5: the first one's own lags are all there is to fit."""
    rows = [("y1", "const", 0, "c_0_0"), ("y2", "const", 0, "5.0")]
    for i in range(1, LAGS + 1):
        rows += [("y1", f"y1_l{i}", i, f"c_0_{i}"), ("y1", f"y2_l{i}", i, "0.0")]
        rows += [("y2", f"y1_l{i}", i, "0.0"), ("y2", f"y2_l{i}", i, "0.0")]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{term}' AS term, {i}::INTEGER AS lag, {r(c + '::DOUBLE', 'coef')}, n_obs, 'constant' AS status FROM alone"
        for t, term, i, c in rows
    )


SERIES_SERVED = f"""WITH {USER_FIT}, {predicted('s', 'u', 'm', ['value'], ['user_id'])},
    {fit('whole', 'u', ['value'])}, {predicted('b', 'u', 'whole', ['value'])}
    SELECT s.ts, s.event_id, s.user_id, {r('s.value', 'value')}, {r('s.value_Predict', 'Speed_value')},
    {r('b.value_Predict', 'Batch_value')},
    {r(f'{SPEED_WEIGHT} * s.value_Predict + {BATCH_WEIGHT} * b.value_Predict', 'Wt_value')}
    FROM s JOIN b USING (event_id) WHERE s.value_Predict IS NOT NULL"""
PREDICT_LOADED = f"""WITH {HOURS}, {LAGGED}, {HISTORY},
        {predicted('p', 'lagged', 'history', TARGETS)}"""
VALUES = "TS, " + ", ".join(r(c, c) for c in PAIRS)
LINE_KEY = "l_orderkey * 8 + l_linenumber"

# Raw sums as rows (i, j): 0 is the intercept, 1 to p the lags, p + 1 the value; one elimination step a round.
WIDE_FIT = f"""WITH RECURSIVE vectors AS (
    SELECT [1.0::DOUBLE] || list_reverse(v)[2:] || v[-1:] AS x
    FROM (SELECT list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {WIDE_LAGS} PRECEDING AND CURRENT ROW) AS v FROM events)
    WHERE len(v) = {WIDE_LAGS + 1} AND len(list_filter(v, lambda e: isfinite(e))) = {WIDE_LAGS + 1}
), sums AS MATERIALIZED (
    SELECT i, j, sum(a * b) AS v FROM (
        SELECT x, unnest(x) AS a, unnest(range(0, {WIDE_LAGS + 2})) AS i FROM vectors
    ), LATERAL (SELECT unnest(x) AS b, unnest(range(0, {WIDE_LAGS + 2})) AS j)
    WHERE i <= {WIDE_LAGS} GROUP BY i, j
), steps(s, i, j, v) AS (
    SELECT 0, i, j, v FROM sums
    UNION ALL
    SELECT s + 1, i, j, CASE WHEN i = s THEN top / lead_v ELSE v - own * top / lead_v END FROM (
        SELECT *, max(CASE WHEN i = s THEN v END) OVER (PARTITION BY j) AS top,
            max(CASE WHEN j = s THEN v END) OVER (PARTITION BY i) AS own,
            max(CASE WHEN i = s AND j = s THEN v END) OVER () AS lead_v
        FROM steps WHERE s <= {WIDE_LAGS}
    )
)
SELECT 'value' AS target, CASE WHEN i = 0 THEN 'const' ELSE 'value_l' || i END AS term, i::INTEGER AS lag,
    {r("v", "coef")}, (SELECT v::BIGINT FROM sums WHERE i = 0 AND j = 0) AS n_obs, 'ok' AS status
FROM steps WHERE s = {WIDE_LAGS + 1} AND j = {WIDE_LAGS + 1}"""

ORACLE: dict[str, str] = {
    "var_fit_wide": WIDE_FIT,
    "lag_features": EVENT_LAGS,
    "lag_features_bucketed": EVENT_LAGS,
    "lag_features_by_value": f"""SELECT event_id, event_type, value, lag(value, 1) OVER w AS value_l1, lag(value, 2) OVER w AS value_l2
        FROM events WINDOW w AS (ORDER BY event_type NULLS FIRST, value NULLS FIRST, event_id)
        QUALIFY row_number() OVER w > {LAGS}""",
    "lag_features_by_series": f"WITH {USER_LAGS} SELECT * FROM u",
    "stream_lag_continuous": f"WITH {USER_LAGS} SELECT * FROM u",
    "drop_warmup": f"""SELECT user_id, ts, event_id, row_number() OVER w - 1 AS rid,
        1::INTEGER AS const FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
        QUALIFY row_number() OVER w > {LAGS}""",
    "var_fit": f"WITH {IN_SAMPLE} {coefficients('model', TARGETS)}",
    "var_fit_mllib": f"WITH {IN_SAMPLE} {coefficients('model', TARGETS)}",
    "model_from_pipelines": f"WITH {IN_SAMPLE} {coefficients('model', TARGETS)}",
    "var_fit_by_epoch": f"WITH {BOTH} {coefficients('epochs', TARGETS, ['epoch_id'])}",
    "var_fit_by_series": f"WITH {USER_FIT} {coefficients('m', ['value'], ['user_id'])}",
    "var_coef_matrix": f"WITH {IN_SAMPLE} {matrix()}",
    "model_roundtrip": f"WITH {HOURS}, {HISTORY} {coefficients('history', TARGETS)}",
    "var_predict_loaded": f"""WITH {HOURS}, {LAGGED}, {HISTORY},
        {predicted('p', 'lagged', 'history', TARGETS)} SELECT {VALUES} FROM p""",
    "var_predict_epoch": f"WITH {BOTH} SELECT epoch_id, {VALUES} FROM speed",
    "var_predict_by_series": f"""WITH {USER_FIT}, {predicted('p', 'u', 'm', ['value'], ['user_id'])}
        SELECT user_id, ts, event_id, {r('value', 'value')}, {r('value_Predict', 'value_Predict')}
        FROM p""",
    "var_scores": f"WITH {IN_SAMPLE} {scores('pred')}",
    "var_scores_by_epoch": f"WITH {BOTH} {scores('speed', 'epoch_id')}",
    "var_scores_attached": SCORED_BATCH,
    "var_residuals": f"""WITH {IN_SAMPLE} SELECT TS,
        {', '.join(r(f'{t} - {t}_Predict', f'{t}_resid') for t in TARGETS)} FROM pred""",
    "var_residual_cov": f"WITH {IN_SAMPLE} {covariance()}",
    "merge_predictions": f"WITH {BOTH} SELECT {VALUES} FROM speed",
    "replay_encode": f"""SELECT event_id, '"' || {time_text('ts')} || ',' || {fixed('value')} || ','
        || {fixed('user_id')} || '"' AS value FROM events""",
    "decode_observations": "SELECT event_id, ts, value, user_id::DOUBLE AS user_id FROM events",
    "decode_time_pattern": """SELECT event_id, CASE WHEN event_type <> 'purchase' THEN ts END AS ts,
        CASE WHEN event_type = 'purchase' THEN 'ts' END AS bad_field FROM events""",
    "decode_rejected": f"""SELECT event_id, 'value' AS bad_field,
        {time_text('ts')} || CASE WHEN event_type = 'error' THEN ',oops,' || user_id ELSE '' END
        AS value FROM events WHERE event_type IN ('error', 'view')""",
    "encode_predictions": f"""WITH {BOTH}, {scored('s', 'batch')} SELECT {time_text('TS')} || ',' ||
        {" || ',' || ".join(fixed(c) for c in [*PAIRS, 'RMSE_Score'])} AS value FROM s""",
    "decode_predictions": f"""WITH {BOTH}, {scored('s', 'speed')} SELECT {VALUES},
        {r('RMSE_Score', 'RMSE_Score')} FROM s""",
    "decode_predictions_short": f"""WITH {BOTH} SELECT TS,
        {', '.join(r(c, f'SP_{c}') for c in PAIRS)} FROM speed""",
    "topic_demux": """SELECT event_type AS topic, ts, value, user_id::DOUBLE AS user_id FROM events
        WHERE event_type IN ('click', 'purchase')""",
    "csv_roundtrip": "SELECT event_id, ts, event_type, value FROM events",
    "master_append": """SELECT event_id, ts, value,
        date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::INTEGER AS epoch_id FROM events
        WHERE ts IS NOT NULL""",
    "preview_latest": f"""SELECT event_id, ts, user_id, value FROM events
        ORDER BY ts DESC, event_id DESC LIMIT {PREVIEW_ROWS}""",
    "time_extent": "SELECT min(ts) AS start_ts, max(ts) AS end_ts FROM events",
    "serving_join": f"{SERVING} {joined(6, False)}",
    "serving_blend": BLEND,
    "layer_serving": BLEND,
    "serving_join_stream": BLEND,
    "serving_unmatched_stream": f"{SERVING} {gapped()}",
    "approach_scores": f"{SERVING}, j AS MATERIALIZED ({joined(None, True)}) {approaches('j')}",
    "approach_scores_drift": f"WITH {DRIFT} {approaches('both_rows', 'scenario')}",
    "drift_gradual": f"""SELECT l_orderkey, l_linenumber, step::INTEGER AS step,
        {gradual(LINE_VALUES)} FROM lineitem CROSS JOIN generate_series(1, 3) AS g(step)""",
    "drift_abrupt": f"""SELECT l_orderkey, l_linenumber, 1::INTEGER AS step,
        {abrupt(LINE_VALUES, LINE_KEY)} FROM lineitem""",
    "layer_batch": SCORED_BATCH,
    "layer_speed": SCORED_SPEED,
    "stream_speed": SCORED_SPEED,
    "stream_batch": f"WITH {BOTH} SELECT {VALUES} FROM batch",
    "stream_batch_continuous": f"{PREDICT_LOADED} SELECT {VALUES} FROM p",
    "var_scores_nonfinite": f"WITH {NONFINITE} {scores('pred')}",
    "var_fit_constant": f"WITH {HOURS}, {LAGGED}, {fit('alone', 'lagged', ['y1'])} {constant_fit()}",
    "var_predict_collinear": f"""WITH {IN_SAMPLE} SELECT TS, {r('y1_Predict', 'y1_Predict')},
        {r('y2_Predict', 'y2_Predict')}, {r('y1_Predict', 'y3_Predict')}, {r('y1_Predict + y2_Predict', 'y4_Predict')}
        FROM pred""",
    "train_from_csv": f"WITH {IN_SAMPLE} {coefficients('model', TARGETS)}",
    "layer_serving_by_series": SERIES_SERVED,
    "stream_decode": "SELECT ts, value, user_id::DOUBLE AS user_id FROM events",
}
ORACLE["stream_replayed"] = ORACLE["decode_predictions"]
ORACLE["csv_rejected"] = f"""WITH {HOURS}, l AS (SELECT *, hour(TS) % 6 AS kind FROM hours)
    SELECT CASE WHEN kind NOT IN (1, 2, 3) THEN TS END AS TS,
        {", ".join(f"CASE WHEN kind NOT IN (1, 2, 3) THEN round({t}, 6) + 0.0 END AS {t}" for t in TARGETS)},
        CASE kind WHEN 1 THEN {time_text('TS')} || ',oops,1' WHEN 2 THEN {time_text('TS')}
            WHEN 3 THEN {time_text('TS')} || ',1,2,3' END AS line
    FROM l"""
ORACLE["drift_file_roundtrip"] = ORACLE["drift_gradual"]
ORACLE["stream_rejected"] = f"SELECT bad_field, value FROM ({ORACLE['decode_rejected']})"
