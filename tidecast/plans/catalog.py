"""The registered queries: each operator run over the whole driver tables.

Values that differ in the last bits between engines (sums, fits, predictions)
are rounded to six decimals in the last step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.codec import (
    TIME_PATTERN,
    decode,
    encode,
    observation_fields,
    prediction_fields,
)
from tidecast.functions.columns import col
from tidecast.functions.names import predict_name, quote, target_columns
from tidecast.operators import cells
from tidecast.operators.drift import inject_abrupt, inject_gradual
from tidecast.operators.fit import coef_matrix, fit_var
from tidecast.operators.lags import drop_warmup, lag_features
from tidecast.operators.mllib import (
    fit_pipelines,
    fit_var_mllib,
    pipelines_of,
    read_pipelines,
    save_pipelines,
)
from tidecast.operators.predict import (
    merge_predictions,
    predict_var,
    residuals,
    stack_predictions,
)
from tidecast.operators.score import attach_scores, compare_approaches, residual_cov, score
from tidecast.operators.serve import blend, by_topic, preview_latest, serving_join, time_extent
from tidecast.operators.wide import fit_var_wide
from tidecast.plans.layers import (
    batch_layer,
    prediction_messages,
    scored_rows,
    serving_layer,
    speed_layer,
)
from tidecast.plans.series import LAGS, TARGETS, TIME, hourly, table, with_epoch
from tidecast.sources.messages import once, read_messages, stream_messages, with_message_ids, write_messages
from tidecast.sources.scratch import fresh_dir
from tidecast.sources.tables import (
    append_epoch,
    read_csv,
    read_csv_lines,
    read_model,
    read_table,
    with_file_order,
    write_csv,
    write_model,
)
from tidecast.streaming.continuous import stream_lags
from tidecast.streaming.layers import land_rejected, to_files
from tidecast.streaming.serving import serving_stream
from tidecast.streaming.speed import epoch_fits, epoch_lags, lagged_schema, speed_predictions

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
TRAIN_UNTIL = "2024-01-16 00:00:00"
SPEED_WEIGHT, BATCH_WEIGHT = 0.6, 0.4
SEED = 7
DIGITS = 6
PREVIEW_ROWS = 10
WIDE_LAGS = 64

USER_ORDER = ["ts", "event_id"]
EVENT_FIELDS = [("ts", "timestamp_ntz"), ("value", "double"), ("user_id", "double")]
APPROACHES = {"speed": "Speed", "batch": "Batch", "hybrid": "Wt"}


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six decimals; float noise around zero becomes plain zero."""
    return df.selectExpr(
        *[
            f"round({quote(name)}, {DIGITS}) + 0.0D AS {quote(name)}"
            if kind == "double"
            else quote(name)
            for name, kind in df.dtypes
        ]
    )


# -- series ------------------------------------------------------------------


def events_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*columns)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_epoch(hourly(table(spark, sf_dir, "events")))


def hourly_lags(rows: DataFrame) -> DataFrame:
    # One row per hour: the calendar bounds the series, so no counting job.
    return lag_features(rows, TARGETS, LAGS, [TIME], max_rows=None)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, "user_id", "ts", "event_id", "value")


def history_model(rows: DataFrame) -> DataFrame:
    """The stored model's coefficients: fitted to the hours before the cut."""
    return fit_var(hourly_lags(rows.filter(f"{TIME} < TIMESTAMP_NTZ '{TRAIN_UNTIL}'")), TARGETS, LAGS)


def batch_rows(rows: DataFrame) -> DataFrame:
    return batch_layer(rows, history_model(rows), TARGETS, LAGS, [TIME], max_rows=None)


def speed_rows(rows: DataFrame) -> DataFrame:
    return speed_layer(rows, TARGETS, LAGS, [TIME], max_rows=None)


def scored(rows: DataFrame) -> DataFrame:
    return scored_rows(rows, TARGETS, [TIME], ["epoch_id"])


# -- lags --------------------------------------------------------------------


def q_lag_features(spark, sf_dir):
    events = events_of(spark, sf_dir, "event_id", "ts", "value")
    return lag_features(events, ["value"], LAGS, USER_ORDER)


def q_lag_features_by_series(spark, sf_dir):
    return lag_features(user_events(spark, sf_dir), ["value"], LAGS, USER_ORDER, ["user_id"])


def q_lag_features_bucketed(spark, sf_dir):
    """As ``lag_features``, cut into cells even where the table is small."""
    events = events_of(spark, sf_dir, "event_id", "ts", "value")
    max_rows = min(cells.MAX_ROWS, max(1, events.count() // 16))
    return lag_features(events, ["value"], LAGS, USER_ORDER, max_rows=max_rows)


def q_lag_features_by_value(spark, sf_dir):
    """The events as one hot series in the order of a text and a double, cut into cells by value."""
    events = events_of(spark, sf_dir, "event_id", "event_type", "value")
    max_rows = min(cells.MAX_ROWS, max(1, events.count() // 8))
    return lag_features(events, ["value"], LAGS, ["event_type", "value", "event_id"], max_rows=max_rows)


def q_drop_warmup(spark, sf_dir):
    return drop_warmup(
        events_of(spark, sf_dir, "user_id", "ts", "event_id"), LAGS, USER_ORDER, ["user_id"]
    )


# -- fits, predictions, scores -----------------------------------------------


def q_var_fit(spark, sf_dir):
    return rounded(fit_var(hourly_lags(hours(spark, sf_dir)), TARGETS, LAGS))


def q_var_fit_mllib(spark, sf_dir):
    return rounded(fit_var_mllib(hourly_lags(hours(spark, sf_dir)), TARGETS, LAGS))


def q_var_fit_wide(spark, sf_dir):
    """A model of the last 64 values over all events."""
    events = events_of(spark, sf_dir, "event_id", "ts", "value")
    return rounded(fit_var_wide(lag_features(events, ["value"], WIDE_LAGS, USER_ORDER), ["value"], WIDE_LAGS))


def q_var_fit_by_epoch(spark, sf_dir):
    lagged = lag_features(
        hours(spark, sf_dir), TARGETS, LAGS, [TIME], ["epoch_id"], max_rows=None
    )
    return rounded(fit_var(lagged, TARGETS, LAGS, ["epoch_id"]))


def q_var_fit_by_series(spark, sf_dir):
    lagged = q_lag_features_by_series(spark, sf_dir)
    return rounded(fit_var(lagged, ["value"], LAGS, ["user_id"]))


def q_var_coef_matrix(spark, sf_dir):
    return rounded(coef_matrix(fit_var(hourly_lags(hours(spark, sf_dir)), TARGETS, LAGS), TARGETS, LAGS))


def q_model_roundtrip(spark, sf_dir):
    path = fresh_dir(spark, "models")
    rows = hours(spark, sf_dir)
    everything = fit_var(hourly_lags(rows), TARGETS, LAGS)
    write_model(everything, path, "history")
    write_model(everything, path, "all")
    write_model(history_model(rows), path, "history")
    return rounded(read_model(spark, path, "history"))


def q_model_from_pipelines(spark, sf_dir):
    """Saved pipelines read as a coefficient table, that table saved as pipelines, and those read again."""
    fitted, again = fresh_dir(spark, "pipelines"), fresh_dir(spark, "pipelines")
    models, n_obs = fit_pipelines(hourly_lags(hours(spark, sf_dir)), TARGETS, LAGS)
    save_pipelines(models, fitted)
    table = read_pipelines(spark, TARGETS, LAGS, fitted)
    save_pipelines(pipelines_of(table, TARGETS, LAGS), again)
    return rounded(read_pipelines(spark, TARGETS, LAGS, again, n_obs))


def q_var_predict_loaded(spark, sf_dir):
    path = fresh_dir(spark, "models")
    rows = hours(spark, sf_dir)
    write_model(history_model(rows), path, "history")
    predicted = predict_var(
        hourly_lags(rows), TARGETS, LAGS, read_model(spark, path, "history")
    )
    return rounded(predicted.drop("epoch_id"))


def q_var_predict_epoch(spark, sf_dir):
    return rounded(speed_rows(hours(spark, sf_dir)))


def q_var_predict_by_series(spark, sf_dir):
    lagged = q_lag_features_by_series(spark, sf_dir)
    return rounded(predict_var(lagged, ["value"], LAGS, by=["user_id"]))


def in_sample(spark, sf_dir):
    return predict_var(hourly_lags(hours(spark, sf_dir)), TARGETS, LAGS)


def q_var_scores(spark, sf_dir):
    return rounded(score(in_sample(spark, sf_dir), TARGETS))


def q_var_scores_by_epoch(spark, sf_dir):
    return rounded(score(speed_rows(hours(spark, sf_dir)), TARGETS, ["epoch_id"]))


def q_var_scores_attached(spark, sf_dir):
    return rounded(scored(batch_rows(hours(spark, sf_dir))))


def q_var_residuals(spark, sf_dir):
    rows = residuals(in_sample(spark, sf_dir), TARGETS)
    return rounded(rows.select(TIME, "y1_resid", "y2_resid"))


def q_var_residual_cov(spark, sf_dir):
    return rounded(residual_cov(residuals(in_sample(spark, sf_dir), TARGETS), TARGETS, LAGS))


def q_merge_predictions(spark, sf_dir):
    stacked = stack_predictions(speed_rows(hours(spark, sf_dir)), TARGETS, [TIME])
    return rounded(merge_predictions(stacked, TARGETS, [TIME]))


# -- messages ----------------------------------------------------------------


def q_replay_encode(spark, sf_dir):
    events = events_of(spark, sf_dir, "event_id", "ts", "value", "user_id")
    values = events.withColumn("user_id", col("user_id").cast("double"))
    return encode(
        values, ["ts", "value", "user_id"], keep=["event_id"], quoted=True, digits=DIGITS
    )


def event_messages(spark, sf_dir):
    events = events_of(spark, sf_dir, "event_id", "event_type", "ts", "value", "user_id")
    return encode(events, ["ts", "value", "user_id"], keep=["event_id", "event_type"], quoted=True)


def q_decode_observations(spark, sf_dir):
    good, _ = decode(event_messages(spark, sf_dir), EVENT_FIELDS, keep=["event_id"])
    return good


def q_decode_time_pattern(spark, sf_dir):
    """Times read by a fixed pattern; those of purchases have another form and are rejected."""
    other = F.when(col("event_type") == "purchase", F.translate("value", "-", "/")).otherwise(col("value"))
    messages = event_messages(spark, sf_dir).withColumn("value", other)
    good, rejected = decode(messages, EVENT_FIELDS, keep=["event_id"], time_pattern=TIME_PATTERN)
    read = good.select("event_id", "ts", F.lit(None).cast("string").alias("bad_field"))
    return read.unionByName(rejected.select("event_id", "bad_field"), allowMissingColumns=True)


def spoilt_messages(spark, sf_dir):
    """Error events with an unreadable number, views cut after the time."""
    text = col("value")
    return event_messages(spark, sf_dir).withColumn(
        "value",
        F.when(col("event_type") == "error", F.regexp_replace(text, ",[^,]*,", ",oops,"))
        .when(col("event_type") == "view", F.substring_index(text, ",", 1))
        .otherwise(text),
    )


def q_decode_rejected(spark, sf_dir):
    _, rejected = decode(spoilt_messages(spark, sf_dir), EVENT_FIELDS, keep=["event_id"])
    return rejected.select("event_id", "bad_field", F.translate("value", '"', "").alias("value"))


def q_encode_predictions(spark, sf_dir):
    return prediction_messages(scored(batch_rows(hours(spark, sf_dir))), TARGETS, TIME, digits=DIGITS)


def q_decode_predictions(spark, sf_dir):
    messages = prediction_messages(scored(speed_rows(hours(spark, sf_dir))), TARGETS, TIME)
    return rounded(decode(messages, prediction_fields(TARGETS, TIME))[0])


def q_decode_predictions_short(spark, sf_dir):
    messages = prediction_messages(speed_rows(hours(spark, sf_dir)), TARGETS, TIME, rmse=False)
    fields = prediction_fields(TARGETS, TIME, prefix="SP_", rmse=False)
    return rounded(decode(messages, fields)[0])


def q_topic_demux(spark, sf_dir):
    """All events sent to a topic of their type; two topics read together and told apart again."""
    path = fresh_dir(spark, "messages")
    events = event_messages(spark, sf_dir)
    for kind in ("click", "purchase", "view", "signup", "error"):
        values = events.filter(col("event_type") == kind)
        write_messages(values, "parquet", {"path": path}, kind)
    messages = read_messages(spark, "parquet", {"path": path}, ["click", "purchase"])
    clicks, _ = decode(by_topic(messages, "click"), EVENT_FIELDS, keep=["topic"])
    purchases, _ = decode(by_topic(messages, "purchase"), EVENT_FIELDS, keep=["topic"])
    return clicks.unionByName(purchases)


# -- tables ------------------------------------------------------------------


def q_csv_roundtrip(spark, sf_dir):
    path = fresh_dir(spark, "csv")
    events = events_of(spark, sf_dir, "event_id", "ts", "event_type", "value")
    write_csv(events, path)
    return read_csv(spark, path, events.schema)


def q_master_append(spark, sf_dir):
    """Each event day is an epoch; all epochs are written twice and kept once."""
    path = fresh_dir(spark, "master")
    events = events_of(spark, sf_dir, "event_id", "ts", "value").filter(col("ts").isNotNull())
    epochs = with_epoch(events, "ts")
    append_epoch(epochs, path)
    append_epoch(epochs, path)
    return read_table(spark, path, ["event_id", "ts", "value", "epoch_id"])


def q_preview_latest(spark, sf_dir):
    events = events_of(spark, sf_dir, "event_id", "ts", "user_id", "value")
    return preview_latest(events, USER_ORDER, PREVIEW_ROWS)


def q_time_extent(spark, sf_dir):
    return time_extent(events_of(spark, sf_dir, "ts"), "ts")


# -- serving -----------------------------------------------------------------


def joined_rows(spark, sf_dir):
    rows = hours(spark, sf_dir)
    return serving_join(scored(speed_rows(rows)), scored(batch_rows(rows)), TARGETS, [TIME])


def q_serving_join(spark, sf_dir):
    return rounded(joined_rows(spark, sf_dir))


def q_serving_blend(spark, sf_dir):
    return blend(joined_rows(spark, sf_dir), TARGETS, [TIME], SPEED_WEIGHT, BATCH_WEIGHT)


def q_approach_scores(spark, sf_dir):
    blended = blend(
        joined_rows(spark, sf_dir), TARGETS, [TIME], SPEED_WEIGHT, BATCH_WEIGHT, digits=None
    )
    return rounded(compare_approaches(blended, TARGETS, APPROACHES))


# -- drift -------------------------------------------------------------------

LINE_VALUES = ["l_quantity", "l_extendedprice"]


def line_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_VALUES)


def q_drift_gradual(spark, sf_dir):
    return inject_gradual(line_values(spark, sf_dir), LINE_VALUES)


def q_drift_abrupt(spark, sf_dir):
    key = col("l_orderkey") * 8 + col("l_linenumber")
    return inject_abrupt(line_values(spark, sf_dir), LINE_VALUES, key, SEED)


def drift_scenarios(rows: DataFrame) -> DataFrame:
    """The hours without drift, and with either drift from the cut on."""
    late = F.expr(f"{TIME} >= TIMESTAMP_NTZ '{TRAIN_UNTIL}'")
    # Hours since 1970 identify the rows.
    key = F.expr(f"datediff(CAST({TIME} AS DATE), DATE '1970-01-01') * 24 + hour({TIME})")
    plain = rows.withColumn("step", F.lit(0))
    gradual = inject_gradual(rows, TARGETS, where=late)
    abrupt = inject_abrupt(rows, TARGETS, key, SEED, where=late)
    return (
        plain.withColumn("scenario", F.lit("none"))
        .unionByName(gradual.withColumn("scenario", F.lit("gradual")))
        .unionByName(abrupt.withColumn("scenario", F.lit("abrupt")))
    )


def q_approach_scores_drift(spark, sf_dir):
    rows = hours(spark, sf_dir)
    drifted = drift_scenarios(rows)
    order, by, keys = [TIME, "step"], ["scenario"], ["scenario", TIME, "step"]
    speed = speed_layer(drifted, TARGETS, LAGS, order, by, max_rows=None)
    batch = batch_layer(drifted, history_model(rows), TARGETS, LAGS, order, by, max_rows=None)
    joined = serving_join(speed, batch, TARGETS, keys)
    blended = blend(joined, TARGETS, keys, SPEED_WEIGHT, BATCH_WEIGHT, digits=None)
    return rounded(compare_approaches(blended, TARGETS, APPROACHES, by))


# -- whole layers ------------------------------------------------------------


def observation_messages(spark, sf_dir):
    return encode(hours(spark, sf_dir), [TIME, *TARGETS], quoted=True)


def observations(spark, sf_dir):
    good, _ = decode(observation_messages(spark, sf_dir), observation_fields(TARGETS, TIME))
    return with_epoch(good)


def q_layer_batch(spark, sf_dir):
    """Messages in, master table, stored model, prediction table out."""
    master, models, out = (fresh_dir(spark, x) for x in ("master", "models", "predictions"))
    append_epoch(observations(spark, sf_dir), master)
    write_model(history_model(hours(spark, sf_dir)), models, "history")
    predicted = batch_layer(
        read_table(spark, master, [TIME, *TARGETS, "epoch_id"]),
        read_model(spark, models, "history"),
        TARGETS,
        LAGS,
        [TIME],
        max_rows=None,
    )
    append_epoch(scored_rows(predicted, TARGETS, [TIME, "epoch_id"], ["epoch_id"]), out)
    return rounded(read_table(spark, out).drop("epoch_id"))


def q_layer_speed(spark, sf_dir):
    """Messages in, one fit per epoch, prediction table out."""
    out = fresh_dir(spark, "predictions")
    predicted = speed_layer(observations(spark, sf_dir), TARGETS, LAGS, [TIME], max_rows=None)
    append_epoch(scored_rows(predicted, TARGETS, [TIME, "epoch_id"], ["epoch_id"]), out)
    return rounded(read_table(spark, out).drop("epoch_id"))


def send_predictions(spark, sf_dir):
    """Both layers' prediction messages in one envelope table, two topics."""
    path = fresh_dir(spark, "messages")
    rows = hours(spark, sf_dir)
    for topic, layer in (("speed", speed_rows), ("batch", batch_rows)):
        values = prediction_messages(scored(layer(rows)), TARGETS, TIME)
        write_messages(values, "parquet", {"path": path}, topic)
    return path


def q_layer_serving(spark, sf_dir):
    """Prediction messages of both topics in, serving table out."""
    messages = read_messages(
        spark, "parquet", {"path": send_predictions(spark, sf_dir)}, ["speed", "batch"]
    )
    out = fresh_dir(spark, "serving")
    rows = serving_layer(messages, TARGETS, "speed", "batch", SPEED_WEIGHT, BATCH_WEIGHT)
    append_epoch(with_epoch(rows), out)
    return read_table(spark, out).drop("epoch_id")


# -- streams -----------------------------------------------------------------


def drained(query) -> None:
    """Wait for a run-once stream to finish, and raise what stopped it."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def q_stream_decode(spark, sf_dir):
    source, out, state = (fresh_dir(spark, x) for x in ("messages", "decoded", "checkpoint"))
    write_messages(event_messages(spark, sf_dir), "parquet", {"path": source}, "events")
    messages = stream_messages(spark, "parquet", {"path": source}, ["events"])
    drained(to_files(decode(messages, EVENT_FIELDS)[0], out, state))
    return read_table(spark, out, ["ts", "value", "user_id"])


#: The streams below take their source, which is in many files, this many files at a time.
FILES_PER_TRIGGER = {"maxFilesPerTrigger": "2"}


def in_files(values, path, topic, files=7):
    """Messages in several files, none of which is in the order of time."""
    write_messages(values.repartition(files), "parquet", {"path": path}, topic)


#: How far messages may come out of order; the queries' sources are shuffled by less.
DELAY = "6 hours"


def arrivals(spark, rows, time, values, closing, n=4):
    """``rows`` as messages in ``n`` files, one after the other, each row up to five hours out of order.

    Yields the path after every second file. Two days after the last row ``closing``, values by column, closes
    the stream: all others come out before it does, and it never comes out.
    """
    path = fresh_dir(spark, "messages")
    hour = F.expr(f"unix_timestamp(CAST({time} AS TIMESTAMP)) DIV 3600")
    first, last = rows.agg(F.min(hour), F.max(hour)).collect()[0]
    step = (last - first) // n + 1
    turn = F.least(F.floor((hour + hour * 7 % 5 - first) / step), F.lit(n - 1))
    end = rows.agg(F.expr(f"max({time}) + INTERVAL 2 DAYS AS {time}")).select(
        time, *[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in closing.items()]
    )
    placed = rows.unionByName(end).withColumn("__turn", turn).persist()
    for i in range(n):
        part = placed.filter(col("__turn") == i).orderBy(F.hash(time)).coalesce(1)
        write_messages(encode(part, values, quoted=True), "parquet", {"path": path}, "obs")
        if i % 2:
            yield path
    placed.unpersist()


def hourly_arrivals(spark, sf_dir):
    rows = hours(spark, sf_dir).select(TIME, *TARGETS)
    return arrivals(spark, rows, TIME, [TIME, *TARGETS], dict.fromkeys(TARGETS, 0.0))


def observed_stream(spark, path, targets=TARGETS, time=TIME, keys=()):
    messages = stream_messages(spark, "parquet", {"path": path, **FILES_PER_TRIGGER}, ["obs"])
    return decode(messages, observation_fields(targets, time, keys))[0]


def q_stream_speed(spark, sf_dir):
    """Lags within each day and each day's moments as streams, over arrivals out of order, micro-batches and a restart."""
    lags, fits, lag_state, fit_state = (fresh_dir(spark, x) for x in ("lags", "fits", "checkpoint", "checkpoint"))
    for path in hourly_arrivals(spark, sf_dir):
        observed = observed_stream(spark, path)
        drained(to_files(epoch_lags(observed, TARGETS, LAGS, [TIME], (), DELAY), lags, lag_state))
        schema = lagged_schema(observed, TARGETS, LAGS, [TIME])
        lagged = spark.readStream.schema(schema).parquet(lags)
        drained(to_files(epoch_fits(lagged, TARGETS, LAGS, TIME, (), DELAY), fits, fit_state))
    predicted = speed_predictions(spark.read.schema(schema).parquet(lags), read_table(spark, fits), TARGETS, LAGS)
    return rounded(scored_rows(predicted, TARGETS, [TIME], ["epoch_id"]))


def batch_stream(spark, sf_dir, lags_of):
    """The batch layer as one streaming plan: decode, lags from state, the stored model, a table."""
    models, out, state = (fresh_dir(spark, x) for x in ("models", "predictions", "checkpoint"))
    write_model(history_model(hours(spark, sf_dir)), models, "history")
    for path in hourly_arrivals(spark, sf_dir):
        lagged = lags_of(observed_stream(spark, path)).filter("NOT late")
        model = read_model(spark, models, "history")
        drained(to_files(predict_var(lagged, TARGETS, LAGS, model).drop("late"), out, state))
    return rounded(read_table(spark, out).select(TIME, *[c for t in TARGETS for c in (t, predict_name(t))]))


def q_stream_batch(spark, sf_dir):
    """The batch layer as a stream, with lags within their epoch."""
    return batch_stream(spark, sf_dir, lambda rows: epoch_lags(rows, TARGETS, LAGS, [TIME], (), DELAY))


def q_stream_batch_continuous(spark, sf_dir):
    """The batch layer as a stream, with lags that go on from epoch to epoch."""
    return batch_stream(spark, sf_dir, lambda rows: stream_lags(rows, TARGETS, LAGS, [TIME], (), DELAY))


def q_stream_rejected(spark, sf_dir):
    """The messages of a stream that cannot be read, landed beside it."""
    source, out, state = (fresh_dir(spark, x) for x in ("messages", "rejected", "checkpoint"))
    in_files(spoilt_messages(spark, sf_dir), source, "events")
    messages = stream_messages(spark, "parquet", {"path": source, **FILES_PER_TRIGGER}, ["events"])
    drained(land_rejected(messages, EVENT_FIELDS, out, state))
    return read_table(spark, out).select("bad_field", F.translate("value", '"', "").alias("value"))


def q_serving_join_stream(spark, sf_dir):
    source = send_predictions(spark, sf_dir)
    out, state = fresh_dir(spark, "serving"), fresh_dir(spark, "checkpoint")
    messages = stream_messages(spark, "parquet", {"path": source}, ["speed", "batch"])
    # The source ends, so predictions may wait for their partner without a limit.
    blended = serving_stream(
        messages, TARGETS, "speed", "batch", SPEED_WEIGHT, BATCH_WEIGHT, delay=None
    )
    drained(to_files(blended, out, state))
    return read_table(spark, out)


def q_serving_unmatched_stream(spark, sf_dir):
    """Both layers' predictions with gaps, hours apart, over micro-batches and a restart: pairs and those left alone."""
    source, out, state = (fresh_dir(spark, x) for x in ("messages", "serving", "checkpoint"))
    rows = hours(spark, sf_dir)
    sides = {"speed": scored(speed_rows(rows)).filter(f"hour({TIME}) % 7 <> 3"), "batch": scored(batch_rows(rows)).filter(f"hour({TIME}) % 11 <> 5")}
    # Two days later each layer predicts something else; these wait for ever.
    for i, (topic, predicted) in enumerate(sides.items()):
        kinds = {f.name: f.dataType for f in predicted.schema.fields}
        end = predicted.agg(F.expr(f"max({TIME}) + INTERVAL 2 DAYS AS {TIME}")).select(
            TIME, *[F.lit(-1.0 - i).cast(t).alias(c) for c, t in kinds.items() if c != TIME]
        )
        sides[topic] = predicted.unionByName(end).persist()
    for turn in range(3):
        for hours_later, (topic, predicted) in enumerate(sides.items()):
            # Days 0-9, 10-19 and 20 on of the month; the batch layer's messages come four hours later.
            day = F.expr(f"least((dayofmonth({TIME} + INTERVAL {4 * hours_later} HOURS) - 1) DIV 10, 2)")
            late = F.when(col(TIME) > F.lit("2024-01-31").cast("timestamp_ntz"), 2).otherwise(day)
            part = predicted.filter(late == turn)
            write_messages(prediction_messages(part, TARGETS, TIME).coalesce(1), "parquet", {"path": source}, topic)
        if turn:
            messages = stream_messages(spark, "parquet", {"path": source, **FILES_PER_TRIGGER}, ["speed", "batch"])
            joined = serving_stream(
                messages, TARGETS, "speed", "batch", SPEED_WEIGHT, BATCH_WEIGHT, DELAY, unmatched=True
            )
            drained(to_files(joined, out, state))
    for predicted in sides.values():
        predicted.unpersist()
    return read_table(spark, out)


def q_stream_replayed(spark, sf_dir):
    """Prediction messages of which every third day's are sent again, read once over micro-batches and a restart."""
    source, out, state = (fresh_dir(spark, x) for x in ("messages", "decoded", "checkpoint"))
    rows = scored_rows(speed_rows(hours(spark, sf_dir)), TARGETS, [TIME], ["epoch_id"])
    fields = prediction_fields(TARGETS, TIME)
    values = with_message_ids(encode(rows, [f for f, _ in fields]), F.to_date(F.substring("value", 1, 10))).persist()
    again = values.filter("dayofmonth(to_date(substring(value, 1, 10))) % 3 = 0")
    for sent in (values, again, again):
        write_messages(sent.repartition(2), "parquet", {"path": source}, "speed")
        if sent is again:
            messages = stream_messages(spark, "parquet", {"path": source, **FILES_PER_TRIGGER}, ["speed"])
            drained(to_files(decode(once(messages, "1 hour"), fields)[0], out, state))
    values.unpersist()
    return rounded(read_table(spark, out))


def q_csv_rejected(spark, sf_dir):
    """CSV lines of which some have a bad number, too few fields or too many: good ones, and rejects as they are."""
    path = fresh_dir(spark, "lines")
    time = F.date_format(TIME, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    kind = F.expr(f"hour({TIME}) % 6")
    line = (
        F.when(kind == 1, F.concat(time, F.lit(",oops,1")))
        .when(kind == 2, time)
        .when(kind == 3, F.concat(time, F.lit(",1,2,3")))
        .otherwise(F.concat_ws(",", time, *TARGETS))
    )
    hours(spark, sf_dir).select(line).write.text(path)
    schema = T.StructType([T.StructField(TIME, T.TimestampNTZType()), *[T.StructField(t, T.DoubleType()) for t in TARGETS]])
    good, rejected = read_csv_lines(spark, path, schema, header=False)
    return rounded(good.unionByName(rejected, allowMissingColumns=True))


def q_stream_lag_continuous(spark, sf_dir):
    """Lags of all users' events with state, over arrivals out of order, micro-batches and a restart."""
    out, state = fresh_dir(spark, "lags"), fresh_dir(spark, "checkpoint")
    events = events_of(spark, sf_dir, "ts", "event_id", "user_id", "value")
    keys = [("event_id", "bigint"), ("user_id", "bigint")]
    closing = {"event_id": -1, "user_id": -1, "value": 0.0}
    for path in arrivals(spark, events, "ts", ["ts", "event_id", "user_id", "value"], closing):
        observed = observed_stream(spark, path, ["value"], "ts", keys)
        drained(to_files(stream_lags(observed, ["value"], LAGS, USER_ORDER, ["user_id"], DELAY), out, state))
    return read_table(spark, out).filter("NOT late").drop("late")


# -- odd readings, other sources ---------------------------------------------


def q_var_scores_nonfinite(spark, sf_dir):
    """In-sample scores where every seventh reading of the first target is NaN."""
    hour = F.expr(f"hour({TIME})")
    spoilt = hours(spark, sf_dir).withColumn("y1", F.when(hour % 7 == 3, F.lit(float("nan"))).otherwise(col("y1")))
    return rounded(score(predict_var(hourly_lags(spoilt), TARGETS, LAGS), TARGETS))


def q_var_fit_constant(spark, sf_dir):
    """A fit where one target is stuck at a value."""
    stuck = hours(spark, sf_dir).withColumn("y2", F.lit(5.0))
    return rounded(fit_var(hourly_lags(stuck), TARGETS, LAGS))


def q_var_predict_collinear(spark, sf_dir):
    """Predictions where one target repeats another and one is the sum of two."""
    rows = hours(spark, sf_dir).withColumn("y3", col("y1")).withColumn("y4", col("y1") + col("y2"))
    targets = [*TARGETS, "y3", "y4"]
    predicted = predict_var(lag_features(rows, targets, LAGS, [TIME], max_rows=None), targets, LAGS)
    return rounded(predicted.select(TIME, *[predict_name(t) for t in targets]))


def q_train_from_csv(spark, sf_dir):
    """A model from CSV files without a time column: lags in file order, targets discovered."""
    path, models = fresh_dir(spark, "csv"), fresh_dir(spark, "models")
    write_csv(hours(spark, sf_dir).select(TIME, *TARGETS).repartitionByRange(3, TIME).sortWithinPartitions(TIME).select(*TARGETS), path)
    rows = with_file_order(read_csv(spark, path, "y1 double, y2 double"))
    found = target_columns(rows.columns, "row")
    write_model(fit_var(lag_features(rows, found, LAGS, ["row"], max_rows=None), found, LAGS), models, "csv")
    return rounded(read_model(spark, models, "csv"))


def q_drift_file_roundtrip(spark, sf_dir):
    """Drifted values written as files without a header, and read again."""
    path = fresh_dir(spark, "drift")
    write_csv(inject_gradual(line_values(spark, sf_dir), LINE_VALUES), path, header=False)
    return spark.read.schema("l_orderkey bigint, l_linenumber int, step int, l_quantity double, l_extendedprice double").csv(path)


SERIES_KEYS = [("event_id", "bigint"), ("user_id", "bigint")]


def q_layer_serving_by_series(spark, sf_dir):
    """Both layers' prediction messages of every user's events, joined by series and event."""
    path = fresh_dir(spark, "messages")
    lagged = q_lag_features_by_series(spark, sf_dir)
    speed = predict_var(lagged, ["value"], LAGS, by=["user_id"])
    batch = predict_var(lagged, ["value"], LAGS, fit_var(lagged, ["value"], LAGS))
    for topic, rows in (("speed", speed), ("batch", batch)):
        scored_ones = attach_scores(rows, ["value"], ["user_id"])
        values = prediction_messages(scored_ones, ["value"], "ts", keys=SERIES_KEYS)
        write_messages(values, "parquet", {"path": path}, topic)
    messages = read_messages(spark, "parquet", {"path": path}, ["speed", "batch"])
    served = serving_layer(messages, ["value"], "speed", "batch", SPEED_WEIGHT, BATCH_WEIGHT, "ts", None, keys=SERIES_KEYS)
    return rounded(served.drop("Speed_RMSE", "Batch_RMSE"))


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): fn for name, fn in list(globals().items()) if name.startswith("q_")
}
