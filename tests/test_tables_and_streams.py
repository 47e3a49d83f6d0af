"""Tables written by epoch, message sources, and the layers on streams.

``start_layer`` is not run here: ``foreachBatch`` opens a callback port. Its
handlers are called on plain DataFrames, as a micro-batch would call them.
"""

import datetime as dt
import random
import time

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tidecast.functions.codec import decode, encode, observation_fields, prediction_fields
from tidecast.operators.fit import fit_var
from tidecast.operators.lags import lag_features
from tidecast.operators.predict import predict_var
from tidecast.plans.layers import scored_rows, speed_layer
from tidecast.plans.series import with_epoch
from tidecast.sources.messages import ENVELOPE, once, read_messages, stream_messages, with_message_ids, write_messages
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
from tidecast.streaming.layers import (
    Sinks,
    batch_handler,
    land_observations,
    land_rejected,
    landed,
    serving_handler,
    speed_handler,
    to_files,
)
from tidecast.streaming.serving import serving_stream
from tidecast.streaming.speed import epoch_fits, epoch_lags, lagged_schema, speed_predictions

TARGETS = ["y1", "y2"]
SCHEMA = "TS timestamp_ntz, y1 double, y2 double"


def rows(n, start=dt.datetime(2024, 1, 1), seed=0):
    rng = random.Random(seed)
    return [
        (start + dt.timedelta(minutes=i), round(rng.gauss(0, 3), 4), round(rng.gauss(5, 1), 4))
        for i in range(n)
    ]


@pytest.fixture
def observed(spark):
    return spark.createDataFrame(rows(60), SCHEMA)


def messages_of(df):
    return encode(df, ["TS", *TARGETS], quoted=True)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_epoch_written_twice_counts_once(spark, observed):
    path = fresh_dir(spark, "t")
    append_epoch(observed, path, 1)
    append_epoch(observed.limit(5), path, 2)
    append_epoch(observed.limit(3), path, 2)
    counts = {r["epoch_id"]: r["count"] for r in read_table(spark, path).groupBy("epoch_id").count().collect()}
    assert counts == {1: 60, 2: 3}


def test_models_are_replaced_one_by_one(spark, observed):
    lagged = lag_features(observed, TARGETS, 2, ["TS"])
    first, second = fit_var(lagged, TARGETS, 2), fit_var(lagged.filter("y1 > 0"), TARGETS, 2)
    path = fresh_dir(spark, "m")
    write_model(first, path, "a")
    write_model(first, path, "b")
    write_model(second, path, "a")
    assert same_rows(read_model(spark, path, "a"), second)
    assert same_rows(read_model(spark, path, "b"), first)
    assert "PartitionFilters: [isnotnull(model_id" in read_model(spark, path, "a")._jdf.queryExecution().toString()


def test_csv_with_and_without_schema(spark, observed):
    path = fresh_dir(spark, "c")
    write_csv(observed, path)
    assert same_rows(read_csv(spark, path, observed.schema), observed)
    inferred = read_csv(spark, path)
    assert [t for _, t in inferred.dtypes][1:] == ["double", "double"]
    assert same_rows(inferred.select(TARGETS), observed.select(TARGETS))


def test_file_messages_have_the_envelope(spark, observed):
    path = fresh_dir(spark, "f")
    write_messages(messages_of(observed), "parquet", {"path": path}, "a")
    write_messages(messages_of(observed.limit(4)), "parquet", {"path": path}, "b")
    assert {f.name for f in ENVELOPE} == set(spark.read.parquet(path).columns)
    assert read_messages(spark, "parquet", {"path": path}, ["b"]).count() == 4
    assert read_messages(spark, "parquet", {"path": path}).count() == 64


def test_batch_handler(spark, observed):
    model = fit_var(lag_features(observed, TARGETS, 2, ["TS"]), TARGETS, 2).persist()
    sinks = Sinks(
        predictions=fresh_dir(spark, "p"), master=fresh_dir(spark, "ma"), rejects=fresh_dir(spark, "r"),
        topic="batch", message_format="parquet", message_options={"path": fresh_dir(spark, "s")},
    )
    handle = batch_handler(model, TARGETS, 2, sinks)
    bad = spark.createDataFrame([("nonsense",)], "value string")
    handle(messages_of(observed).unionByName(bad), 0)
    handle(messages_of(observed.limit(10)), 1)
    handle(messages_of(observed.limit(10)), 1)
    handle(messages_of(observed.limit(0)), 2)
    out = read_table(spark, sinks.predictions)
    assert out.filter("epoch_id = 0").count() == 58
    assert out.filter("epoch_id = 1").count() == 8
    assert read_table(spark, sinks.master).count() == 70
    assert [r["value"] for r in read_table(spark, sinks.rejects).collect()] == ["nonsense"]
    expected = scored_rows(
        predict_var(lag_features(observed, TARGETS, 2, ["TS"]), TARGETS, 2, model), TARGETS, ["TS"], []
    )
    assert same_rows(out.filter("epoch_id = 0").drop("epoch_id"), expected)
    sent = read_messages(spark, "parquet", sinks.message_options, ["batch"])
    decoded, rejected = decode(sent, prediction_fields(TARGETS))
    assert rejected.isEmpty() and decoded.count() == 58 + 8 + 8


def test_continuous_handler_goes_on_over_epochs(spark, observed):
    model = fit_var(lag_features(observed, TARGETS, 2, ["TS"]), TARGETS, 2).persist()
    sinks = Sinks(
        predictions=fresh_dir(spark, "p"), tail=fresh_dir(spark, "t"), rejects=fresh_dir(spark, "r")
    )
    handle = batch_handler(model, TARGETS, 2, sinks)
    parts = [observed.filter("minute(TS) < 20"), observed.limit(0), observed.filter("minute(TS) >= 20")]
    for epoch, part in enumerate(parts):
        handle(messages_of(part), epoch)
    handle(messages_of(parts[2]), 2)  # replayed after a failure
    handle(messages_of(observed.filter("minute(TS) = 7")), 3)  # comes late
    whole = predict_var(lag_features(observed, TARGETS, 2, ["TS"]), TARGETS, 2, model)
    got = read_table(spark, sinks.predictions, ["TS", *TARGETS, "y1_Predict", "y2_Predict"])
    assert same_rows(got, whole)
    late = read_table(spark, sinks.rejects).filter("epoch_id = 3").collect()
    assert [r["bad_field"] for r in late] == ["late"]


def test_speed_and_serving_handlers(spark, observed):
    box = {"path": fresh_dir(spark, "box")}
    for topic, maker in (
        ("speed", lambda s: speed_handler(TARGETS, 2, s)),
        ("batch", lambda s: speed_handler(TARGETS, 2, s)),
    ):
        maker(Sinks(topic=topic, message_format="parquet", message_options=box))(messages_of(observed), 0)
    out = Sinks(predictions=fresh_dir(spark, "out"))
    handle = serving_handler(TARGETS, "speed", "batch", 0.25, 0.75, out)
    handle(read_messages(spark, "parquet", box), 0)
    served = read_table(spark, out.predictions)
    assert served.count() == 58
    # Both topics hold the same predictions here, so the blend is that prediction.
    assert served.filter("abs(Wt_y1 - Speed_y1) > 0.0011 OR Speed_y1 <> Batch_y1").isEmpty()


def test_landing_goes_on_from_checkpoint(spark, observed):
    box, path, state = (fresh_dir(spark, x) for x in ("box", "landed", "cp"))

    def arrive(df):
        write_messages(messages_of(df), "parquet", {"path": box}, "obs")
        messages = stream_messages(spark, "parquet", {"path": box}, ["obs"])
        run(land_observations(messages, TARGETS, path, state))

    arrive(observed.filter("minute(TS) < 30"))
    arrive(observed.filter("minute(TS) >= 30"))
    assert same_rows(landed(spark, path, TARGETS).drop("epoch_id"), observed)
    speed = speed_layer(landed(spark, path, TARGETS), TARGETS, 2, ["TS"])
    assert speed.count() == 58


@pytest.mark.parametrize("n_targets", [1, 2])
def test_stream_lags_equal_batch(spark, n_targets):
    """Shuffled arrivals, ties, nulls, short series; the last arrival is late."""
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = [
        (
            start + dt.timedelta(hours=i // 40, seconds=rng.choice([0, 0, 5])),
            i,
            rng.choice(["a", "b", "c"]) if i else "single",
            None if i % 17 == 3 else float(i),
            float(-i),
        )
        for i in range(200)
    ]
    schema = "ts timestamp_ntz, id bigint, k string, y1 double, y2 double"
    targets = TARGETS[:n_targets]
    df = spark.createDataFrame(data, schema).select("ts", "id", "k", *targets)
    box, path, state = (fresh_dir(spark, x) for x in ("box", "lags", "cp"))
    late = df.filter("id = 41")
    for hours in ([0], [1, 2], [3, 4], None):
        part = df.filter(F.hour("ts").isin(hours)) if hours else late
        part.orderBy(F.rand(1)).write.mode("append").parquet(box)
        stream = spark.readStream.schema(df.schema).parquet(box)
        run(to_files(stream_lags(stream, targets, 3, ["ts", "id"], ["k"]), path, state))
    out = read_table(spark, path)
    expected = lag_features(df, targets, 3, ["ts", "id"], ["k"])
    assert same_rows(out.filter("NOT late").drop("late"), expected)
    behind = out.filter("late").collect()
    assert [r["id"] for r in behind] == [41]
    assert behind[0]["y1_l1"] is None


def test_many_series_share_few_states(spark):
    """Series of a shard stay apart: null keys, integers that no float holds, dates; rows that wait, a restart."""
    start, big = dt.datetime(2024, 1, 1), (1 << 60) + 1
    keys = [(n, d) for n in (None, 0, big, big + 1, *range(2, 40)) for d in (None, dt.date(2024, 1, 1))]
    data = [(start + dt.timedelta(hours=h), *key, float(1000 * i + h)) for i, key in enumerate(keys) for h in range(i % 3, 12)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, n bigint, d date, y double")
    box, path, state = (fresh_dir(spark, x) for x in ("box", "lags", "cp"))
    end = spark.createDataFrame([(start + dt.timedelta(days=3), -1, None, 0.0)], df.schema)
    for part in (df.filter("hour(ts) % 8 < 5"), df.filter("hour(ts) % 8 >= 5"), end):
        part.orderBy(F.rand(1)).coalesce(2).write.mode("append").parquet(box)
        stream = spark.readStream.schema(df.schema).parquet(box)
        query = to_files(stream_lags(stream, ["y"], 2, ["ts"], ["n", "d"], "10 hours", shards=5), path, state)
        run(query)
        states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        assert max(states) <= 5
    out = read_table(spark, path)
    assert same_rows(out.drop("late"), lag_features(df, ["y"], 2, ["ts"], ["n", "d"])) and out.filter("late").count() == 0


def test_serving_stream_joins_over_batches(spark):
    """The two predictions of a time come in different micro-batches."""
    schema = "TS timestamp_ntz, y double, y_Predict double, RMSE_Score double"
    data = [(t, a, a + 1, 0.5) for t, a, _ in rows(30)]
    df = spark.createDataFrame(data, schema)
    box, path, state = (fresh_dir(spark, x) for x in ("box", "served", "cp"))
    for topic in ("speed", "batch"):
        values = encode(df, ["TS", "y", "y_Predict", "RMSE_Score"])
        write_messages(values, "parquet", {"path": box}, topic)
        messages = stream_messages(spark, "parquet", {"path": box}, ["speed", "batch"])
        blended = serving_stream(messages, ["y"], "speed", "batch", 0.5, 0.5, delay="1 hour")
        run(to_files(blended, path, state))
    out = read_table(spark, path)
    assert out.count() == 30
    assert out.filter("abs(Wt_y - Speed_y) > 0.0011").isEmpty()


def test_observation_fields():
    assert observation_fields(["a"]) == [("TS", "timestamp_ntz"), ("a", "double")]


def test_unknown_models_are_refused(spark, observed):
    path = fresh_dir(spark, "m")
    write_model(fit_var(lag_features(observed, TARGETS, 2, ["TS"]), TARGETS, 2), path, "a")
    with pytest.raises(ValueError, match="no model 'b'"):
        read_model(spark, path, "b")


def test_first_epoch_without_a_usable_row(spark, observed):
    """The tail of an epoch that left no row is empty, not an error."""
    model = fit_var(lag_features(observed, TARGETS, 2, ["TS"]), TARGETS, 2).persist()
    sinks = Sinks(**{x: fresh_dir(spark, x) for x in ("predictions", "tail", "rejects")})
    handle = batch_handler(model, TARGETS, 2, sinks)
    handle(spark.createDataFrame([("nonsense",)], "value string"), 0)
    handle(messages_of(observed), 1)
    assert read_table(spark, sinks.predictions).count() == 58
    assert [r["value"] for r in read_table(spark, sinks.rejects).collect()] == ["nonsense"]


def test_equal_stamps_at_the_edge_of_a_micro_batch(spark):
    """Partition and offset order messages of one time, so none is late for its tie."""
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(seconds=i // 4), 1.0 + i % 3, 0, i) for i in range(40)]
    df = spark.createDataFrame(data, "TS timestamp_ntz, y double, partition int, offset bigint")
    model = fit_var(lag_features(df, ["y"], 2, ["offset"]), ["y"], 2).persist()
    sinks = Sinks(**{x: fresh_dir(spark, x) for x in ("predictions", "tail", "rejects")})
    handle = batch_handler(model, ["y"], 2, sinks)
    values = encode(df, ["TS", "y"], keep=["partition", "offset"], quoted=True)
    for epoch, part in enumerate(("offset < 22", "offset >= 22")):
        handle(values.filter(part), epoch)
    assert read_table(spark, sinks.predictions).count() == 38
    # No epoch left a reject, so no file either.
    assert spark.read.schema("value string, bad_field string").parquet(sinks.rejects).isEmpty()


def hourly(n, skip=()):
    start = dt.datetime(2024, 1, 1)
    return [(start + dt.timedelta(hours=i), float(i * i % 17), float(-i)) for i in range(n) if i not in skip]


@pytest.mark.parametrize("files_per_trigger", ["1", "3", "100"])
def test_lags_out_of_order_do_not_depend_on_micro_batches(spark, files_per_trigger):
    """Rows in = rows out + warm-up + late + rejected + dropped + waiting, however the source is cut."""
    rng = random.Random(int(files_per_trigger))
    on_time = sorted(hourly(90, skip=(20, 30, 31)), key=lambda r: r[0] + dt.timedelta(hours=rng.random() * 3))
    box, path, state, refused, refused_state = (fresh_dir(spark, x) for x in "abcde")

    def arrive(rows, bad=()):
        values = messages_of(spark.createDataFrame(rows, SCHEMA))
        values = values.unionByName(spark.createDataFrame([(b,) for b in bad], "value string"))
        write_messages(values.coalesce(1), "parquet", {"path": box}, "obs")

    def go_on():
        messages = stream_messages(spark, "parquet", {"path": box, "maxFilesPerTrigger": files_per_trigger}, ["obs"])
        good, _ = decode(messages, observation_fields(TARGETS))
        query = to_files(stream_lags(good, TARGETS, 2, ["TS"], (), "4 hours", grace="1 day"), path, state)
        run(query)
        run(land_rejected(messages, observation_fields(TARGETS), refused, refused_state))
        return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

    for i in range(0, 60, 20):
        arrive(on_time[i : i + 20], bad=["nonsense"] if i else ["2024-01-01 00:00:00,x,1"])
    assert go_on() == 0
    arrive(on_time[60:])
    assert go_on() == 0  # a restart
    # An hour that is too late by less than the grace, and two that are too late by more.
    arrive([r for r in hourly(90) if r[0].hour == 20 and r[0].day == 1 or r[0].hour in (6, 7) and r[0].day == 2])
    dropped = go_on()
    far = dt.datetime(2024, 1, 20)
    arrive([(far, 0.0, 0.0)])
    assert go_on() == 0
    out = read_table(spark, path).persist()
    late = out.filter("late").count()
    assert late + dropped == 3 and dropped >= 1 and read_table(spark, refused).count() == 3
    expected = lag_features(spark.createDataFrame(hourly(90, skip=(20, 30, 31)), SCHEMA), TARGETS, 2, ["TS"])
    assert same_rows(out.filter("NOT late").drop("late"), expected)
    out.unpersist()


def test_quiet_series_are_forgotten(spark):
    start = dt.datetime(2024, 1, 1)
    at = lambda h: start + dt.timedelta(hours=h)
    box, path, state = (fresh_dir(spark, x) for x in "abc")
    arrivals = [
        [("a", at(0), 1.0), ("a", at(1), 2.0), ("b", at(0), 1.0), ("b", at(1), 2.0)],
        [("a", at(40), 3.0)],  # b is quiet for longer than a day
        [("a", at(60), 4.0)],
        [("a", at(61), 5.0), ("b", at(61), 6.0), ("b", at(62), 7.0)],
        [("c", at(100), 0.0)],
    ]
    for part in arrivals:
        spark.createDataFrame(part, "k string, ts timestamp_ntz, y double").coalesce(1).write.mode("append").parquet(box)
        stream = spark.readStream.schema("k string, ts timestamp_ntz, y double").parquet(box)
        run(to_files(stream_lags(stream, ["y"], 1, ["ts"], ["k"], "1 hour", "0 seconds", idle="45 hours"), path, state))
    got = sorted((r["k"], r["y"], r["y_l1"]) for r in read_table(spark, path).filter("NOT late").collect())
    # For b the lag at 61 is gone with its state, and it starts anew.
    assert got == [("a", 2.0, 1.0), ("a", 3.0, 2.0), ("a", 4.0, 3.0), ("a", 5.0, 4.0), ("b", 2.0, 1.0), ("b", 7.0, 6.0)]


def test_epoch_fits_are_those_of_the_batch(spark):
    """Moments that merge over micro-batches and a restart give each closed epoch's model once."""
    data = hourly(96)
    rows = spark.createDataFrame([(f"s{j}", *r) for j in range(2) for r in data], f"k string, {SCHEMA}")
    box, lags, fits, lag_state, fit_state = (fresh_dir(spark, x) for x in "abcde")
    for day in range(5):
        part = rows.filter(F.dayofmonth("TS") == day + 1) if day < 4 else rows.limit(1).withColumn("TS", F.lit("2024-01-09").cast("timestamp_ntz"))
        part.orderBy(F.hash("TS")).coalesce(1).write.mode("append").parquet(box)
        stream = spark.readStream.schema(rows.schema).parquet(box)
        run(to_files(epoch_lags(stream, TARGETS, 2, ["TS"], ["k"], "2 hours"), lags, lag_state))
        schema = lagged_schema(rows, TARGETS, 2, ["TS"], ["k"])
        lagged = spark.readStream.schema(schema).parquet(lags)
        run(to_files(epoch_fits(lagged, TARGETS, 2, "TS", ["k"], "2 hours"), fits, fit_state))
    models = read_table(spark, fits)
    assert models.count() == models.select("k", "epoch_id").distinct().count() == 6  # the fourth day is open
    got = speed_predictions(spark.read.schema(schema).parquet(lags), models, TARGETS, 2, ["k"])
    expected = speed_layer(with_epoch(rows), TARGETS, 2, ["TS"], ["k"])
    digits = [F.round(c, 6).alias(c) for c in ("y1_Predict", "y2_Predict")]
    assert expected.count() == 2 * 4 * 22
    assert same_rows(got.select("k", "TS", "epoch_id", *digits), expected.select("k", "TS", "epoch_id", *digits))


def test_lone_predictions_come_out(spark):
    """Served + unmatched + dropped = all predictions, in a join whose state is let go."""
    schema = "TS timestamp_ntz, y double, y_Predict double, RMSE_Score double"
    data = [(t, a, a + 1, 0.5) for t, a, _ in hourly(48)]
    end = (dt.datetime(2024, 1, 20), 0.0, 0.0, 0.5)
    box, path, state = (fresh_dir(spark, x) for x in ("box", "served", "cp"))
    steps = [
        ("speed", data[:24]), ("batch", data[:20]), ("speed", data[24:40]), ("batch", data[24:48]),
        ("speed", [end]), ("batch", [(end[0], 1.0, 0.0, 0.5)]), ("batch", data[20:22]),
    ]
    dropped = 0
    for i, (topic, part) in enumerate(steps):
        values = encode(spark.createDataFrame(part, schema).coalesce(1), ["TS", "y", "y_Predict", "RMSE_Score"])
        write_messages(values, "parquet", {"path": box}, topic)
        if i not in (1, 3, 5, 6):
            continue
        messages = stream_messages(spark, "parquet", {"path": box}, ["speed", "batch"])
        query = to_files(serving_stream(messages, ["y"], "speed", "batch", 0.5, 0.5, "3 hours", unmatched=True), path, state)
        run(query)
        dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    counts = {r["missing"]: r["count"] for r in read_table(spark, path).groupBy("missing").count().collect()}
    assert counts == {None: 36, "batch": 4, "speed": 8} and dropped == 2
    assert read_table(spark, path).filter("missing IS NOT NULL AND Wt_y IS NOT NULL").isEmpty()
    with pytest.raises(ValueError, match="delay"):
        serving_stream(messages, ["y"], "speed", "batch", 0.5, 0.5, None, unmatched=True)


def test_streams_run_on_a_trigger(spark, observed):
    """Micro-batches on a timer until the query is stopped."""
    box, path, state = (fresh_dir(spark, x) for x in ("box", "landed", "cp"))
    write_messages(messages_of(observed.filter("minute(TS) < 30")), "parquet", {"path": box}, "obs")
    messages = stream_messages(spark, "parquet", {"path": box}, ["obs"])
    query = land_observations(messages, TARGETS, path, state, interval="200 milliseconds")

    def wait_for(n):
        until = time.time() + 60
        while time.time() < until and query.exception() is None:
            if sum(p["numInputRows"] for p in query.recentProgress) >= n:
                return
            time.sleep(0.1)
        raise AssertionError(query.exception() or "no micro-batch")

    wait_for(30)
    write_messages(messages_of(observed.filter("minute(TS) >= 30")), "parquet", {"path": box}, "obs")
    wait_for(60)
    query.stop()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) >= 2
    assert same_rows(landed(spark, path, TARGETS).drop("epoch_id"), observed)


def test_messages_sent_twice_are_read_once(spark, observed):
    """Ids do not depend on the order of rows; equal texts stay apart; messages without a key are kept."""
    values = messages_of(observed.limit(5).unionByName(observed.limit(2)))
    first = with_message_ids(values, F.lit(3))
    second = with_message_ids(values.orderBy(F.desc("value")).repartition(3), F.lit(3))
    assert same_rows(first, second) and first.select("key").distinct().count() == 7
    box = fresh_dir(spark, "box")
    for sent in (first, second, with_message_ids(values, F.lit(4)), values, values):
        write_messages(sent, "parquet", {"path": box}, "a")
    write_messages(first, "parquet", {"path": box}, "b")
    got = once(read_messages(spark, "parquet", {"path": box}), "1 hour")
    assert got.count() == 7 + 7 + 14 + 7


def test_csv_lines_that_do_not_fit(spark, tmp_path):
    lines = ["a,b", "1,2.5", "x,1", "2", "3,4,5", ",", "7,8"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    good, rejected = read_csv_lines(spark, str(tmp_path), spark.createDataFrame([], "a int, b double").schema)
    assert sorted((r["a"] or 0, r["b"] or 0.0) for r in good.collect()) == [(0, 0.0), (1, 2.5), (7, 8.0)]
    assert sorted(r["line"] for r in rejected.collect()) == ["2", "3,4,5", "x,1"]
    # Whichever columns are asked for, the same lines are bad.
    assert good.select("b").count() == 3 and good.count() == 3 and rejected.count() == 3


def test_tied_times_are_served_once_each(spark):
    """Three readings a second: joined on time alone each would meet all three."""
    from tidecast.plans.layers import serving_layer

    data = [(t.replace(second=0), float(i), float(i) + 1, 0.5) for i, (t, *_) in enumerate(rows(4) * 3)]
    df = spark.createDataFrame(data, "TS timestamp_ntz, y double, y_Predict double, RMSE_Score double")
    box = fresh_dir(spark, "box")
    for topic in ("speed", "batch"):
        write_messages(encode(df, ["TS", "y", "y_Predict", "RMSE_Score"]), "parquet", {"path": box}, topic)
    messages = read_messages(spark, "parquet", {"path": box})
    assert serving_layer(messages, ["y"], "speed", "batch", 0.5, 0.5).count() == 12
    assert serving_layer(messages, ["y"], "speed", "batch", 0.5, 0.5, on=["TS"]).count() == 36


def test_file_order(spark, observed):
    path = fresh_dir(spark, "ordered")
    write_csv(observed.repartitionByRange(4, "TS").sortWithinPartitions("TS"), path)
    read = with_file_order(read_csv(spark, path, observed.schema))
    assert [r["TS"] for r in read.orderBy("row").collect()] == [r["TS"] for r in observed.orderBy("TS").collect()]
