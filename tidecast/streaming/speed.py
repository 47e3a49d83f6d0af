"""The speed layer as streams: lags, then moments of each epoch as streaming state.

Two streaming plans, each with its own checkpoint and no other record of progress:

* ``epoch_lags`` makes the lags of observations within their epoch (event day), in order of time although they
  arrive in another, and forgets an epoch's state when it is over;
* ``epoch_fits`` keeps the count, means and covariances of each epoch's lags as the state of a
  streaming aggregation. They merge, so a micro-batch shuffles one row per task, epoch and series. When the
  watermark passes an epoch's end its moments come out, once, and are solved on the way.

``speed_predictions`` joins the landed rows to the fits on the epoch. Epochs that are still open are
fitted when they are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.columns import col, cols
from tidecast.functions.names import lag_names
from tidecast.operators.fit import coef_column, moments, solve
from tidecast.operators.predict import predict_var
from tidecast.plans.series import with_epoch
from tidecast.sources.tables import EPOCH
from tidecast.streaming.continuous import stream_lags

_EVENT, _DAY = "__event", "__day"


def epoch_lags(
    observations: DataFrame,
    targets: Sequence[str],
    p: int,
    order: Sequence[str],
    by: Sequence[str] = (),
    delay: str = "1 hour",
    grace: str = "1 day",
) -> DataFrame:
    """Lags within each epoch of each series, and ``late``; ``order`` starts with the time.

    The state of an epoch goes a day after its last row.
    """
    rows = with_epoch(observations, order[0])
    return stream_lags(rows, targets, p, order, [*by, EPOCH], delay, grace, idle="1 day")


def lagged_schema(observations: DataFrame, targets: Sequence[str], p: int, order: Sequence[str], by: Sequence[str] = ()) -> T.StructType:
    """The schema of ``epoch_lags``, as a landed table of it is read."""
    own = {f.name: f.dataType for f in with_epoch(observations, order[0]).schema.fields}
    kept = dict.fromkeys([*by, EPOCH, *order, *targets])
    fields = [T.StructField(c, T.DoubleType() if c in targets else own[c]) for c in kept]
    fields += [T.StructField(c, T.DoubleType()) for c in lag_names(targets, p)]
    return T.StructType([*fields, T.StructField("late", T.BooleanType())])


def epoch_fits(
    lagged: DataFrame, targets: Sequence[str], p: int, time: str, by: Sequence[str] = (), delay: str = "1 hour"
) -> DataFrame:
    """Wide coefficients of each epoch of each series, a row once the epoch has closed.

    ``lagged`` is a stream of ``epoch_lags``' rows. Rows that come after their epoch has closed are not in
    its fit; Spark counts them in the query's progress.
    """
    timed = (
        lagged.filter("NOT late")
        .withColumn(_EVENT, col(time).cast("timestamp"))
        .withWatermark(_EVENT, delay)
        .withColumn(_DAY, F.window(_EVENT, "1 day"))
    )
    keys = [*by, EPOCH]
    found = solve(moments(timed, targets, p, [*keys, _DAY]), targets, p, keys)
    names = [coef_column(j, i) for j in range(len(targets)) for i in range(len(targets) * p + 1)]
    return found.select(*cols([*keys, "n_obs", "status", *names]))


def speed_predictions(
    lagged: DataFrame, fits: DataFrame, targets: Sequence[str], p: int, by: Sequence[str] = ()
) -> DataFrame:
    """Landed rows with the predictions of their epoch's model.

    Epochs without a fit have not closed; they are fitted from the rows there are. The number
    of fits is that of epochs and series, and the join is left to Spark, which sees their size.
    """
    keys = [*by, EPOCH]
    rows = lagged.filter("NOT late").drop("late")
    closed = predict_var(rows.join(fits.select(*cols(keys)), keys, "left_semi"), targets, p, fits, keys)
    still_open = rows.join(fits.select(*cols(keys)), keys, "left_anti")
    return closed.unionByName(predict_var(still_open, targets, p, by=keys))
