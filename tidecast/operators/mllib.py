"""The same regression through Spark's ML pipeline.

For one series with many lags, where the matrix of sums in ``fit`` would be too
wide for a query plan, and as a check on it. It runs one fit per target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession

from tidecast.functions.columns import col, cols
from tidecast.functions.names import lag_names, predict_name
from tidecast.operators.fit import CONST, terms, usable

# The estimator settings of the batch and speed layers.
MAX_ITER = 1000
FIT_INTERCEPT = True


def fit_pipelines(
    lagged: DataFrame, targets: Sequence[str], p: int
) -> tuple[dict[str, PipelineModel], int]:
    """One fitted pipeline per target, and the number of rows they saw."""
    rows = lagged.filter(usable(targets, p)).selectExpr(
        *[f"double({c}) AS {c}" for c in cols([*lag_names(targets, p), *targets])]
    )
    rows = rows.persist()
    try:
        n_obs = rows.count()
        assembler = VectorAssembler(inputCols=lag_names(targets, p), outputCol="features")
        models = {}
        for t in targets:
            regression = LinearRegression(
                featuresCol="features", labelCol=t, maxIter=MAX_ITER, fitIntercept=FIT_INTERCEPT
            )
            models[t] = Pipeline(stages=[assembler, regression]).fit(rows)
        return models, n_obs
    finally:
        rows.unpersist()


def fit_var_mllib(lagged: DataFrame, targets: Sequence[str], p: int) -> DataFrame:
    """The coefficient table of ``fit_var``, fitted by the ML pipelines."""
    models, n_obs = fit_pipelines(lagged, targets, p)
    return table_of(lagged.sparkSession, models, p, n_obs)


def weights(model: PipelineModel) -> dict[str, float]:
    """Coefficient by input column, and the intercept as ``CONST``, of a pipeline of one assembler of single
    columns and one linear regression on what it assembles. Others are an error."""
    kinds = [type(stage) for stage in model.stages]
    if kinds != [VectorAssembler, LinearRegressionModel]:
        raise ValueError(f"not an assembler and a linear regression: {[k.__name__ for k in kinds]}")
    assembler, regression = model.stages
    names, values = assembler.getInputCols(), regression.coefficients.toArray()
    if assembler.getOutputCol() != regression.getFeaturesCol() or len(names) != len(values):
        raise ValueError("the regression is not on the assembled columns")
    if len(set(names)) != len(names):
        raise ValueError("a column is assembled twice")
    return {CONST: float(regression.intercept), **dict(zip(names, map(float, values)))}


def table_of(
    spark: SparkSession, models: Mapping[str, PipelineModel], p: int, n_obs: int | None = None
) -> DataFrame:
    """The coefficient table of fitted or loaded pipelines, one for each target.

    Columns count by name, so a pipeline may have assembled the lags in any order, but it must have exactly
    the ``p`` lags of all targets. Saved pipelines do not tell how many rows they saw; ``n_obs`` is
    then null unless given.
    """
    rows = []
    for t, model in models.items():
        known, expected = weights(model), terms(list(models), p)
        if set(known) != {term for term, _ in expected}:
            raise ValueError(f"the pipeline of {t!r} has other lags: {sorted(known)}")
        rows += [(t, term, lag, known[term], n_obs, "ok") for term, lag in expected]
    return spark.createDataFrame(
        rows, "target string, term string, lag int, coef double, n_obs bigint, status string"
    )


def pipelines_of(table: DataFrame, targets: Sequence[str], p: int) -> dict[str, PipelineModel]:
    """The inverse of ``table_of``: a pipeline for each target of one model's coefficient table, to save or apply
    like a fitted one. A missing, repeated or null coefficient is an error."""
    spark = table.sparkSession
    expected = terms(targets, p)
    most = len(targets) * len(expected)  # one row more tells that some repeat
    found = table.filter(col("target").isin(*targets)).select("target", "term", "coef").limit(most + 1).collect()
    known = {(r["target"], r["term"]): r["coef"] for r in found if r["coef"] is not None}
    wanted = {(t, term) for t in targets for term, _ in expected}
    if set(known) != wanted or len(found) != len(wanted):
        raise ValueError(f"not one coefficient for each of {len(wanted)} terms: {len(found)} rows, {len(known)} distinct with a value")
    models = {}
    for t in targets:
        values = Vectors.dense([known[t, term] for term, _ in expected if term != CONST])
        java = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
            f"regression_{t}", _py2java(spark.sparkContext, values), known[t, CONST]
        )
        regression = LinearRegressionModel(java).setFeaturesCol("features")
        regression.set(regression.labelCol, t)
        assembler = VectorAssembler(inputCols=lag_names(targets, p), outputCol="features")
        models[t] = PipelineModel([assembler, regression])
    return models


def predict_pipelines(
    lagged: DataFrame, models: dict[str, PipelineModel], p: int
) -> DataFrame:
    """Append ``<target>_Predict`` from fitted or loaded pipelines."""
    out = lagged
    for t, model in models.items():
        out = (
            model.transform(out)
            .withColumnRenamed("prediction", predict_name(t))
            .drop("features")
        )
    return out


def save_pipelines(models: dict[str, PipelineModel], path: str) -> None:
    """One directory per target under ``path``, replacing older ones."""
    for t, model in models.items():
        model.write().overwrite().save(f"{path}/{t}")


def load_pipelines(targets: Sequence[str], path: str) -> dict[str, PipelineModel]:
    return {t: PipelineModel.load(f"{path}/{t}") for t in targets}


def read_pipelines(
    spark: SparkSession, targets: Sequence[str], p: int, path: str, n_obs: int | None = None
) -> DataFrame:
    """The coefficient table of the pipelines saved under ``path``."""
    return table_of(spark, load_pipelines(targets, path), p, n_obs)
