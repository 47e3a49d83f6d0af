"""URL verdicts: rules first, then logistic regression on hashed character n-grams.

All of it is DataFrame functions and Spark's own ML. The labelled table is small and
bounded: URLs whose verdict a rule gives, at most ``TRAIN_ROWS`` different ones, those
with the least hash. The model gives every other URL its verdict.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different labelled URLs that the model is fitted to, at most.
TRAIN_ROWS = 20_000
#: Hashed features; sizes of the n-grams of host and path.
FEATURES, SIZES = 1 << 14, (3, 4)

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return own & F.startswith(path, F.lit(self.path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruling(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, else null. The rules are a list in
    the plan: meant for hundreds, not for a table."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        said = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), said).otherwise(found)
    return found


def ngrams(value: Column, mark: str) -> Column:
    """The character n-grams of a closed string, each with a mark of where it is from."""
    closed = F.concat(F.lit("^"), value, F.lit("$"))
    each = [
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(closed) - (n - 1), F.lit(1))),
            lambda i, n=n: F.concat(F.lit(mark), closed.substr(i, F.lit(n))),
        )
        for n in SIZES
    ]
    return F.concat(*each)


def features(df: DataFrame) -> DataFrame:
    """``host`` and ``path`` to a sparse vector ``features``."""
    grams = F.concat(ngrams(F.col("host"), "h"), ngrams(F.col("path"), "p"))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return hashing.transform(df.withColumn("grams", grams)).drop("grams")


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """The model of a table with ``host``, ``path`` and ``label`` (1: block)."""
    rows = features(labelled).select("features", "label").coalesce(1)
    return LogisticRegression(maxIter=30, regParam=1e-4, standardization=False).fit(rows)


def judge(df: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each row: the id, ``host``, ``path``, ``rule`` and ``verdict``.

    A null URL, and one without ``://``, has an empty host and path and is judged as such
    by the model. Without rules that both allow and block some URL there is nothing to
    learn: the verdict is then the only one that occurs, or allow. Repeated rows and null ids
    stay as they are; an empty table gives an empty one. Other columns are not read.
    """
    spread = df.select(df[page_id].alias("page_id"), host_of(df[url]).alias("host"), path_of(df[url]).alias("path"))
    ruled = spread.withColumn("said", ruling(F.col("host"), F.col("path"), rules))
    blocked = (F.col("said.verdict") == BLOCK).cast("double")
    labelled = (
        ruled.filter("said IS NOT NULL")
        .select("host", "path", blocked.alias("label"))
        .distinct()
        .orderBy(F.xxhash64("host", "path"), "host", "path")
        .limit(TRAIN_ROWS)
    )
    kinds = [r["label"] for r in labelled.select("label").distinct().collect()]
    if len(kinds) < 2:
        guess = F.lit(BLOCK if kinds == [1.0] else ALLOW)
        judged = ruled
    else:
        model = fit(labelled)
        judged = model.transform(features(ruled))
        guess = F.when(F.col(model.getPredictionCol()) > 0.5, BLOCK).otherwise(ALLOW)
    return judged.select(
        "page_id", "host", "path", F.col("said.rule").alias("rule"), F.coalesce("said.verdict", guess).alias("verdict")
    )
