"""Toxicity scores: gradient-boosted trees over a few dense features, calibrated.

The lexicon is learnt: words, and first letters of words, that toxic texts have far more
often than others. A text's features are densities of lexicon words, how near they stand
to words for "you", capitals, punctuation, and obfuscated spellings. The trees and the
isotonic regression that turns their output into a probability are Spark's own.

Each part learns from rows that the parts before have not seen: the lexicon from folds 1 and
2, the trees from fold 3, the calibration from fold 4 (fold 0 is held out). Where a fold
does not hold both labels, as in tiny tables, that part takes all training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import fold, in_arrow, written

#: Labelled texts to learn from, at most (those whose ids have the least hash). A bounded
#: sample, so its ids and labels are broadcast.
TRAIN_ROWS = 30_000
#: Lexicon entries, at most; a fraction of the toxic texts must have each, and so many texts;
#: how many times more often toxic texts have it; letters of a word's beginning.
LEXICON, LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO, STEM = 5_000, 0.005, 3, 8.0, 4
#: Words on either side within which "you" is near.
NEAR = 5
TREES, DEPTH = 12, 3

#: Words of the second person in English, French, German and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "deinen deiner ihr euch euer ihnen ti tus usted ustedes vosotros vuestro".split()
)
#: Characters written for letters.
_PLAIN = str.maketrans("013457@$!|", "oieastasil", "*._-")

FEATURES = (
    "log_words", "hits", "weight", "top_weight", "kinds", "hidden_hits", "near_you", "upper", "upper_words",
    "loud", "punctuation", "obfuscated", "stretched",
)

_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[\d@$!|*](?<=[^\W\d_].)[\d@$!|*]*[^\W\d_]")
_STRETCHED = tuple(3 * c for c in "aeioulst")
_PUNCTUATION = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_UPPER_WORD = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")


def entries(word: str) -> tuple[str, ...]:
    """What the lexicon may have of a word: itself and, marked, its beginning."""
    return (word, word[:STEM] + "~") if len(word) > STEM else (word,)


def plain(token: str) -> str:
    """A token as it reads without obfuscation: figures as letters, inner marks left out."""
    found = _WORD.search(token.translate(_PLAIN))
    return found.group() if found else ""


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(1, len(words))
    # Whole words and, for longer ones, beginnings.
    found = {w for w in set(words) if w in lexicon or len(w) > STEM and w[:STEM] + "~" in lexicon}
    hits = [i for i, w in enumerate(words) if w in found] if found else []
    weights = [max(lexicon.get(e, 0.0) for e in entries(words[i])) for i in hits]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = 0
    if you:
        at = np.searchsorted(you, hits)
        before = np.array(you)[np.maximum(at - 1, 0)]
        after = np.array(you)[np.minimum(at, len(you) - 1)]
        near = int((np.minimum(np.abs(before - hits), np.abs(after - hits)) <= NEAR).sum())
    mixed = [t for t in _TOKEN.findall(lower) if _MIXED.search(t)] if _MIXED.search(lower) else []
    hidden = sum(any(e in lexicon for e in entries(plain(t))) for t in mixed)
    letters = sum(map(len, words))
    return [
        math.log1p(len(words)),
        100 * len(hits) / n,
        100 * sum(weights) / n,
        max(weights, default=0.0),
        float(len({words[i][:STEM] for i in hits})),
        100 * hidden / n,
        near / max(1, len(hits)),
        len(_UPPER.findall(text)) / max(1, letters),
        len(_UPPER_WORD.findall(text)) / n,
        (text.count("!") + text.count("?")) / n,
        len(_PUNCTUATION.findall(text)) / max(1, len(text)),
        len(mixed) / n,
        sum(map(lower.count, _STRETCHED)) / n,
    ]


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries with their weights (log of the ratio) from ``text, label``: each task counts the
    texts that have an entry, and sums by entry follow."""

    def run(batches):
        counts: Counter[tuple[str, bool]] = Counter()

        def sent():
            words = [w for w, _ in counts]
            out = [pa.array(words), pa.array([t for _, t in counts]), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=["entry", "toxic", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = {e for w in set(_WORD.findall((text.as_py() or "").lower())) for e in entries(w)}
                counts.update((e, label == 1) for e in found)
                if len(counts) > 1_000_000:
                    yield sent()
        yield sent()

    parts = rows.select("text", "label").mapInArrow(run, "entry string, toxic boolean, n bigint")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * toxic))
    n, m = F.col("n"), F.col("m")
    ratio = (n + 0.5) / (toxic + 1) / ((m + 0.5) / (other + 1))
    found = (
        parts.groupBy("entry")
        .agg(F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("n"), F.sum(F.when(F.col("toxic"), 0).otherwise(n)).alias("m"))
        .filter((n >= least) & (ratio >= LEAST_RATIO))
        .select("entry", F.log(ratio).alias("weight"), n)
        .orderBy(F.desc(F.col("weight") * n), "entry")
        .limit(LEXICON)
    )
    return {r["entry"]: r["weight"] for r in found.collect()}


def with_features(df: DataFrame, lexicon: dict[str, float], kept: str) -> DataFrame:
    """The first column of ``df`` (its type is ``kept``) and the features of the second, a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x.as_py() or "", lexicon) for x in batch.column(1)]
        flat = pa.array(np.array(found, np.float64).ravel())
        offsets = pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "dense"]
        )

    return in_arrow(df, run, f"doc_id {kept}, dense array<double>")


def _both(rows: DataFrame) -> bool:
    return rows.select("label").distinct().count() == 2


def scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``, ``raw_score``.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1; null rows are left out, and of several rows of an
    id the greatest counts). Rows in fold 0 are never learnt from, nor is anything but the text.
    A null text counts as an empty one, which has a score too. With one label only, or none,
    there is nothing to tell apart: every score is that label, or 0. Repeated rows and null ids
    stay as they are (a null id is held out); an empty table gives an empty one.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("label"))
        .filter(fold(F.col("doc_id")) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    train = written(rows.join(F.broadcast(known), "doc_id").withColumn("fold", fold(F.col("doc_id"))), "toxicity")
    held = (fold(F.col("doc_id")) == 0).alias("held_out")
    if not _both(train):
        only = train.select(F.max("label")).collect()[0][0] or 0
        return rows.select("doc_id", held, F.lit(float(only)).alias("score"), F.lit(only).alias("predicted"), F.lit(float(only)).alias("raw_score"))

    def part(condition: str) -> DataFrame:
        own = train.filter(condition)
        return own if _both(own) else train

    lexicon = learn_lexicon(part("fold IN (1, 2)"))
    keyed = F.struct("fold", "label").alias("key")
    learnt = with_features(train.select(keyed, "text"), lexicon, "struct<fold:bigint,label:int>")
    ready = written(
        learnt.select("doc_id.fold", F.col("doc_id.label").cast("double").alias("label"), "dense").coalesce(4), "toxicity-features"
    ).withColumn("features", array_to_vector("dense"))
    for_trees, for_isotonic = (x if _both(x) else ready for x in (ready.filter("fold = 3"), ready.filter("fold = 4")))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(for_trees.coalesce(2))

    def raw(frame: DataFrame) -> DataFrame:
        return trees.transform(frame).withColumn("raw_score", _second("probability"))

    isotonic = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="level").fit(
        raw(for_isotonic).select("raw_score", "label").coalesce(1)
    )
    dense = with_features(rows, lexicon, kind).withColumn("features", array_to_vector("dense"))
    scored = isotonic.transform(raw(dense))
    # Within a level of the calibration the trees' own order stays, as a small part.
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("level") + 0.02 * F.col("raw_score"))).alias("score")
    return scored.select("doc_id", held, level, "raw_score").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw_score"
    )


def _second(vector: str) -> Column:
    return F.get(vector_to_array(F.col(vector)), F.lit(1))
