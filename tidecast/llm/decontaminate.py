"""Benchmark decontamination: short test items inside long documents.

A document holds an item if it has at least ``LEAST`` of the item's distinct shingles.
Items are put into partitions by their number of shingles. An item's sketch is its m
smallest shingle hashes, where m is what a document can lack of an item of the partition's greatest
size, plus one: a document that holds the item then has one of the sketch for certain, whichever
shingles it lacks, so the search loses nothing. Each document's shingles are looked up in the
sketches, equal hashes of a document once, and every pair found is then verified: the
exact shingles of item and document are compared as strings.

The sketches are written first, so that Spark knows their size: below its threshold they are
broadcast, and beyond it both sides are shuffled by hash. Pairs are few and distinct before they are
joined with the texts again. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import free_name, lower_ascii, words, written

SHINGLE, LEAST = 5, 0.8
#: Sizes of the partitions: from one power of this to the next.
PARTITION = 2.0


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Windows of ``size`` lower-cased words; a shorter text is one window, none without words."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(
            F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))),
            lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "),
        )
        return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words(lower_ascii(text))), windows), F.lit(0))


def hashes(text: Column, size: int = SHINGLE) -> Column:
    """The distinct hashes of a text's shingles."""
    return F.array_distinct(F.transform(shingles(text, size), lambda s: F.xxhash64(s)))


def sketches(items: DataFrame, least: float) -> DataFrame:
    """``item_key, hash`` of each item's sketch, from ``item_key, shingles``."""
    n = F.size("shingles")
    partition = F.floor(F.log(PARTITION, n.cast("double") + 1e-9))
    greatest = F.pow(F.lit(PARTITION), partition + 1) - 1
    # What a document may lack of the greatest item, rounded up, and one more.
    m = F.least(n, (F.floor(greatest * F.lit(round(1 - least, 9)) + 1e-6) + 1).cast("int"))
    hashed = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return items.filter(n > 0).select("item_key", F.explode(F.slice(hashed, F.lit(1), m)).alias("hash"))


def contained(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = LEAST,
) -> DataFrame:
    """A row for each document and item it holds: ``doc_id, item_id, n_shingles`` (of the item),
    ``n_shared, containment``.

    Null and empty texts hold nothing and are not held. Items of fewer words than a shingle are one
    shingle, which only a document of just these words has. Repeated rows and items with equal ids count
    once for each different text pair of one id, with the greatest containment; null ids are left
    out, since a pair needs both. Empty tables give an empty one. Other columns are not read.
    """
    bench = written(
        items.filter(items[item_id].isNotNull())
        .select(items[item_id].alias("item_id"), F.array_distinct(shingles(items[item_text])).alias("shingles"))
        .filter(F.size("shingles") > 0)
        .distinct()
        .withColumn("item_key", F.xxhash64("item_id", F.array_join("shingles", " "))),
        "items",
    )
    sketch = written(sketches(bench, least).distinct(), "sketches")
    docs = documents.filter(documents[doc_id].isNotNull()).select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    found = written(
        docs.select("doc_id", F.explode(hashes(F.col("text"))).alias("hash"))
        .join(sketch, "hash")
        .select("doc_id", "item_key")
        .distinct(),
        "candidates",
    )
    # Each candidate document's text is read once, with all its items.
    wanted = found.join(bench, "item_key").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shingles")).alias("items"))
    pairs = (
        docs.join(wanted, "doc_id")
        .select("doc_id", "items", F.array_distinct(shingles(F.col("text"))).alias("own"))
        .select(
            "doc_id",
            F.explode(
                F.transform(
                    "items",
                    lambda i: F.struct(
                        i["item_id"].alias("item_id"),
                        F.size(i["shingles"]).alias("n"),
                        F.size(F.array_intersect(i["shingles"], F.col("own"))).alias("k"),
                    ),
                )
            ).alias("p"),
        )
        .select("doc_id", "p.item_id", F.col("p.n").cast("long").alias("n_shingles"), F.col("p.k").cast("long").alias("n_shared"))
        .withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))
        .filter(F.col("n_shared") >= F.col("n_shingles") * F.lit(least) - 1e-9)
    )
    best = F.max(F.struct("containment", "n_shingles", "n_shared")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")


def without_contained(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no item. Rows with a null id are not looked at and stay."""
    key = free_name(documents, "held_by")
    held = contained(documents, items, doc_id, text).select(F.col("doc_id").alias(key)).distinct()
    return documents.join(held, documents[doc_id] == held[key], "left_anti")
