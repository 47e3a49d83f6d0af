"""The operators as registered queries over the whole driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    fill_middle,
    language,
    licenses,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from tidecast.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 4096
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_counts(spark, sf_dir):
    """Tokens of every text; ``fitting_chars``: the longest prefix within the limit."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.prefix_counts(documents, PIECES, TOKEN_LIMIT, with_deltas=False).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fitting_chars"
    )


def op2_toxicity(spark, sf_dir):
    """Every text's toxicity, learnt from the labelled texts that are not held out."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.scores(documents, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op3_suffix_dedup(spark, sf_dir):
    """Every text without the passages of documents before it, as digests."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


#: Longest rule that fits wins; a rule holds for its host and subdomains.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op4_url_filter(spark, sf_dir):
    """Every URL judged by the rules, or else by a model of what the rules judge."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op10_licenses(spark, sf_dir):
    """Documents (path: source and id) and pages (path: host and path of the URL) as files."""
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        "text",
    )
    url = F.col("url")
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        F.concat(url_filter.host_of(url), url_filter.path_of(url)).alias("path"),
        F.regexp_replace("html", "<[^>]*>", "\n").alias("text"),
    )
    return licenses.scan(documents.unionByName(pages))


def op5_decontaminate(spark, sf_dir):
    """Every pair of a document and a benchmark item that it holds."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contained(documents, table(spark, sf_dir, "benchmark", "item_id", "text"))


#: Words of a shingle, as the query's contract has it; the pipeline's stage takes five.
SIMHASH_WORDS = 4


def op6_simhash(spark, sf_dir):
    """Every text's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), SIMHASH_WORDS)


def op7_language(spark, sf_dir):
    """Every text's language, learnt from the labelled texts that are not held out."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language.identify(documents, language.training_rows(documents))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_byte_bpe(spark, sf_dir):
    """Every text encoded to ids and decoded again, as digests."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = byte_bpe.encode_decode(documents, BYTE_RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality(spark, sf_dir):
    """Figures and verdict of every text."""
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text")).drop("longest_repeat")


def op11_fill_middle(spark, sf_dir):
    """Every text cut and put in another order, and back, as digests."""
    return fill_middle.digests(fill_middle.output_pieces(table(spark, sf_dir, "documents", "doc_id", "text")))


#: Occurrences of a phrase, phrases of a language, percent of a phrase that a longer one must have to absorb it.
LEAST_OCCURRENCES, BEST_PHRASES, ABSORBED = 100, 2000, 100


def op12_collocations(spark, sf_dir):
    """Each language's best collocations."""
    documents = table(spark, sf_dir, "documents", "text", "lang")
    return collocations.collocations(documents, least=LEAST_OCCURRENCES, best=BEST_PHRASES, absorbed=ABSORBED)


def op13_warc(spark, sf_dir):
    """Every page written to seekable WARC bundles and read back."""
    back = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return back.withColumnRenamed("key", "page_id")


QUERIES: dict[str, Query] = {
    name: fn for name, fn in list(globals().items()) if name.startswith("op") and callable(fn)
}
