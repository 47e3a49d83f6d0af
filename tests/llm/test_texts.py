"""Operators that look at one text at a time, against libraries and brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from helpers import AWKWARD, awkward, figures, rows_of, with_clashes
from pyspark.sql import functions as F

from tidecast.llm import byte_bpe, language, quality, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_every_prefix_has_the_library_count(pieces):
    counter = token_counts.PrefixCounter(open(PIECES, "rb").read())
    r = random.Random(1)
    letters = " " * 6 + "abcdefghijklmnop▁\n\téñ日本x0129.,!😀👍🏽the tion ing"
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        stored = counter.deltas(text).tobytes()
        counts = [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
        assert [token_counts.tokens_at(stored, i) for i in range(len(text) + 1)] == counts
        for budget in (0, 3, 9):
            assert token_counts.cut_at(stored, budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_token_counts_of_awkward_rows(spark, pieces):
    got = token_counts.prefix_counts(with_clashes(awkward(spark)), PIECES, 100)
    expected = [(d, len((t or "").encode()), len(pieces.encode(t or ""))) for d, t in AWKWARD]
    assert rows_of(got.select("doc_id", "n_bytes", "n_tokens")) == sorted(expected, key=str)
    assert token_counts.prefix_counts(awkward(spark).limit(0), PIECES, 100).count() == 0
    fits = {r["doc_id"]: r["fitting_chars"] for r in got.collect() if r["doc_id"] is not None}
    long = AWKWARD[7][1]
    assert len(pieces.encode(long[: fits[7]])) <= 100 < len(pieces.encode(long[: fits[7] + 2]))


def test_small_caches_and_left_out_differences_change_nothing(spark, pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_UNITS", 3)
    monkeypatch.setattr(token_counts, "KEPT_CHARS", 4)
    counter = token_counts.PrefixCounter(open(PIECES, "rb").read())
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(12)] + ["日" * 300]
    for _ in range(60):
        text = " ".join(r.choices(words, k=r.randint(0, 12)))
        assert counter.deltas(text).sum() == len(pieces.encode(text))
        assert len(counter.ready) <= 3 and len(counter.ready_before) <= 6
    df = awkward(spark)
    whole = token_counts.prefix_counts(df, PIECES, 100)
    short = token_counts.prefix_counts(df, PIECES, 100, with_deltas=False)
    assert short.columns == whole.columns[:-1]
    assert rows_of(short) == rows_of(whole.drop("prefix_deltas"))


def test_models_that_move_blanks_are_refused():
    with pytest.raises(Exception):
        token_counts.PrefixCounter(b"not a model")


def test_byte_bpe_equals_the_library(spark):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )
    # Marks that the operator uses itself are ordinary text.
    more = [(20, "āāĂ \ue000\ue001\ue002 \ue000\ue001"), (21, "abcabcabc" * 40), (22, "aaaa aaaaa aaaaaa " * 9)]
    df = spark.createDataFrame(AWKWARD + more, "doc_id bigint, text string")
    got = byte_bpe.encode_decode(with_clashes(df), RANKS, public_tokenizers.PATTERN)
    new = got.columns[-2:]
    assert new[0] == "token_ids" and new[1] == "decoded_"
    for r in got.select("text", *new).collect():
        assert np.frombuffer(r[1], "<u4").tolist() == library.encode_ordinary(r[0] or "")
        assert bytes(r[2]) == (r[0] or "").encode()
    assert byte_bpe.encode_decode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("long", [1, 1000])
def test_both_folds_equal_the_library(spark, monkeypatch, long):
    monkeypatch.setattr(byte_bpe, "LONG", long)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )
    r = random.Random(8)
    parts = ["the", "ing", "tion", "aa", "a", "é", "日本", "x", "0", "😀", "an", "in"]
    words = ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(150)]  # once each, so none is frequent
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id bigint, text string")
    for row in byte_bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(row["token_ids"], "<u4").tolist() == library.encode_ordinary(row["text"])


def test_vocabulary_is_not_in_the_plans_text(spark):
    df = spark.createDataFrame([(i, f"word{i % 40} other") for i in range(200)], "doc_id bigint, text string")
    coded = byte_bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN)
    assert len(coded._jdf.queryExecution().toString()) < 500_000  # Spark keeps this text for every query
    assert coded.count() == coded.filter("decoded = CAST(text AS BINARY)").count() == 200


def test_ids_as_numbers(spark):
    df = spark.createDataFrame([("\x00\x05ÿ\ud7ff",), ("",)], "c string")
    numbers = df.select(byte_bpe.as_numbers(F.col("c"))).collect()
    assert [r[0] for r in numbers] == [[0, 5, 255, 0xD7FF], []]


def test_quality_figures_equal_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab  \n\t*é \x85\x1c") for _ in range(r.randint(0, 150))) for _ in range(150)]
    for some in (texts[:40], texts[40:], [""], ["one"], []):
        if some:
            found = quality.measure(some)
            for i, t in enumerate(some):
                assert [int(found[f][i]) for f in quality.FIGURES] == figures(t, quality.MIN_REPEAT)
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + AWKWARD, "doc_id bigint, text string")
    got = quality.quality(with_clashes(df)).collect()
    assert len(got) == df.count()
    by_id = {(x["doc_id"]): x for x in got}
    assert by_id[7]["longest_repeat"] == 4999 and not by_id[7]["kept"]
    assert quality.quality(df.limit(0)).count() == 0


def test_quality_verdict_and_rows_kept(spark):
    r = random.Random(1)
    clean = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    half = " ".join(f"v{i}" for i in range(60))
    rows = [(1, clean), (2, clean + " " + half + " " + half), (3, "few words"), (4, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    verdict = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in quality.quality(df).collect()}
    assert verdict == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False)}
    kept = quality.kept_rows(df)
    assert kept.columns == df.columns and [x["doc_id"] for x in kept.collect()] == [1]


def test_language_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    train = language.training_rows(docs)
    got = language.identify(docs, train).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.join(train.select("doc_id"), "doc_id", "left_anti")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert got.filter("score < 0 OR score > 1").isEmpty()


def test_language_of_awkward_rows(spark):
    labelled = spark.createDataFrame(
        [("the of and to", "en"), ("der die das und", "de"), (None, "fr"), ("le la", None), ("123", "es")],
        "text string, lang string",
    )
    got = language.identify(with_clashes(awkward(spark)), labelled)
    und = {r["doc_id"] for r in got.filter("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, None} and got.count() == len(AWKWARD)
    assert set(r[0] for r in got.select("lang_pred").distinct().collect()) <= {"en", "de", "und"}
    none = language.identify(awkward(spark), labelled.limit(0))
    assert none.filter("lang_pred <> 'und' OR score <> 0").isEmpty() and none.count() == len(AWKWARD)
    one = language.identify(awkward(spark), labelled.filter("lang = 'en'"))
    assert {r[0] for r in one.select("lang_pred").distinct().collect()} == {"en", "und"}
    assert language.identify(awkward(spark).limit(0), labelled).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_tell_languages_apart(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code}) == n
    assert all(abs(bit.sum()) < n for bit in code.T)
