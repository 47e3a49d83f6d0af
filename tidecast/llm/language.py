"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier tells the
languages with +1 from those with -1 by a text's character n-grams: naive Bayes over
hashed byte n-grams, whose weights follow from how often each language has each n-gram.
These counts are one aggregation over all labelled texts; each task adds up its own
before the shuffle, so a language, however common, sends one row for each task.

A text's margins are compared with all codewords by a logistic loss. Each loss is
weighted by how well that bit's classifier did on labelled texts of that language. The nearest
codeword gives the language; a second one almost as near marks the text as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import fold, in_arrow, slices

UNKNOWN = "und"
#: Hashed n-grams; sizes in bytes.
BUCKETS, SIZES = 1 << 13, (1, 2, 3, 4)
#: Up to so many languages every split into two is a bit; beyond, this many random ones are.
EXHAUSTIVE, BITS = 6, 63
#: Labelled texts for each language by which the bits' losses are weighted, about (least hash).
WEIGHT_ROWS = 300
#: Share of the second language beside the first from which a text is ambiguous.
AMBIGUOUS = 0.5
_SHARED_BYTES = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def ngram_counts(texts: list[str]) -> np.ndarray:
    """A row of hashed n-gram counts for each text, in lower case with blanks around."""
    raw = [f" {t.lower()} ".encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) ^ data[n - 1 :]
        if n not in SIZES:
            continue
        within = row[:m] == row[n - 1 :]
        hashed = (code ^ np.uint32(n * 0x9E3779B1 % (1 << 32))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 13)
        total += np.bincount((row[:m] + hashed)[within], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages; no two rows are equal."""
    if n <= EXHAUSTIVE:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[:1] == (1,) and -1 in b]
        return np.array(bits, np.float64).T.reshape(n, -1)
    draw = np.random.default_rng(20)
    while True:
        code = np.where(draw.random((BITS, n)).argsort(1) < n // 2, 1.0, -1.0).T
        if len({tuple(r) for r in code}) == n:
            return code


class Model:
    """Languages, their codewords, the bits' weights and the losses' weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        # Every language counts alike, however many texts it has.
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        plus = np.array([share[bit > 0].mean(0) for bit in self.code.T]).reshape(-1, BUCKETS)
        minus = np.array([share[bit < 0].mean(0) for bit in self.code.T]).reshape(-1, BUCKETS)
        self.bits = (np.log(plus) - np.log(minus)).T
        self.trust = np.full(self.code.shape, 1.0 / max(1, self.code.shape[1]))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of each bit over a text's n-grams."""
        counts = ngram_counts(texts)
        return 20 * (counts @ self.bits) / np.maximum(counts.sum(1, keepdims=True), 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of margins: the nearest language, its share of belief, the second's."""
        loss = np.stack([(np.logaddexp(0, -margins * c) * w).sum(1) for c, w in zip(self.code, self.trust)], 1)
        belief = np.exp(-len(self.langs) * (loss - loss.min(1, keepdims=True)))
        belief /= belief.sum(1, keepdims=True)
        ranked = np.argsort(-belief, axis=1, kind="stable")
        at = np.arange(len(belief))
        second = belief[at, ranked[:, 1]] if len(self.langs) > 1 else np.zeros(len(belief))
        return ranked[:, 0], belief[at, ranked[:, 0]], second


def chunks(column: pa.Array):
    """The texts of an Arrow column in runs of bounded size, null as empty."""
    lengths = [(n or 0) + BUCKETS // 64 for n in pa.compute.binary_length(column).to_pylist()]
    for a, b in slices(lengths, _SHARED_BYTES):
        yield a, [x or "" for x in column.slice(a, b - a).to_pylist()]


def language_counts(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """N-gram counts of each language over all rows of ``text, lang``: a row for each task
    and language is shuffled, and one for each language comes to the driver."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, texts in chunks(batch.column(0)):
                counts = ngram_counts(texts)
                own = np.array(langs[a : a + len(texts)])
                for lang in set(own.tolist()):
                    sums[lang] = sums.get(lang, 0) + counts[own == lang].sum(0)
        for lang, c in sums.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used), pa.array(c[used])], names=["lang", "bucket", "n"]
            )

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, bucket bigint, n bigint")
    found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((len(langs), BUCKETS))
    where = {x: i for i, x in enumerate(langs)}
    counts[[where[x] for x in names], found["bucket"].to_numpy()] = found["n"].to_numpy()
    return langs, counts


def rightness(labelled: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """For each language how often each bit was right, summed up in Spark."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, bits, right = [], [], []
        for a, texts in chunks(batch.column(0)):
            own = batch.column(1).slice(a, len(texts)).to_pylist()
            ok = model.margins(texts) * model.code[[model.langs.index(x) for x in own]] > 0
            for lang, row in zip(own, ok):
                langs += [lang] * len(row)
                bits += range(len(row))
                right += row.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(bits, pa.int32()), pa.array(right, pa.bool_())], names=["lang", "bit", "ok"]
        )

    each = in_arrow(labelled.select("text", "lang"), run, "lang string, bit int, ok boolean")
    found: dict[str, np.ndarray] = {}
    for r in each.groupBy("lang", "bit").agg(F.avg(F.col("ok").cast("double")).alias("share")).collect():
        found.setdefault(r["lang"], np.zeros(model.code.shape[1]))[r["bit"]] = r["share"]
    return found


def fit(labelled: DataFrame) -> Model | None:
    """The model of all rows of ``text, lang`` with both; None without any. A language needs
    a letter in some text; the number of languages is small and so is what the driver gets."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    langs, counts = language_counts(rows)
    if not langs:
        return None
    model = Model(langs, counts)
    # About WEIGHT_ROWS for each language: those whose hash is below a share of all.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, WEIGHT_ROWS / n)))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    right = rightness(rows.filter(place < share[F.col("lang")]), model)
    for k, lang in enumerate(langs):
        if lang in right:
            # Trust a bit for a language as often as it was right for texts of that language.
            model.trust[k] = (right[lang] + 1e-3) / (right[lang] + 1e-3).sum()
    return model


def identify(df: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: the id, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    ``labelled`` has ``text`` and ``lang``. Texts that are null or have no letter are ``und``
    with a score of 0, as is every text if nothing is labelled. Equally near languages: the first by
    name. Repeated rows and null ids stay as they are; an empty table gives an empty one.
    """
    model = fit(labelled)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, doubtful = [], [], []
        for _, texts in chunks(batch.column(1)):
            known = [model is not None and bool(_LETTER.search(t)) for t in texts]
            first, share, second = model.decode(model.margins(texts)) if model else (np.zeros(len(texts), int), None, None)
            for i, ok in enumerate(known):
                langs.append(model.langs[first[i]] if ok else UNKNOWN)
                scores.append(float(share[i]) if ok else 0.0)
                doubtful.append(bool(second[i] >= AMBIGUOUS * share[i]) if ok else True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubtful, pa.bool_())],
            names=["doc_id", "lang_pred", "score", "ambiguous"],
        )

    return in_arrow(
        df.select(df[doc_id], df[text]), run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )


def training_rows(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows not held out."""
    return df.filter(fold(df[doc_id]) != 0)
