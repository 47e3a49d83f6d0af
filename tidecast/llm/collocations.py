"""Collocations: phrases that occur often, and more often than their parts would have it.

Dynamic itemset counting. The corpus is written once as normalised blocks in ``SHARDS``
shards, and the shards are scanned in a cycle. Words are counted from the first scan on. A longer
phrase becomes active as soon as the two phrases that it has without its last and without its
first word have reached the threshold, at the end of whichever scan that happens; it is
counted from the next scan on, beside the phrases of all other lengths, until it has seen each
shard once. What reaches the threshold so activates longer ones. The loop ends when
nothing is active.

When a phrase is active follows from when its two parts reached the threshold, so no list of
candidates is made. A scan looks the parts up in two bit maps of hashes: parts that have reached the
threshold, and those of them that did within the last cycle. A bit that is set by chance only
makes a phrase counted that need not be: every count is of a whole shard, so the sum over the
last cycle's scans is never above the true count, and for a phrase at the end of its cycle it is the
true count. Counts themselves are kept by the phrases' text, exactly.

Each scan's counts are one written table. Of the sums over a cycle only those can reach the threshold
of which one shard has its share, so most other phrases' counts are not shuffled again: a third
bit map, of those that have a share, sorts them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import written
from tidecast.sources.scratch import fresh_dir

#: Shards of the cycle; words of the longest phrase.
SHARDS, LONGEST = 3, 5
#: Bytes of normalised text in a block, and of the blocks that are counted together.
BLOCK, SLICE = 1 << 13, 1 << 23
#: A bit map has two to this power bits (8 MB). The more phrases, the more others are counted in vain.
BITS = 26
#: The same of the map by which the counts of a cycle are looked through (at most 8 MB of rows).
SHARE_BITS = 25

#: A to Z in lower case; what ends a piece becomes a full stop, which no word then has.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_ENDS))


def normalised(text: bytes) -> bytes:
    """The words of a text between blanks, with a full stop between pieces."""
    return b" ".join(text.translate(_NORMAL).replace(b".", b" . ").split())


def _cut(words: bytes) -> Iterator[bytes]:
    """Runs of pieces of about ``BLOCK`` bytes, or of one longer piece."""
    start = 0
    while (end := words.find(b" . ", start + BLOCK)) >= 0:
        yield words[start:end]
        start = end + 3
    yield words[start:]


def _blocks(df: DataFrame, text: str, lang: str, path: str) -> DataFrame:
    """The texts as blocks of one language each, dealt in turn to the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            open_: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            rows = []

            def close(key: str) -> None:
                words = b" . ".join(open_.pop(key))
                rows.append((key, words.count(b" ") + 1 - words.count(b"."), words))
                sizes[key] = 0

            for text, key in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for words in _cut(normalised(text or b"")):
                    if words:
                        open_.setdefault(key, []).append(words)
                        sizes[key] = sizes.get(key, 0) + len(words)
                        if sizes[key] >= BLOCK:
                            close(key)
            for key in list(open_):
                close(key)
            if rows:
                shard = [(turn + i) % SHARDS for i in range(len(rows))]
                turn += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.binary()),
                        pa.array(shard, pa.int32()),
                    ],
                    names=["lang", "n_words", "words", "shard"],
                )

    schema = "lang string, n_words bigint, words binary, shard int"
    texts = df.select(df[text].alias("text"), F.coalesce(df[lang].cast("string"), F.lit("und")).alias("lang"))
    texts.mapInArrow(run, schema).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


@dataclass
class Maps:
    """Bit maps of the phrases that reached the threshold, and of those that did in the last cycle.

    They are sent to every scan, so they are compressed: most bits are zero.
    """

    bits: int
    reached: bytes
    recent: bytes
    #: Lengths of the recent ones that longer phrases can have as parts.
    lengths: list[int]


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _test(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _counted(text: bytes, lang: str, words_too: bool, maps: Maps | None, bitmaps: list[np.ndarray]):
    """``(phrases, counts)`` of the active phrases of a text, length by length."""
    encoded = pc.split_pattern(pa.array([text], pa.binary()).cast(pa.string()), " ").values.dictionary_encode()
    a, vocabulary = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    words = vocabulary.cast(pa.binary()).to_pylist()
    stops = np.array([w == b"." for w in words])
    if words_too:
        counts = np.bincount(a, minlength=len(words))
        yield vocabulary.filter(pa.array(~stops)), counts[~stops]
    if maps is None or not maps.lengths:
        return
    reached_map, recent_map = bitmaps
    x = _word_hashes(words, lang)
    slots = _slots(_mixed(x), maps.bits)
    reached = (_test(reached_map, slots) & ~stops)[a]
    recent = (_test(recent_map, slots) & ~stops)[a]
    h, x = _mixed(x)[a], x[a]
    for k in range(2, max(maps.lengths) + 2):
        at = np.flatnonzero(reached[:-1] & reached[1:])
        if not len(at):
            return
        h_at = _longer(h[at], x[at + k - 1])
        if k - 1 in maps.lengths:
            active = recent[at] | recent[at + 1]
            yield _grouped(a, at[active], h_at[active], k, vocabulary)
        slots = _slots(h_at, maps.bits)
        h[at] = h_at
        reached = np.zeros(len(a), bool)
        reached[at] = _test(reached_map, slots)
        recent = np.zeros(len(a), bool)
        recent[at] = _test(recent_map, slots)


def _grouped(a: np.ndarray, at: np.ndarray, h: np.ndarray, k: int, vocabulary: pa.Array):
    """The different phrases of k words at the places, with their counts."""
    which = pa.array(h).dictionary_encode().indices.to_numpy()
    counts = np.bincount(which)
    first = np.zeros(len(counts), np.int64)
    first[which] = at  # any of its places
    if any((a[at + j] != a[first[which] + j]).any() for j in range(k)):
        # Two phrases with one hash: group by the words themselves.
        rows = np.stack([a[at + j] for j in range(k)], axis=1)
        _, first, counts = np.unique(rows, axis=0, return_index=True, return_counts=True)
        first = at[first]
    columns = [vocabulary.take(pa.array(a[first + j])) for j in range(k)]
    return pc.binary_join_element_wise(*columns, " "), counts


def _scan(blocks: DataFrame, words_too: bool, maps: Maps | None) -> DataFrame:
    """Counts of the active phrases in a shard."""

    def out(open_: dict[str, list[bytes]], bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, parts in open_.items():
            for phrases, counts in _counted(b" . ".join(parts), lang, words_too, maps, bitmaps):
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), phrases, pa.array(counts.astype(np.int64))],
                    names=["lang", "phrase", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        bitmaps = [np.frombuffer(unpack(m), np.uint8) for m in ((maps.reached, maps.recent) if maps else ())]
        open_, size = {}, 0
        for batch in batches:
            for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words:
                    open_.setdefault(lang, []).append(words)
                    size += len(words)
                if size >= SLICE:
                    yield from out(open_, bitmaps)
                    open_, size = {}, 0
        yield from out(open_, bitmaps)

    counted = blocks.select("lang", "words").mapInArrow(run, "lang string, phrase string, n bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _phrase_slots(phrases: list[str], langs: list[str], bits: int) -> np.ndarray:
    """The place of each phrase in a map."""
    out = np.zeros(len(phrases), np.int64)
    split = [p.encode().split(b" ") for p in phrases]
    groups: dict[tuple[str, int], list[int]] = {}
    for i, (words, lang) in enumerate(zip(split, langs)):
        groups.setdefault((lang, len(words)), []).append(i)
    for (lang, k), rows in groups.items():
        x = _word_hashes([w for i in rows for w in split[i]], lang).reshape(-1, k)
        h = _mixed(x[:, 0])
        for j in range(1, k):
            h = _longer(h, x[:, j])
        out[rows] = _slots(h, bits)
    return out


def _maps(reached: DataFrame, since: int, bits: int) -> Maps:
    """Bit maps of ``reached``; recent are those that reached the threshold at ``since`` or later.

    The driver gets a row for each 64 bits that are not all zero, so at most 2^(bits - 6).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _phrase_slots(batch.column(1).to_pylist(), batch.column(0).to_pylist(), bits)
            recent = batch.column(3).to_numpy() >= since
            length = batch.column(2).to_numpy()
            bit = np.left_shift(np.int64(1), slots & 63)
            columns = [slots >> 6, bit, np.where(recent, bit, 0), np.where(recent, 1 << length, 0).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "reached", "recent", "lengths"])

    cells = reached.select("lang", "phrase", "length", "since").mapInArrow(
        run, "cell bigint, reached bigint, recent bigint, lengths bigint"
    )
    found = cells.groupBy("cell").agg(*[F.bit_or(c).alias(c) for c in ("reached", "recent", "lengths")]).toArrow()
    at = found["cell"].to_numpy()
    whole = []
    for name in ("reached", "recent"):
        bitmap = np.zeros(1 << bits >> 6, np.int64)
        bitmap[at] = found[name].to_numpy()
        whole.append(zstandard.ZstdCompressor().compress(bitmap.tobytes()))
    lengths = np.bitwise_or.reduce(found["lengths"].to_numpy(), initial=0)
    return Maps(bits, *whole, [k for k in range(1, LONGEST) if lengths >> k & 1])


def _promising(counts: DataFrame, share: int) -> DataFrame:
    """The rows of ``counts`` of phrases that have a row with ``share`` or more, and a few others.

    Phrases are looked up by a hash in a bit map, which is broadcast: at most 2^(SHARE_BITS - 6) rows
    of two numbers.
    """
    slot = F.expr(f"shiftrightunsigned(xxhash64(lang, phrase), {64 - SHARE_BITS})")
    cell, bit = F.expr("slot DIV 64"), F.expr("CAST(slot % 64 AS INT)")
    placed = counts.withColumn("slot", slot).withColumn("cell", cell).withColumn("bit", bit)
    cells = placed.filter(F.col("n") >= share).groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit)) AS bits"))
    return placed.join(F.broadcast(cells), "cell").filter("getbit(bits, bit) = 1").select("lang", "phrase", "n")


_REACHED = "lang string, length int, phrase string, since int, f bigint"


def frequent_phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``LONGEST`` words that occur ``least`` times or more in their language.

    Returns ``(phrases, totals)``: lang, length, phrase, since (the scan after which it had
    reached ``least``) and f, its count; and lang with n, the number of all words. A null text is an
    empty one, a null language ``und``. Repeated rows count each; other columns are not read; an
    empty table gives empty ones. A long text is cut into blocks between its pieces; a
    piece, however long, stays whole. Ties do not arise: all counts are exact, whatever ``bits``.
    """
    spark = df.sparkSession
    blocks = _blocks(df, text, lang, fresh_dir(spark, "phrase-blocks"))
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n")).filter("n > 0")
    reached = spark.createDataFrame([], _REACHED)
    maps, scans, tick = None, [], 0
    while tick < SHARDS or maps.lengths:
        shard = blocks.filter(F.col("shard") == tick % SHARDS)
        scans.append(written(_scan(shard, tick < SHARDS, maps), f"phrase-scan-{tick}"))
        cycle = scans[-SHARDS:]
        counts = cycle[0]
        for scan in cycle[1:]:
            counts = counts.unionByName(scan)
        sums = (
            _promising(counts, -(-least // SHARDS))
            .groupBy("lang", "phrase")
            .agg(F.sum("n").alias("f"))
            .filter(F.col("f") >= least)
            .select("lang", F.expr("size(split(phrase, ' ', -1))").alias("length"), "phrase", F.lit(tick + 1).alias("since"), "f")
        )
        reached = written(
            reached.unionByName(sums)
            .groupBy("lang", "length", "phrase")
            .agg(F.min("since").alias("since"), F.max("f").alias("f")),
            "phrases",
        )
        tick += 1
        maps = _maps(reached, tick - SHARDS + 1, bits)
    return reached, totals


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, best: int = 2000, absorbed: int = 100,
    bits: int = BITS,
) -> DataFrame:
    """Each language's ``best`` collocations: lang, rank, phrase, a, l, r, n, score.

    A collocation has 2 to ``LONGEST`` words and a = ``least`` or more occurrences. Cutting it in two
    parts with l and r occurrences gives ``floor(1000 a n / (l r))``; the lowest cut is its score, ties to
    the shortest first part. Those contained in a longer one that has ``absorbed`` percent of its occurrences
    are dropped. Ranked by score, then a, then the phrase in byte order. Rows as in ``frequent_phrases``.
    """
    phrases, totals = frequent_phrases(df, text, lang, least, bits)
    counts = phrases.select("lang", "phrase", "f")
    longer = phrases.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"))
    words = "split(phrase, ' ', -1)"
    inner = f"""flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1),
        s -> array_join(slice({words}, s, m), ' '))))"""
    inside = longer.filter("length > 2").select("lang", F.col("a").alias("by"), F.explode(F.expr(inner)).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = longer.join(most, ["lang", "phrase"], "left").filter(f"by IS NULL OR 100 * by < {absorbed} * a")
    cuts = kept.select("lang", "phrase", "length", "a", F.expr("explode(sequence(1, length - 1)) AS k")).selectExpr(
        "*",
        f"array_join(slice({words}, 1, k), ' ') AS first",
        f"array_join(slice({words}, k + 1, length - k), ' ') AS rest",
    )
    parts = cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(
        counts.toDF("lang", "rest", "r"), ["lang", "rest"]
    )
    scored = (
        parts.join(totals, "lang")
        .withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4)) * CAST(a AS DECIMAL(19)) * CAST(n AS DECIMAL(19))) DIV (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.expr("min(struct(score, k, l, r)) AS cut"))
    )
    rank = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.expr(f"CAST({rank} AS BIGINT)"))
    return ranked.filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
