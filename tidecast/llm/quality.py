"""Quality rules with a verdict from a suffix array of words.

The words of each text get numbers, and a suffix array over them is built by
doubling: after round k suffixes are told apart by their first 2^k words, and only
those still tied are sorted again. Many texts share one array, each closed by a mark
of its own, so that no repeat crosses from one text to another. The ranks of all
rounds give the longest common prefix of neighbouring suffixes, and with it for each
position the longest substring from there that is found elsewhere in the text too.
The spans of those with ``MIN_REPEAT`` words or more are united; a text is turned down
if they cover too much of it, or if one of them is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from tidecast.llm.common import in_arrow, slices

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: In percent of the words: those in repeated windows of three words, at most.
MAX_WINDOW_PERCENT = 50
#: Words of a repeat that counts; percent of the words in such repeats, at most; longest repeat, at most.
MIN_REPEAT, MAX_COVER_PERCENT, MAX_REPEAT = 8, 50, 50
#: Characters of text that share one suffix array (a longer text has its own).
SHARED_CHARS = 2_000_000


def longest_repeats(key: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs at
    another position too. Values below zero each occur once, and one ends the array."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    levels, k = [rank], 1
    while True:
        # Groups of one are settled; the others are sorted on by what follows.
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        second = rank[tied + k]
        by = np.argsort(rank[tied] * n + second)
        tied, second = tied[by], second[by]
        group = rank[tied]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(tied))
        within = at - np.maximum.accumulate(np.where(new_group, at, 0))
        order[group + within] = tied
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[tied] = group + within[start]
        levels.append(rank)
        k *= 2
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][left + common] == levels[level][right + common]
        common += same.astype(np.int64) << level
    longest = np.zeros(n, np.int64)
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest


def covered(longest: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Which positions lie in a repeat of ``least`` or more, each taken whole or to ``length``."""
    starts = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    edge[starts] += 1
    ends = starts + (longest[starts] if length is None else length)
    edge -= np.bincount(ends, minlength=len(edge))
    return np.cumsum(edge)[:-1] > 0


def repeated_lines(text: str) -> int:
    """Lines that have a word and are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The figures of each text, from one suffix array for all."""
    ids: dict[bytes, int] = {}
    parts, counts = [], []
    for d, text in enumerate(texts):
        found = text.encode().split()  # at the same characters as the pattern of words
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in found] + [-1 - d], np.int64))
        counts.append(len(found))
    n = np.array(counts, np.int64)
    ends = np.cumsum(n + 1)
    starts = ends - n - 1
    key = np.concatenate(parts)
    doc = np.repeat(np.arange(len(texts)), n + 1)
    # A word counts as another word in another text.
    key = np.where(key >= 0, key + doc * np.int64(len(ids)), key)
    longest = longest_repeats(key)
    return {
        "n_words": n,
        "word_chars": np.array([len(x) - sum(map(x.count, " \t\n\v\f\r")) for x in texts], np.int64),
        "n_symbols": np.array([sum(map(x.count, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array([repeated_lines(x) for x in texts], np.int64),
        "n_repeat_words": np.add.reduceat(covered(longest, 3, 3).astype(np.int64), starts),
        "n_covered_words": np.add.reduceat(covered(longest, MIN_REPEAT).astype(np.int64), starts),
        "longest_repeat": np.maximum.reduceat(longest, starts),
    }


FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat",
)


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: the id, the figures, ``base_failed`` and ``kept``.

    ``base_failed``: under ``MIN_WORDS`` words, or over half of them in repeated windows
    of three. ``kept``: not that, and the repeats of ``MIN_REPEAT`` words or more cover at
    most ``MAX_COVER_PERCENT`` percent of the words, the longest at most ``MAX_REPEAT`` words.
    A null text counts as an empty one, which fails. Repeated rows and null ids stay as they
    are; an empty table gives an empty one. Other columns are not read. A task holds the
    suffix array of ``SHARED_CHARS`` characters, or of one longer text.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f, failed, kept = judged(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(f[name]) for name in FIGURES), pa.array(failed), pa.array(kept)],
            names=["doc_id", *FIGURES, "base_failed", "kept"],
        )

    return in_arrow(
        df.select(df[doc_id], df[text]),
        run,
        f"doc_id {kind}, {', '.join(f'{x} bigint' for x in FIGURES)}, base_failed boolean, kept boolean",
    )


def kept_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text ``quality`` keeps, with all their columns."""
    at = df.columns.index(text)
    return in_arrow(df, lambda batch: batch.filter(pa.array(judged(batch.column(at))[2])), df.schema)


def judged(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Figures, ``base_failed`` and ``kept`` of a column of texts."""
    lengths = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
    found = [
        measure([x or "" for x in column.slice(a, b - a).to_pylist()])
        for a, b in slices([n + 1 for n in lengths], SHARED_CHARS)
    ]
    f = {name: np.concatenate([x[name] for x in found]) for name in FIGURES}
    n = f["n_words"]
    failed = (n < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_WINDOW_PERCENT * n)
    kept = ~failed & (100 * f["n_covered_words"] <= MAX_COVER_PERCENT * n) & (f["longest_repeat"] <= MAX_REPEAT)
    return f, failed, kept
