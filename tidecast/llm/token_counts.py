"""Token counts of every prefix of a text, by dynamic programming.

A byte-pair encoding has a useful property: without its last token, the encoding
of a prefix is the encoding of a shorter prefix, and a token may follow another
exactly if the two encode, written together, as just those two. So for each
prefix one token ends it, found among the pieces that end there (by an
Aho-Corasick automaton of the vocabulary), and

    count[i] = count[i - len(token)] + 1

The counts of all prefixes are stored as differences from prefix to prefix, one
16-bit number for each character. Sums over them answer how many tokens any
prefix has, or where a text must be cut for a budget, and nothing is encoded again.

No piece of the vocabulary has a blank after another character, so a text falls
into units (blanks and the word after them) that do not affect each other. The
differences of a unit are kept in the worker, and a text is the units' bytes joined.
"""

from __future__ import annotations

import re
import struct
from functools import cache, lru_cache
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from tidecast.llm.common import in_arrow

BLANK = "▁"
#: Longer units are not kept; at most about so many units are in each of a worker's two generations.
KEPT_CHARS, KEPT_UNITS = 64, 300_000

_UNIT = re.compile(" +[^ ]*")
DELTA = np.dtype("<i2")


class PrefixCounter:
    """Counts for one sentencepiece BPE model with byte fallback.

    The model must add a blank in front, leave white space as it is, and have no
    piece with a blank after another character; others are refused.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score = {
            sp.id_to_piece(i).replace(BLANK, " "): sp.get_score(i)  # plain blanks from here on
            for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        }
        if any(" " in piece.lstrip(" ") for piece in self.score):
            raise ValueError("a piece has a blank after another character")
        if sp.encode(" a  b", out_type=str) != sp.encode(f"{BLANK}a{BLANK * 2}b", out_type=str):
            raise ValueError("the model does not write blanks as U+2581")
        if len(sp.encode("  ")) == 0 or not sp.encode("a", out_type=str)[0].startswith(BLANK):
            raise ValueError("the model changes white space")
        self.pieces = ahocorasick.Automaton()
        for piece in self.score:
            if self._made(piece):
                self.pieces.add_word(piece, (len(piece), piece))
        self.pieces.make_automaton()
        # Two generations: when the new one is full it becomes the old one, and what is still used is taken
        # over from there, so frequent units are not worked out again.
        self.ready: dict[str, bytes] = {}
        self.ready_before: dict[str, bytes] = {}
        self.fits = lru_cache(400_000)(self.pair)
        self.made = cache(self._made)  # as many as the vocabulary has, at most

    def _made(self, token: str) -> tuple[float, str, str] | None:
        """When a token is made (the lower, the earlier; characters were there before) and of
        which two parts; None if no text of its characters ever becomes this token."""
        parts, last = list(token), (-np.inf, "", "")
        while len(parts) > 1:
            joined = [self.score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:])]
            best = max(joined)
            if best == -np.inf:
                return None
            at = joined.index(best)  # the leftmost of equals
            last = (-best, parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last

    def pair(self, left: str, right: str) -> bool:
        """Whether the two tokens, written together, encode as just these two.

        Goes back in time along their border: undo whichever was made later, and see
        whether the two that stood there then would have merged first. Of equal merges
        the left one comes first.
        """
        made, until, at_until = self.made, np.inf, False
        while True:
            score = self.score.get(left + right)
            if score is not None and (-score < until or at_until and -score == until):
                return False
            (t_left, _, x), (t_right, y, _) = made(left), made(right)
            if t_left == t_right == -np.inf:
                return True
            if t_left > t_right:
                left, until, at_until = x, t_left, False
            else:
                right, until, at_until = y, t_right, True

    def unit(self, unit: str) -> bytes:
        """The differences of a unit, from the pieces that end at each place, longest first."""
        counts, lasts, fits = [0], [""], self.fits
        done = 0  # so many characters
        for end, (size, piece) in self.pieces.iter(unit):
            if end < done:
                continue
            while done < end:
                done = self.as_bytes(unit, counts, lasts)
            start = end + 1 - size
            left = lasts[start]
            if not left or fits(left, piece):
                counts.append(counts[start] + 1)
                lasts.append(piece)
                done = end + 1
        while done < len(unit):
            done = self.as_bytes(unit, counts, lasts)
        return struct.pack(f"<{done}h", *map(sub, counts[1:], counts))

    def as_bytes(self, unit: str, counts: list[int], lasts: list[str]) -> int:
        """The next character is none of the vocabulary: it is written as its bytes, which never merge."""
        char = unit[len(counts) - 1]
        if char in self.score:
            raise AssertionError(f"no token ends {unit[: len(counts)]!r}")
        counts.append(counts[-1] + len(char.encode()))
        lasts.append("")
        return len(counts) - 1

    def deltas(self, text: str) -> np.ndarray:
        """For each character of the text, how many tokens it adds to the prefix before it."""
        if not text:
            return np.zeros(0, DELTA)
        units = _UNIT.findall(" " + text.replace(BLANK, " "))
        ready, before, long = self.ready, self.ready_before, []
        for unit in set(units).difference(ready):
            ready[unit] = before[unit] if unit in before else self.unit(unit)
            if len(unit) > KEPT_CHARS:
                long.append(unit)
        joined = b"".join(map(ready.__getitem__, units))
        for unit in long:
            del ready[unit]
        if len(ready) > KEPT_UNITS:  # one text may bring more than two generations hold
            self.ready, self.ready_before = {}, ready if len(ready) <= 2 * KEPT_UNITS else {}
        # The blank in front belongs to no character: it counts with the first.
        out = np.frombuffer(joined, DELTA).copy()
        out[1] += out[0]
        return out[1:]


_COUNTERS: dict[bytes, PrefixCounter] = {}


def counter(model: bytes) -> PrefixCounter:
    """The worker's counter for a model; its units are kept from task to task."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def tokens_at(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return int(np.frombuffer(deltas, DELTA)[:n_chars].sum(dtype=np.int64))


def cut_at(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(deltas, DELTA), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(
    df: DataFrame, model_path: str, budget: int, doc_id: str = "doc_id", text: str = "text", with_deltas: bool = True
) -> DataFrame:
    """A row for each row: id, ``n_bytes``, ``n_tokens``, ``fitting_chars`` (the longest
    prefix within ``budget`` tokens) and, unless ``with_deltas`` is false, ``prefix_deltas``, the counts of all
    prefixes. They are as large as the text, so a caller that needs the figures only leaves them out.

    Counts are those of the sentencepiece model without added tokens. Null and empty
    texts have no tokens and empty deltas. Repeated rows and null ids stay as they are,
    and an empty table gives an empty one. Other columns are not read. A long text is
    counted whole. The model file is
    read by the driver and sent along; it is a fixed vocabulary of about half a megabyte.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    counter(model)  # refuses an unfit model here, not in a task
    kind = df.schema[doc_id].dataType.simpleString()

    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, fitting_chars bigint"
    if with_deltas:
        schema += ", prefix_deltas binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model)
        texts = pc.fill_null(batch.column(1), "")
        tokens, cuts, stored = [], [], []
        for x in texts:
            d = count.deltas(x.as_py())
            n = int(d.sum(dtype=np.int64))
            tokens.append(n)
            cuts.append(len(d) if n <= budget and d.min(initial=0) >= 0 else cut_at(d, budget))
            if with_deltas:
                stored.append(d.tobytes())
        n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
        columns = [batch.column(0), n_bytes, pa.array(tokens, pa.int64()), pa.array(cuts, pa.int64())]
        if with_deltas:
            columns.append(pa.array(stored, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "fitting_chars", "prefix_deltas"][: len(columns)])

    return in_arrow(df.select(df[doc_id], df[text]), run, schema)
