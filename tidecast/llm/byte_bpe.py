"""Byte-level BPE with Spark's higher-order functions.

Token ids are kept as text while they are worked on: an id is the character with that code
(ids end before the surrogates, so each is one), and a text's ids are one string. Joining,
counting and slicing ids are then string functions, and UTF-16 turns them into numbers.

The vocabulary is a literal in the plan. It is set as a session variable from a table of one row, so it is one compact
array there, and neither Python nor the plan's text has it. A string is looked up in an array of buckets by its hash. The rank of a pair
of ids stands in one array, at the place of the left id plus the right id: places are chosen so that no two pairs
share one, and each entry names its left id, so the rank is one exclusive or.

A word is encoded by a fold over its bytes. The state is the ids of its parts and the rank of every
neighbouring pair, a string each; each step merges the leftmost pair of lowest rank and looks up the two new
pairs beside it, until no pair has a rank. In a long word, where the state
is too large to be copied for every merge, a step merges the pair of lowest rank wherever it stands:
the state is then the bytes with marks around every part, and the step is one ``replace``.

Words repeat, so a first pass counts the words of the table (combined before the shuffle) and encodes
the ``FREQUENT`` most frequent ones once; they are a second literal of bounded size. Every other word is encoded by the same fold where it stands.

Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import free_name, written

#: Words of the second literal, at most, and their longest size in characters; both bound it.
FREQUENT, FREQUENT_CHARS = 150_000, 24
#: Bytes from which a word is long. Both folds are exact.
LONG = 64
#: Buckets of strings, a power of two.
_BUCKETS = 1 << 17
#: No character of Latin-1, so never one of a word's bytes.
_MARK = "ā"
_PLACES = 1 << 31
#: Bits of an id. A number from ``_LEAST_NONE`` or below 0 in place of a rank is that of a pair without one.
_ID = 16
_LEAST_NONE = 1 << _ID
#: In place of the rank of a pair that has none: comes after all ids.
_NONE = "\ue00f"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def placed(rows: dict[int, dict[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each left id, and an array that has at that place plus the right id the left id and the rank of
    their pair, in one number. Ids are below ``n``; ``n`` itself is the edge of a word and has no pair."""
    place, table = np.zeros(n + 1, np.int32), np.full(4 * n, -1, np.int64)
    first, tries = 0, np.arange(256)[:, None]
    for left in sorted(rows, key=lambda a: -len(rows[a])):
        right = np.fromiter(rows[left], np.int64, len(rows[left]))
        while not len(free := np.flatnonzero((table[first + tries + right] < 0).all(axis=1))):
            first += len(tries)
            if first + len(tries) + n > len(table):
                table = np.append(table, np.full(len(table), -1, np.int64))
        place[left] = first + free[0]
        table[place[left] + right] = (left << _ID) + np.fromiter(rows[left].values(), np.int64, len(right))
    table = table[: place.max() + n + 1]
    return place, np.where(table < 0, (_LEAST_NONE - 1) << _ID, table)


def buckets(df: DataFrame, weight: Column) -> DataFrame:
    """The rows ``key``, ``value`` of a small table as one row, whose value is for ``looked_up``. In a bucket
    those of largest weight come first."""
    slot = F.hash("key").bitwiseAND(_BUCKETS - 1).cast("long").alias("id")
    filled = df.groupBy(slot).agg(F.sort_array(F.collect_list(F.struct((-weight).alias("w"), "key", "value"))).alias("entries"))
    every = df.sparkSession.range(_BUCKETS).join(filled, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", "entries"))).alias("all"))
    entries = F.transform("all", lambda b: F.transform(b["entries"], lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return every.select(entries.alias("value"))


def looked_up(table: Column, key: Column) -> Column:
    """The value of a key, null without one."""

    def found(bucket: Column) -> Column:
        first = F.get(bucket, F.lit(0))
        rest = F.get(F.filter(bucket, lambda e: e["key"] == key), F.lit(0))["value"]
        return F.when(first["key"] == key, first["value"]).otherwise(rest)

    return let(F.get(table, F.hash(key).bitwiseAND(_BUCKETS - 1)), found)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the end of a fold over nothing. (Taking the element of a ``transform`` of
    one would go through the types of the whole body for every value.)"""
    return F.aggregate(F.array(), value, lambda v, _: v, body)


class ByteBpe:
    """Encoding and decoding columns for the ranks of a file and a splitting pattern."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        pieces = sorted(ranks, key=ranks.__getitem__)
        if [ranks[p] for p in pieces] != list(range(len(pieces))) or len(pieces) > 0xD800:
            raise ValueError("ranks must be 0 to n-1, with n at most 55296")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs a rank")
        self.pattern = "(?U)" + pattern  # white space of all of Unicode
        self.edge = len(pieces)
        made = defaultdict(dict)
        for p, r in ranks.items():
            for i in range(1, len(p)):
                a, b = ranks.get(p[:i]), ranks.get(p[i:])
                if a is not None and b is not None:
                    made[a][b] = r
        place, pairs = placed(made, self.edge)
        chars = pa.array([chr(r) for r in range(len(pieces))])
        one = {
            "of_byte": pa.array([ranks[bytes([b])] for b in range(256)], pa.int32()),
            "place": pa.array(place),
            "pairs": pa.array(pairs),
            "chars": chars,
            "pieces": pa.array([p.hex() for p in pieces]),
        }
        row = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in one.items()})
        self.spark, self.variables = spark, []
        self.tables = dict(zip(one, self.literals(spark.createDataFrame(row))))
        listed = pa.table({"key": pa.array([p.decode("latin-1") for p in pieces]), "value": chars})
        (self.ranks,) = self.literals(buckets(spark.createDataFrame(listed), F.lit(0)))

    def literals(self, row: DataFrame) -> list[Column]:
        """The columns of one row, arrays, as literals in the plan of any table that uses them until ``close``."""
        names = [f"byte_bpe_{uuid.uuid4().hex}" for _ in row.columns]
        for name, field in zip(names, row.schema):
            self.spark.sql(f"DECLARE VARIABLE {name} {field.dataType.simpleString()}")
            self.variables.append(name)
        self.spark.sql(f"SET VARIABLE ({', '.join(names)}) = (SELECT * FROM {{row}})", row=row)
        return [F.col(name) for name in names]

    def close(self) -> None:
        """Drops the variables. Tables that were built with them have their values."""
        while self.variables:
            self.spark.sql(f"DROP TEMPORARY VARIABLE {self.variables.pop()}")

    def bound(self, body) -> Column:
        """``body`` of the buckets of pieces and of the other tables, bound once for all their uses, so that the plan
        has each once."""
        names = ["of_byte", "place", "pairs", "chars"]

        def inner(ranks: Column, tables: dict[str, Column]) -> Column:
            if len(tables) == len(names):
                return body(ranks, tables)
            name = names[len(tables)]
            return let(self.tables[name], lambda t: inner(ranks, {**tables, name: t}))

        return let(self.ranks, lambda ranks: inner(ranks, {}))

    def split(self, text: Column) -> Column:
        """The matches of the pattern, in order; together they are the text."""
        return F.regexp_extract_all(text, F.lit(f"({self.pattern})"), F.lit(1))

    def short_word(self, chars: Column, tables: dict[str, Column]) -> Column:
        """The ids of a word, given as a character for each byte, by single merges."""
        place, pairs, of_id = tables["place"], tables["pairs"], tables["chars"]

        def rank(left: Column, right: Column) -> Column:
            """The rank of two ids as a character, ``_NONE`` without one."""
            # The entry's left id goes if it is this one; if not, what stays is no rank.
            found = F.get(pairs, F.get(place, left) + right).bitwiseXOR(F.shiftleft(left.cast("long"), _ID))
            return let(found, lambda r: F.when(r < _LEAST_NONE, F.get(of_id, r)).otherwise(_NONE))

        def id_at(ids: Column, i: Column) -> Column:
            return F.ascii(F.substring(ids, i, F.lit(1)))

        def folded(ids: Column) -> Column:
            # With an edge on both sides, the rank at i (from 1) is that of the ids at i and i + 1.
            edge = F.lit(chr(self.edge))
            beside = F.transform(ids, lambda a, i: rank(a, F.coalesce(F.get(ids, i + 1), F.lit(self.edge))))
            own = F.transform(ids, lambda a: F.get(of_id, a))
            start = F.struct(
                F.concat(edge, F.array_join(own, ""), edge).alias("ids"),
                F.concat(F.lit(_NONE), F.array_join(beside, "")).alias("ranks"),
            )

            def step(s: Column, _: Column) -> Column:
                return let(
                    F.array_min(F.split(s["ranks"], "")),
                    lambda best: F.when(best == _NONE, s).otherwise(
                        let(s["ids"], lambda ids: let(s["ranks"], lambda ranks: let(F.instr(ranks, best), lambda i: joined(ids, ranks, best, i))))
                    ),
                )

            steps = F.sequence(F.lit(2), F.size(ids))
            return F.aggregate(steps, start, step, lambda s: F.substring(s["ids"], F.lit(2), F.length(s["ids"]) - 2))

        def joined(ids: Column, ranks: Column, best: Column, i: Column) -> Column:
            rest, new = F.substring(ids, i + 2, F.lit(_LEAST_NONE)), F.ascii(best)
            before, after = rank(id_at(ids, i - 1), new), rank(new, F.ascii(rest))
            return F.struct(
                F.concat(F.substring(ids, F.lit(1), i - 1), best, rest).alias("ids"),
                F.concat(F.substring(ranks, F.lit(1), i - 2), before, after, F.substring(ranks, i + 2, F.lit(_LEAST_NONE))).alias("ranks"),
            )

        ids = F.transform(F.split(chars, ""), lambda c: F.get(tables["of_byte"], F.ascii(c)))
        return F.when(F.length(chars) > 1, let(ids, folded)).otherwise(F.get(of_id, F.get(tables["of_byte"], F.ascii(chars))))

    def merged(self, state: Column, ranks: Column) -> Column:
        """The state with the pair of lowest rank merged wherever it stands, from left to right; null
        if no pair has a rank."""

        def of_parts(parts: Column) -> Column:
            # Every part has a mark of its own on both sides, so between two there is an empty one.
            # Rank and place in one number, so that the least is the leftmost of lowest rank.
            ranked = F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(parts) - 4, F.lit(1)), F.lit(2)),
                lambda i: F.ascii(let(F.concat(F.get(parts, i), F.get(parts, i + 2)), lambda p: looked_up(ranks, p))).cast("long") * _PLACES + i,
            )
            return let(F.array_min(ranked), lambda best: replaced(parts, (best % _PLACES).cast("int")))

        def replaced(parts: Column, i: Column) -> Column:
            a, b, mark = F.get(parts, i), F.get(parts, i + 2), F.lit(_MARK)
            return F.replace(state, F.concat(mark, a, F.lit(2 * _MARK), b, mark), F.concat(mark, a, b, mark))

        return let(F.split(state, _MARK), of_parts)

    def encode_word(self, word: Column, ranks: Column, tables: dict[str, Column]) -> Column:
        """The ids of one match of the pattern. ``ranks`` and ``tables`` are as in ``bound``."""

        def folded(chars: Column) -> Column:
            start = F.concat(F.lit(_MARK), F.array_join(F.split(chars, ""), 2 * _MARK), F.lit(_MARK))
            state = F.struct(start.alias("parts"), F.lit(False).alias("done"))

            def step(s: Column, _: Column) -> Column:
                merged = let(
                    self.merged(s["parts"], ranks),
                    lambda m: F.struct(F.coalesce(m, s["parts"]).alias("parts"), m.isNull().alias("done")),
                )
                return F.when(s["done"], s).otherwise(merged)

            def ids(end: Column) -> Column:
                own = F.filter(F.split(end, _MARK), lambda p: p != "")
                return F.array_join(F.transform(own, lambda p: looked_up(ranks, p)), "")

            steps = F.sequence(F.lit(1), F.length(chars))
            return let(F.aggregate(steps, state, step, lambda s: s["parts"]), ids)

        def known(chars: Column) -> Column:
            return F.coalesce(looked_up(ranks, chars), F.when(F.length(chars) < LONG, self.short_word(chars, tables)).otherwise(folded(chars)))

        return let(F.decode(word.cast("binary"), "ISO-8859-1"), known)

    def frequent(self, df: DataFrame, text: str) -> Column:
        """The most frequent words of the table with their ids, as buckets: all with some count or more, at most
        ``FREQUENT``. Only numbers of words by count come to Python."""
        words = df.select(F.explode(self.split(df[text])).alias("key")).filter(F.length("key") <= FREQUENT_CHARS)
        counted = written(words.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "words")
        sizes = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(FREQUENT).collect()
        least, total = None, 0
        for row in sizes:
            total += row["words"]
            if total > FREQUENT:
                break
            least = row["n"]
        found = counted.filter(F.col("n") >= F.lit(least).cast("long"))
        ids = self.bound(lambda ranks, tables: self.encode_word(F.col("key"), ranks, tables))
        return self.literals(buckets(found.select("key", ids.alias("value"), "n"), F.col("n")))[0]

    def encode(self, text: Column, frequent: Column) -> Column:
        """The ids of a text as characters, null counting as empty."""
        words = self.split(F.coalesce(text, F.lit("")))

        def encoded(known: Column, ranks: Column, tables: dict[str, Column]) -> Column:
            found = F.transform(words, lambda w: F.coalesce(looked_up(known, w), self.encode_word(w, ranks, tables)))
            return F.array_join(found, "")

        return let(frequent, lambda known: self.bound(lambda ranks, tables: encoded(known, ranks, tables)))

    def decode(self, ids: Column) -> Column:
        """The bytes of the pieces of ids, which are characters, concatenated. An id outside the
        vocabulary gives null."""
        hexes = let(self.tables["pieces"], lambda pieces: F.transform(each(ids), lambda c: F.get(pieces, F.ascii(c))))
        return F.unhex(F.array_join(hexes, "", "-"))


def each(ids: Column) -> Column:
    """The single ids, still as characters."""
    return F.when(F.length(ids) > 0, F.split(ids, "")).otherwise(F.array().cast("array<string>"))


def as_numbers(ids: Column) -> Column:
    """Ids as an array of numbers."""
    return F.transform(each(ids), lambda c: F.ascii(c))


def little_endian(ids: Column) -> Column:
    """Ids as unsigned 32-bit integers, low byte first: each is two units of UTF-16, itself and zero."""
    zero = F.lit("\x00")
    return F.encode(F.when(F.length(ids) > 0, F.concat(F.array_join(F.split(ids, ""), "\x00"), zero)).otherwise(""), "UTF-16LE")


def encode_decode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """``df`` with two more columns: the ids of ``text``, as 32-bit integers in a binary, low byte first, and
    the bytes they decode to.

    Null and empty texts give no ids and no bytes. Repeated rows and null ids stay as
    they are; an empty table gives an empty one. If a new name is taken, underscores
    are added to it. A long text is one row's string; a long word takes one pass over its
    bytes for each kind of merge in it.
    """
    bpe = ByteBpe(df.sparkSession, read_ranks(ranks_path), pattern)
    ids, decoded, chars = free_name(df, ids), free_name(df, decoded), free_name(df, "id_characters")
    encoded = df.withColumn(chars, bpe.encode(df[text], bpe.frequent(df, text)))
    coded = encoded.select(*(encoded[c] for c in df.columns), little_endian(F.col(chars)).alias(ids), bpe.decode(F.col(chars)).alias(decoded))
    bpe.close()
    return coded
