"""Fill-in-the-middle: a text's lines cut into prefix, middle and suffix, and put in another order.

Secondary sort. A text is emitted as pieces, each a run of its lines, with its place in the output; pieces are
dealt by document and sorted by document and place within the partitions, so that
whoever reads a partition sees each output from its start to its end and holds one piece at a time. ``digests``
reads the pieces so into a running digest of the output, finds the marks again in what it
reads, and sends each piece on with its place in the text; a second sort within the same partitions
puts the text together again, and a second running digest is that of the restored text.

Cuts and form depend only on the seed and the id, by a SHA-256, so a rerun gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of whole lines in a piece; a longer line is cut.
CHUNK = 1 << 14
#: Bytes of pieces that go from a task to Spark at once.
SENT = 1 << 22


@dataclass(frozen=True)
class Recipe:
    """How texts are cut: of 100 texts ``rate`` are, ``spm`` of these suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    chunk: int = CHUNK

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix_mark.encode(), self.suffix_mark.encode(), self.middle_mark.encode()


#: The order of the sections in an output, by form; a section's number is its place in the text.
SECTIONS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}


def _cut(raw: bytes, doc, recipe: Recipe) -> tuple[str, int, list[tuple[int, int]], np.ndarray]:
    """Form, number of lines, the three sections' spans, and the line ends."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if raw and (not len(ends) or ends[-1] < len(raw)):
        ends = np.append(ends, len(raw))
    n = len(ends)
    digest = hashlib.sha256(f"{recipe.seed}:{'' if doc is None else doc}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    if not raw or any(m in raw for m in recipe.marks) or h3 % 100 >= recipe.rate:
        return "plain", n, [(0, len(raw))], ends
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (first, second))
    return ("spm" if h4 % 100 < recipe.spm else "psm"), n, [(0, a), (a, b), (b, len(raw))], ends


def _chunks(a: int, b: int, ends: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """``a`` to ``b`` in runs of whole lines of at most ``chunk`` bytes; longer lines are cut."""
    while a < b:
        stop = min(a + chunk, b)
        if stop < b:
            i = np.searchsorted(ends, stop, "right")
            if i and ends[i - 1] > a:
                stop = int(ends[i - 1])
        yield a, stop
        a = stop


def _in_pieces(raw: bytes, doc, recipe: Recipe) -> Iterator[tuple]:
    """form, n, prefix_chars, middle_chars (these four with the first piece only) and the piece."""
    form, n, spans, ends = _cut(raw, doc, recipe)
    prefix_mark, suffix_mark, middle_mark = recipe.marks
    if form == "plain":
        head = (form, n, None, None)
    else:
        head = (form, n, *(len(raw[a:b].decode()) for a, b in spans[:2]))
    first = True
    for section in SECTIONS[form]:
        a, b = spans[section]
        runs = [raw[i:j] for i, j in _chunks(a, b, ends, recipe.chunk)]
        if form != "plain":
            runs.insert(0, (prefix_mark, middle_mark, suffix_mark)[section])
        for piece in runs or [b""]:
            yield *(head if first else (None,) * 4), piece
            first = False


def output_pieces(df: DataFrame, recipe: Recipe = Recipe(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The outputs as pieces, a partition's sorted by document and place.

    Columns: doc_id; copy, which tells rows with one id apart; place; piece, bytes of the output; and with the
    first piece form, n (lines), prefix_chars and middle_chars. Concatenated by place the pieces
    are the output. ``plain`` are empty texts, those that have a mark, and those that ``rate`` leaves out.
    A null text is an empty one; a null id counts as an empty string in the hash. Repeated rows
    each have pieces of their own. Other columns are not read; an empty table gives none. A
    piece has at most ``chunk`` bytes; a mark is a piece.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, copy bigint, part bigint, place int, form string, n bigint, prefix_chars bigint, middle_chars bigint, piece binary"
    arrow = pa.schema(
        [("copy", pa.int64()), ("part", pa.int64()), ("place", pa.int32()), ("form", pa.string()), ("n", pa.int64()),
         ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("piece", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, held, size = batch.column(0), [], [], 0

            def sent() -> pa.RecordBatch:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*held), arrow)]
                ids = docs.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *arrow.names])

            copies, parts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, doc in enumerate(docs.to_pylist()):
                raw = batch.column(1)[i].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                for place, (*head, piece) in enumerate(_in_pieces(raw, doc, recipe)):
                    at.append(i)
                    held.append((copies[i], parts[i], place, *head, piece))
                    size += len(piece) + 50
                    if size >= SENT:
                        yield sent()
                        at, held, size = [], [], 0
            if held:
                yield sent()

    # Dealt by what a row holds, so a task that is run again sends it to the same place; rows that
    # repeat are dealt by the task that reads them too, and told apart by number.
    part = F.xxhash64(df[doc_id], df[text], F.spark_partition_id())
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"), F.monotonically_increasing_id().alias("copy"), part.alias("part"))
    pieces = rows.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part", "copy", "place")
    return pieces.select("doc_id", "copy", "place", "form", "n", "prefix_chars", "middle_chars", "piece", "part")


class _Restorer:
    """Reads one output piece by piece; gives each piece its section of the text."""

    def __init__(self, form: str, recipe: Recipe):
        prefix_mark, suffix_mark, middle_mark = recipe.marks
        self.section_of = {} if form == "plain" else {prefix_mark: 0, middle_mark: 1, suffix_mark: 2}
        self.section = 0
        self.output = hashlib.sha256()

    def read(self, piece: bytes) -> int | None:
        self.output.update(piece)
        if piece in self.section_of:
            self.section = self.section_of[piece]
            return None
        return self.section


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """Rows of sorted batches with the key of the output they belong to."""
    for batch in batches:
        for row in batch.to_pylist():
            yield (row["part"], row["copy"]), row


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, bytes_of: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += bytes_of(row)
        if size >= SENT:
            yield sent()
            held, size = [], 0
    if held:
        yield sent()


def digests(pieces: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """A row for each output: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    ``pieces`` are those of ``output_pieces``, in its order. The text is restored from
    the output's pieces and its form alone. A task holds one batch of pieces.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint"

    def read_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(first: pa.RecordBatch) -> Iterator[tuple]:
            key = head = reader = None
            place = 0

            def ended() -> tuple:
                return (*key, 3, place, None, *head, reader.output.hexdigest())

            for own, row in _by_document(_chained(first, batches)):
                if own != key:
                    if key is not None:
                        yield ended()
                    key, place = own, 0
                    head = (row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"])
                    reader = _Restorer(row["form"], recipe)
                section = reader.read(row["piece"])
                if section is not None:
                    yield (*key, section, place, row["piece"], *(None,) * 6)
                place += 1
            if key is not None:
                yield ended()

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("part", pa.int64()), ("copy", pa.int64()), ("section", pa.int32()), ("place", pa.int32()), ("piece", pa.binary()),
             first.schema.field("doc_id"), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
             ("middle_chars", pa.int64()), ("output_sha256", pa.string())]
        )
        yield from _in_batches(rows(first), schema, lambda r: len(r[4] or b"") + 60)

    def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(first: pa.RecordBatch) -> Iterator[tuple]:
            text = hashlib.sha256()
            for _, row in _by_document(_chained(first, batches)):
                if row["section"] < 3:
                    text.update(row["piece"])
                else:
                    head = (row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))
                    yield *head, text.hexdigest()
                    text = hashlib.sha256()

        first = next(batches, None)
        if first is None:
            return
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
        schema = pa.schema([*[first.schema.field(c) for c in names], ("restored_sha256", pa.string())])
        yield from _in_batches(rows(first), schema, lambda r: 250)

    placed = pieces.mapInArrow(
        read_outputs, f"part bigint, copy bigint, section int, place int, piece binary, {fields}, output_sha256 string"
    )
    # The pieces of an output are in one partition already.
    again = placed.sortWithinPartitions("part", "copy", "section", "place")
    return again.mapInArrow(read_texts, f"{fields}, output_sha256 string, restored_sha256 string")


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def texts(pieces: DataFrame) -> DataFrame:
    """The outputs as whole texts: doc_id, n, form, prefix_chars, middle_chars, output.

    A task holds one batch of pieces and one output.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(first: pa.RecordBatch) -> Iterator[tuple]:
            key, head, held = None, None, []
            for own, row in _by_document(_chained(first, batches)):
                if own != key:
                    if key is not None:
                        yield *head, b"".join(held)
                    key, held = own, []
                    head = tuple(row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars"))
                held.append(row["piece"])
            if key is not None:
                yield *head, b"".join(held)

        first = next(batches, None)
        if first is None:
            return
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        schema = pa.schema([*[first.schema.field(c) for c in names], ("output", pa.string())])
        yield from _in_batches(rows(first), schema, lambda r: len(r[5]) + 50)

    return pieces.mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: str, form: str, recipe: Recipe = Recipe()) -> str:
    """The text of one output."""
    if form == "plain":
        return output
    front, _, middle = output.partition(recipe.middle_mark)
    if form == "psm":
        prefix, _, suffix = front[len(recipe.prefix_mark) :].partition(recipe.suffix_mark)
    else:
        suffix, _, prefix = front[len(recipe.suffix_mark) :].partition(recipe.prefix_mark)
    return prefix + middle + suffix
