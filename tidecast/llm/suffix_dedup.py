"""Removal of repeated passages, by bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of ``LENGTH`` bytes over it also starts in a document with a
smaller id. Equal strings meet in one task as follows. Of the 16-byte strings within a window
of ``LENGTH`` bytes the one with the least hash names the window; neighbouring windows with one
name are a piece of the text. Equal windows have equal names, wherever they stand.

1. Names only are shuffled (some bytes for each piece, packed), and those that occur in two
   documents or more are found. All other pieces cannot hold a repeat.
2. The texts of those pieces are shuffled by name. Each task sorts the suffixes of its
   different pieces to the needed depth and takes their Burrows-Wheeler order. The intervals of
   suffixes that agree in l bytes are extended backward by one byte, all of a level at once:
   two neighbours part at l + 1 exactly if what follows their first byte parts at l. So common
   prefixes come by increasing value, and the expansion stops at ``LENGTH``. What is then one
   interval is one string; its smallest document keeps it.
3. The spans are joined to their documents and united.

Before either shuffle a task sends each name, and each piece's text, once for every
``DEAL`` bytes, however many documents have it: of equal pieces the one of the smallest
document stands for the others, whose spans are then known without it. Copies in a third of all
rows so cost as much as a few. The number of parts follows the bytes of all texts, so a part stays
as large as ``PART`` at any size. A task sends each part one row for every ``DEAL`` bytes, since rows that
are packed for many parts from little text cost more than what is in them. A name is compared within its part only, so
chance gives few unlike pieces one name at any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import free_name, in_arrow, slices, written

LENGTH, SEED_BYTES = 50, 16
#: Bytes of text that a task names at once, bytes of text for each part, and bytes that a task deals to the parts at once.
CHUNK, PART, DEAL = 2 << 20, 8 << 20, 32 << 20
#: Parts for each share of the documents, to which parts send what they find, and least shares if there are as many parts.
SHARE, SHARES = 4, 32

#: Packed rows.
_CODEC = pa.Codec("zstd", compression_level=5)
_HASH, _SPAN, _FLAG, _ID = (np.dtype(x) for x in ("<u4", "<i4", "i1", "<i8"))
_END = np.uint8(255)  # in no UTF-8 text
_TABLE = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE, _MIX = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)
_KEY = "doc_id bigint, text_hash bigint"


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED_BYTES`` bytes from each position on (a power of two)."""
    h, n = _TABLE[data], 1
    while n < SEED_BYTES:
        h = h[:-n] * _powers(n) + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def pieces(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place and name (which make up its whole name), text number, start in the text and length of each piece of texts
    joined to ``data``."""
    if len(data) < LENGTH:
        return *(np.zeros(0, np.uint32) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(3))
    names = sliding_min(seed_hashes(data), LENGTH - SEED_BYTES + 1)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(names)
    valid = np.arange(n) + LENGTH <= ends[doc[:n]]
    # A text's last windows are followed by positions without one, so no piece spans two texts.
    other = np.append(True, names[1:] != names[:-1])
    first = np.flatnonzero(valid & (other | ~np.append(False, valid[:-1])))
    last = np.flatnonzero(valid & (np.append(other[1:], True) | ~np.append(valid[1:], False)))
    own = doc[first]
    whole = names[first]  # the least of many: its high bits are not even
    whole = (whole ^ whole >> np.uint64(31)) * _MIX
    whole ^= whole >> np.uint64(29)
    return (whole >> np.uint64(32)).astype(_HASH), whole.astype(_HASH), own, first - (ends - sizes)[own], last - first + LENGTH


def taken(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as a binary column."""
    offsets = np.append(0, np.cumsum(size))
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])]
    )


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary or string column without nulls, and each value's size."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets).astype(np.int64)


def packed(columns: list[np.ndarray], content: bytes = b"") -> bytes:
    """Rows of some columns, the ids first, with bytes that belong to them: for each column a frame of its values' first
    bytes, then their second ones and so on; ids as differences, hashes as they are."""
    frames = []
    for i, c in enumerate(columns):
        c = c if i else np.diff(c, prepend=c.dtype.type(0))
        frames.append(c.tobytes() if c.dtype == _HASH else _CODEC.compress(c.view(np.uint8).reshape(len(c), -1).T.tobytes(), asbytes=True))
    frames.append(_CODEC.compress(content, asbytes=True))
    return b"".join([np.array([len(columns[0]), len(content), *map(len, frames)], _SPAN).tobytes(), *frames])


def unpacked(column: pa.ChunkedArray, kinds: list[np.dtype]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all packed rows, and their joined bytes."""
    columns, contents = [[] for _ in kinds], []
    for x in column:
        raw = x.as_py()
        at = (3 + len(kinds)) * _SPAN.itemsize
        n, n_content, *sizes = np.frombuffer(raw, _SPAN, 3 + len(kinds)).tolist()
        for i, (kind, size) in enumerate(zip(kinds, sizes)):
            frame = raw[at : at + size]
            at += size
            if kind == _HASH:
                values = np.frombuffer(frame, kind)
            else:
                planes = np.frombuffer(_CODEC.decompress(frame, n * kind.itemsize, asbytes=True), np.uint8)
                values = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind)[:, 0]
            columns[i].append(values if i else np.cumsum(values, dtype=kind))
        if n_content:
            contents.append(np.frombuffer(_CODEC.decompress(raw[at:], n_content, asbytes=True), np.uint8))
    return [np.concatenate(c) for c in columns], np.concatenate(contents) if contents else np.zeros(0, np.uint8)


def dealt(columns: list[np.ndarray], part: np.ndarray, content: pa.Array | None = None) -> pa.RecordBatch | None:
    """Rows, with bytes for each, as one packed row for each part, in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(part) else []
    if not len(cuts):
        return None
    content = content if content is None else content.take(pa.array(order))
    sent = []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = b"" if content is None else bytes_of(content.slice(a, b - a))[0].tobytes()
        sent.append(packed([c[order[a:b]] for c in columns], own))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[order][cuts].astype(np.int32)), pa.array(sent, pa.binary())], names=["part", "packed"]
    )


def spread(doc: np.ndarray, parts: int) -> np.ndarray:
    """A part for rows that only pass through: any, but not one for all."""
    return (doc.astype(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) % parts


def by_document(doc: np.ndarray, text_hash: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row for each document: its rows of ``values`` (int32) as bytes."""
    order = np.lexsort((text_hash, doc))
    doc, text_hash, values = doc[order], text_hash[order], np.ascontiguousarray(values[order], _SPAN)
    new = np.append(True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])) if len(doc) else np.zeros(0, bool)
    cuts = np.flatnonzero(new)
    width = values.shape[1] * _SPAN.itemsize
    offsets = np.append(cuts, len(doc)).astype(np.int64) * width
    raw = pa.Array.from_buffers(
        pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]
    )
    return pa.table({"doc_id": doc[cuts], "text_hash": text_hash[cuts], "found": pc.cast(raw, pa.binary())})


#: Columns of packed pieces: id, text's hash, start, size, place, kind and name; id, text's hash, start, size and whether it passes through.
_NAMED, _CUT = [_ID, _ID, _SPAN, _SPAN, _SPAN, _FLAG, _HASH], [_ID, _ID, _SPAN, _SPAN, _FLAG]


def _joined(held: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*held)]


def named_pieces(docs: DataFrame, parts: int) -> DataFrame:
    """Step 1 before the shuffle: ``part, packed``."""

    def sent(held):
        doc, text_hash, start, size, place, name = _joined(held)
        # Of each name the first of the smallest document, and whether others here have it.
        order = np.lexsort((doc, name, place))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (place[order][1:] != place[order][:-1]))
        group = np.cumsum(new) - 1
        least = doc[order][new]
        many = np.maximum.reduceat(doc[order], np.flatnonzero(new)) != least
        kind = np.empty(len(name), _FLAG)  # 0: sent by name, 1: so too, and known to repeat, 2: passes through
        kind[order] = np.where(new, many[group], np.where(many[group], 2, 0))
        part = np.where(kind == 2, spread(doc, parts), place)
        return dealt([doc, text_hash, start, size, place, kind, name], part)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            lengths = pc.binary_length(batch.column(2)).to_numpy()
            for a, b in slices(lengths, CHUNK):
                data, sizes = bytes_of(batch.column(2).slice(a, b - a))
                place, name, own, start, size = pieces(data, sizes)
                if len(name):
                    held.append((ids[a + own], hashes[a + own], start.astype(_SPAN), size.astype(_SPAN), (place % parts).astype(_SPAN), name))
                n += len(data)
                if held and n >= DEAL:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "part int, packed binary")


def repeated(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 1 after the shuffle: the pieces whose names occur in two documents (document, text's hash,
    and start, size and place)."""
    (doc, text_hash, start, size, place, kind, name), _ = unpacked(table.column("packed"), _NAMED)
    sent = np.flatnonzero(kind < 2)
    order = sent[np.lexsort((doc[sent], name[sent]))]
    keep = kind == 2
    if len(order):
        new = np.append(True, name[order][1:] != name[order][:-1])
        at = np.flatnonzero(new)
        several = (np.maximum.reduceat(doc[order], at) != doc[order][at]) | (np.maximum.reduceat(kind[order], at) > 0)
        keep[order] = several[np.cumsum(new) - 1]
    return doc[keep], text_hash[keep], np.stack([start, size, place], 1)[keep]


def cut_pieces(docs: DataFrame, parts: int, text: str) -> DataFrame:
    """Step 2 before the shuffle, from documents whose last columns are the id, the text's hash and a
    packed pieces. It takes all columns, so that the plan can use one exchange of the
    documents for this and for the last join."""
    at = docs.columns.index(text)

    def sent(held, contents):
        doc, text_hash, start, size, place = _joined(held)
        content = pa.concat_arrays(contents)
        # Of equal contents those of the smallest document stand for all: the others' windows
        # are all in it.
        coded = content.dictionary_encode()
        code = coded.indices.to_numpy()
        least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        through = doc > least[code]
        part = np.where(through, spread(doc, parts), place)
        content = pc.if_else(pa.array(through), pa.scalar(b""), content)
        return dealt([doc, text_hash, start, size, through.astype(_FLAG)], part, content)

    def run(batches):
        held, contents, n = [], [], 0
        for batch in batches:
            ids, hashes = (batch.column(batch.num_columns + i).to_numpy() for i in (-3, -2))
            texts, pieces_of = batch.column(at), batch.column(batch.num_columns - 1)
            for a, b in slices(pc.binary_length(texts).to_numpy(), CHUNK):
                data, sizes = bytes_of(texts.slice(a, b - a))
                begin = np.cumsum(sizes) - sizes
                found = [np.frombuffer(x, _SPAN).reshape(-1, 3) for x in pieces_of.slice(a, b - a).to_pylist()]
                own = np.repeat(np.arange(b - a), [len(x) for x in found])
                start, size, place = np.concatenate(found).T
                held.append((ids[a + own], hashes[a + own], start, size, place))
                contents.append(taken(data, begin[own] + start, size.astype(np.int64)))
                n += int(size.sum(dtype=np.int64))
                if n >= DEAL // 2:
                    yield sent(held, contents)
                    held, contents, n = [], [], 0
        if held:
            yield sent(held, contents)

    return docs.mapInArrow(run, "part int, packed binary")


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by their first ``depth`` bytes or more, and which rows differ from the
    row before in the first eight bytes."""
    n = len(data)
    padded = np.append(data, np.zeros(depth + 16, np.uint8)).astype(np.uint64)
    word = np.zeros(n + depth + 8, np.uint64)
    for i in range(8):
        word |= padded[i : i + len(word)] << np.uint64(8 * (7 - i))
    order = np.argsort(word[:n])
    key = word[order]
    eight = np.append(True, key[1:] != key[:-1])
    new, at = eight, 8
    while at < depth:
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))  # those still tied
        if not len(rows):
            break
        group = np.cumsum(new[rows], dtype=np.uint64)
        # The group and as many of the next bytes as fit beside it in one number.
        more = (64 - int(group[-1]).bit_length()) // 8
        suffix = order[rows]
        key = group << np.uint64(8 * more) | word[suffix + at] >> np.uint64(64 - 8 * more)
        by = np.argsort(key)
        order[rows], key = suffix[by], key[by]
        new = new.copy()
        new[rows[1:]] |= key[1:] != key[:-1]
        at += more
    return order, eight


def intervals(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and where intervals of suffixes that agree in ``length`` bytes begin."""
    order, begins = suffix_order(data, length)
    n = len(data)
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    row[n] = 0
    following = row[order + 1]  # where the rest of each row's suffix stands: backward extension read forward
    begins = begins.copy()
    level = 8
    open_rows = np.flatnonzero(~begins)
    while level < length and len(open_rows):
        # At this level the intervals of what follows, numbered; a byte in front keeps them apart.
        number = np.cumsum(begins, dtype=np.int32)
        parted = number[following[open_rows]] != number[following[open_rows - 1]]
        begins[open_rows[parted]] = True
        open_rows = open_rows[~parted]
        level += 1
    return order, begins


def owned(contents: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte position of the joined different contents (each followed by an end mark) the smallest
    owner of its ``LENGTH`` bytes, and each content's start."""
    data, sizes = bytes_of(contents)
    start = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(len(data) + len(sizes), _END, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    joined[at] = data
    own = np.repeat(owner, sizes + 1)
    inside = np.arange(len(joined)) - np.repeat(start, sizes + 1) + LENGTH <= np.repeat(sizes, sizes + 1)
    own = np.where(inside, own, np.iinfo(np.int64).max)
    order, begins = intervals(joined, LENGTH)
    at = np.flatnonzero(begins)
    least = np.minimum.reduceat(own[order], at)
    out = np.empty(len(joined), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(at, len(joined))))
    return out, start


def removed_spans(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 2 after the shuffle: spans to remove (document, text's hash, and start and stop)."""
    (doc, text_hash, start, size, through), data = unpacked(table.column("packed"), _CUT)
    through = through.astype(bool)
    spans = [np.stack([start, start + size], 1)[through]]
    keys = [np.stack([doc, text_hash], 1)[through]]
    here = np.flatnonzero(~through)
    if len(here):
        offsets = np.append(0, np.cumsum(size[here], dtype=np.int64)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code, contents = coded.indices.to_numpy(), coded.dictionary
        owner = np.full(len(contents), np.iinfo(np.int64).max)
        np.minimum.at(owner, code, doc[here])
        least, begin = owned(contents, owner)
        # All windows of all pieces, some at a time.
        n_windows = size[here].astype(np.int64) - LENGTH + 1
        for a, b in slices(n_windows.tolist(), 4 * CHUNK):
            n = n_windows[a:b]
            of = np.repeat(np.arange(a, b), n)
            w = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            gone = least[begin[code[of]] + w] < doc[here][of]
            of, w = of[gone], w[gone]
            if not len(of):
                continue
            first = np.append(True, (of[1:] != of[:-1]) | (w[1:] > w[:-1] + LENGTH))
            last = np.append(first[1:], True)
            piece = here[of[first]]
            spans.append(np.stack([start[piece] + w[first], start[piece] + w[last] + LENGTH], 1))
            keys.append(np.stack([doc[piece], text_hash[piece]], 1))
    key = np.concatenate(keys)
    return key[:, 0], key[:, 1], np.concatenate(spans)


def united(spans: bytes | None) -> np.ndarray:
    """Disjoint spans in order, none touching the next."""
    found = np.frombuffer(spans or b"", _SPAN).reshape(-1, 2).astype(np.int64)
    if not len(found):
        return found
    found = found[np.argsort(found[:, 0], kind="stable")]
    stop = np.maximum.accumulate(found[:, 1])
    new = np.append(True, found[1:, 0] > stop[:-1])
    return np.stack([found[new, 0], stop[np.append(new[1:], True)]], 1)


def _gathered(rows: DataFrame, fn, width: int, parts: int) -> DataFrame:
    """``fn`` over each part, and then all that was found of each document (``width`` numbers each) as one row.

    What a part finds is sent on packed, by shares of the documents, so that the rows between are
    as many as parts and shares and not as parts and documents.
    """
    shares = max(min(parts, SHARES), -(-parts // SHARE))
    kinds = [_ID, _ID, *[_SPAN] * width]

    def found(table: pa.Table) -> pa.Table:
        doc, text_hash, values = fn(table)
        order = np.lexsort((values[:, 0], doc))
        columns = [doc[order], text_hash[order], *values[order].astype(_SPAN).T]
        sent = dealt([np.ascontiguousarray(c) for c in columns], spread(doc[order], shares))
        if sent is None:
            return pa.table({"part": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
        return pa.Table.from_batches([sent])

    def gathered(table: pa.Table) -> pa.Table:
        (doc, text_hash, *values), _ = unpacked(table.column("packed"), kinds)
        return by_document(doc, text_hash, np.stack(values, 1))

    sent = rows.groupBy("part").applyInArrow(found, "part int, packed binary")
    return sent.groupBy("part").applyInArrow(gathered, f"{_KEY}, found binary")


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one more column, ``spans`` (underscores are added if it is taken): the byte spans to
    remove from ``text``, packed pairs of start and stop, or null.

    Matches do not cross documents; rows with one id are one document's, so they remove nothing from
    each other. Texts that are null or shorter than ``LENGTH`` bytes have none. Rows with a null id
    have no place in the order: nothing is removed from them or because of them. An empty table gives
    an empty one.
    """
    spans, id_, hash_ = (free_name(df, x) for x in ("spans", "spans_id", "spans_hash"))
    fit = df[doc_id].isNotNull() & (F.octet_length(df[text]) >= LENGTH)
    # A text's hash tells rows with one id apart. Every piece takes it along, and it does not compress, so it is zero elsewhere.
    number = df[doc_id].cast("bigint")
    again = df.filter(number.isNotNull()).groupBy(number.alias(id_)).count().filter("count > 1")
    again = written(again.select(id_, F.lit(True).alias(hash_)), "repeated-ids")
    keyed = df.withColumn(id_, F.coalesce(number, F.lit(0))).join(again, id_, "left")
    keyed = keyed.withColumn(hash_, F.when(F.col(hash_), F.xxhash64(df[text])).otherwise(F.lit(0).cast("bigint")))
    docs = keyed.filter(fit)
    own = docs.select(F.col(id_).alias("doc_id"), F.col(hash_).alias("text_hash"), F.col(text).alias("text"))
    total = own.select(F.sum(F.octet_length("text").cast("bigint"))).collect()[0][0] or 0
    parts = max(1, -(-total // PART))

    def as_keys(found: DataFrame) -> DataFrame:
        return found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("found").alias(spans))

    candidates = as_keys(_gathered(named_pieces(own, parts), repeated, 3, parts))
    # Columns of the documents come first, then the keys and the pieces.
    wanted = docs.join(candidates, [id_, hash_]).select(*df.columns, id_, hash_, spans)
    found = as_keys(_gathered(cut_pieces(wanted, parts, text), removed_spans, 2, parts))
    marked = docs.join(found, [id_, hash_], "left").select(*df.columns, spans)
    rest = df.filter(~F.coalesce(fit, F.lit(False)))
    return marked.unionByName(rest.withColumn(spans, F.lit(None).cast("binary")))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, from ``repeats``."""
    # No new names here: renamed columns would keep the plan from using one exchange of the texts.
    marked = repeats(df.select(df[doc_id], df[text]), doc_id, text)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for value, found in zip(batch.column(1), batch.column(2).to_pylist()):
            raw, spans = (value.as_py() or "").encode(), united(found)
            n_bytes.append(len(raw))
            n_removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            n_spans.append(len(spans))
            kept.append(hashlib.sha256(without(raw, spans)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return in_arrow(marked, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the repeats taken out of ``text``. Bytes of a character that is cut in two go with it."""
    marked = repeats(df, doc_id, text)
    spans = marked.columns[-1]
    columns = [c for c in marked.columns if c != spans]
    at = columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            None if value is None else value if found is None else without(value.encode(), united(found)).decode(errors="ignore")
            for value, found in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist())
        ]
        arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return in_arrow(marked.select(*columns, spans), run, df.schema)
