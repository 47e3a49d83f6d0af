"""WARC archives as seekable Zstandard bundles.

A bundle is one file: a frame with a ``warcinfo`` record; frames of whole records, each compressed by
itself; a skippable frame with the index, which maps record identifiers to the frame and the place within
the frame's decompressed bytes; and the seek table of Zstandard's seekable format, with a checksum for each
frame. A reader finds the seek table at the file's end, and through it and the index any record,
for which it decompresses one frame. Any Zstandard decoder reads the whole.

Spark's text writer makes the files, so they can be in any store that Spark reaches and a lost
executor's files are written again: a bundle is the text of one row, and its line end is the last three bytes of
the seek table's magic number, which are valid UTF-8.

Equal payloads are stored once. The record with the largest id has the payload; the others are ``revisit``
records that name it. Payloads are grouped by their SHA-256, and only the groups with several rows are joined
back; they are written first, so Spark knows their size, broadcasts them if they are small, and
otherwise splits the groups that are too large for one task.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import written
from tidecast.sources.scratch import fresh_dir

#: Payloads below so many bytes are stored each time.
LEAST = 1000
#: Bytes of records in a frame; compressed bytes after which a bundle is closed.
FRAME, BUNDLE = 1 << 18, 1 << 23
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the formats: WARC 1.1, Zstandard's skippable frames and its seekable format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE = 0x184D2A50, 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_MAGIC = struct.pack("<I", SEEKABLE_MAGIC)
_LINE_END = _MAGIC[1:].decode()
_ID = "urn:record:"


def record_id(key) -> str:
    """The identifier of the record of a row; a null id has one too."""
    return f"<{_ID}{'' if key is None else quote(str(key), safe='')}>"


def key_of(identifier: str) -> str | None:
    """The id in a record's identifier, as text."""
    return unquote(identifier[len(_ID) + 1 : -1]) or None


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None, key) -> str:
    """The URL without blanks and control characters, which would break the header."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: quote(m[0]), url or "") or record_id(key)[1:-1]


def to_record(key, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of the row ``refers_to`` without the payload.

    The HTTP header has the payload's length in both.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, key)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return _record(fields, http + payload)
    return _record([*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))], http)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """A bundle that is being filled; ``close`` gives its bytes."""

    def __init__(self, name: str, frame: int = FRAME):
        self.frame = frame
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.parts: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open = bytearray()
        self.size = 0
        info = f"software: tidecast\r\nformat: {VERSION}\r\n".encode()
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:bundle:{quote(name)}>"), ("WARC-Date", DATE)]
        self.open += _record([*fields, ("Content-Type", "application/warc-fields")], info)
        self._frame()

    def _frame(self) -> None:
        if self.open:
            raw = bytes(self.open)
            packed = self.compressor.compress(raw)
            self.parts.append(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(packed)
            self.open = bytearray()

    def add(self, identifier: str, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame:
            self._frame()
        self.index.append((identifier, len(self.table), len(self.open), len(record)))
        self.open += record

    def close(self) -> bytes:
        self._frame()
        index = _skippable(SKIPPABLE_INDEX, self.compressor.compress(json.dumps(self.index).encode()))
        # Skippable frames have an entry too; they decompress to nothing.
        table = [*self.table, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        entries = b"".join(struct.pack("<III", *entry) for entry in table)
        footer = struct.pack("<IB", len(table), CHECKSUMS) + _MAGIC
        return b"".join([*self.parts, index, _skippable(SKIPPABLE_SEEK_TABLE, entries + footer)])


class SeekableReader:
    """Random access to the records of a bundle."""

    def __init__(self, content: bytes):
        self.content = content
        n, flags, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        at = len(content) - 9 - 12 * n
        if struct.unpack("<II", content[at - 8 : at]) != (SKIPPABLE_SEEK_TABLE, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.table = list(struct.iter_unpack("<III", content[at:-9]))
        self.starts = [0]
        for packed, _, _ in self.table:
            self.starts.append(self.starts[-1] + packed)
        if self.starts[-1] != at - 8:
            raise ValueError("the seek table does not fit the file")
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        raw = self.decompressor.decompress(self.content[self.starts[i] : self.starts[i + 1]])
        _, size, checksum = self.table[i]
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def index(self) -> list[tuple[str, int, int, int]]:
        """``(identifier, frame, offset, length)`` of each record, the offset within the frame's bytes."""
        content = self.content[self.starts[-2] + 8 : self.starts[-1]]
        return [tuple(row) for row in json.loads(self.decompressor.decompress(content))]

    def records(self) -> Iterator[bytes]:
        """All records by the index, each frame decompressed once."""
        last, raw = -1, b""
        for _, frame, offset, length in self.index():
            if frame != last:
                last, raw = frame, self.frame(frame)
            yield raw[offset : offset + length]


def parse(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and the payload's stated length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, payload, int(http.rpartition(b"Content-Length: ")[2])


def _with_winners(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, payload, digest, refers_to of each row."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    same = F.when(F.octet_length("payload") >= LEAST, F.unhex(F.sha2("payload", 256)))
    groups = (
        rows.select("key", same.alias("same"))
        .filter("same IS NOT NULL")
        .groupBy("same")
        .agg(F.max("key").alias("winner"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    groups = written(groups, "equal-payloads")
    # Small payloads match no group; a key of their own spreads them.
    spread = F.coalesce(same, F.to_binary(F.hex(F.xxhash64("key")), F.lit("hex")))
    joined = rows.withColumn("same", spread).join(groups, "same", "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("key", "url", "payload", F.sha1("payload").alias("digest"), refers.alias("refers_to"))


def write_archive(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    frame: int = FRAME, bundle: int = BUNDLE,
) -> None:
    """A record for each row, in bundles at ``path``.

    A null ``html`` is an empty payload; a null URL is replaced by the record's identifier. Of rows with equal
    payloads of ``LEAST`` bytes or more the one with the largest id is the response, and where
    rows tie on that id each of them is; rows with a null id revisit it too, and if all ids are
    null each is a response. Repeated rows have a record each, with the same identifier. Other
    columns are not read. An empty table gives no bundle. A task holds one bundle, which
    is closed after ``bundle`` bytes, or one longer record; ``frame`` bytes of records are compressed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        filled = None

        def closed() -> pa.RecordBatch:
            # The line end completes the magic number.
            return pa.RecordBatch.from_arrays([pa.array([filled.close()[:-3]], pa.binary())], names=["value"])

        for batch in batches:
            keys, urls, payloads, digests, refers = batch.columns
            for i in range(batch.num_rows):
                if filled is None:
                    filled, made = Bundle(f"{part}-{made}", frame), made + 1
                k = keys[i].as_py()
                record = to_record(k, urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), refers[i].as_py())
                filled.add(record_id(k), record)
                if filled.size >= bundle:
                    yield closed()
                    filled = None
        if filled is not None:
            yield closed()

    bundles = _with_winners(pages, key, url, html).mapInArrow(run, "value binary")
    # The bytes are no text; the writer passes them on as they are.
    text = bundles.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", _LINE_END).option("maxRecordsPerFile", 1).text(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")


def read_archive(spark: SparkSession, path: str, key_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of an archive: key, payload_bytes, payload_digest (hex), record_type, refers_to, payload.

    ``payload`` is null for revisits, and for all with ``payloads=False``. A response's payload
    is held against its digest and its length, every frame against its checksum. A bundle is in one task.
    """
    schema = pa.schema(
        [("key", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )

    def rows(content: bytes) -> Iterator[tuple]:
        for record in SeekableReader(content).records():
            fields, payload, size = parse(record)
            kind, digest = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
            refers = key_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
            shown = payload if payloads and kind == "response" else None
            yield key_of(fields["WARC-Record-ID"]), size, digest, kind, refers, shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += len(row[5] or b"") + 200
                    if size >= BUNDLE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    out = "key string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
    found = _bundles(spark, path).select("content").mapInArrow(run, out)
    cast = {c: F.col(c).cast(key_type) for c in ("key", "refers_to")}
    return found.withColumns(cast)


def index(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """Where each record is: key, bundle (its file), frame, offset and length within the frame's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = SeekableReader(content.as_py()).index()
                keys, frames, offsets, lengths = zip(*[(key_of(i), f, o, n) for i, f, o, n in found])
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(keys, pa.string()),
                        "bundle": pa.array([file] * len(keys)),
                        "frame": pa.array(frames, pa.int32()),
                        "offset": pa.array(offsets, pa.int64()),
                        "length": pa.array(lengths, pa.int64()),
                    }
                )

    files = _bundles(spark, path).select("path", "content")
    found = files.mapInArrow(run, "key string, bundle string, frame int, offset bigint, length bigint")
    return found.withColumn("key", F.col("key").cast(key_type))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` written to an archive in the shared folder and read back, without the payloads."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_archive(pages, path, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    return read_archive(spark, path, kind, payloads=False).drop("payload")
