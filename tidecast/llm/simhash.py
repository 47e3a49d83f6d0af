"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit for each of 64, set if more than half of its shingles'
hashes have it. Texts with equal fingerprints are one node, whose number is their smallest
id. Nodes are linked if their fingerprints differ in at most ``RADIUS`` bits.

Candidates are exact. The bits are cut into ``BLOCKS`` blocks; fingerprints that differ in
at most 4 bits agree on two of six blocks at least, whichever bits differ. So each
node goes, for each pair of blocks, to the group of those that agree with it on both: 15
small rows. A group beyond ``GROUP`` nodes is split into slices, and every two slices meet.

Within a task the groups' bits are stored as planes: one long integer for each of the 64 bits,
with a lane for each node. A plane xor itself shifted by d compares every node with the
d-th after it at once, and carry-save counters of a few planes add up the differences
of all lanes. When every lane has passed the radius (or is linked already), the rest of
the planes is skipped. A task sends on a link to the first node of each part it found,
not all pairs, which keeps a group of near copies linear and loses no connection.

Components then come from links to ever smaller numbers, by joins and minima.

``copies`` links texts by the exact Jaccard similarity of their distinct shingles. Fingerprints of these propose
links as above, and those that the exact check confirms make components; a filter that loses no pair has the
candidates beyond them, of which only those between two components are compared.

The filter deals the shingles of a set to parts by their hashes. Similar sets differ in a quarter of the smaller one's
shingles at most, so all parts but so many are equal, contents and all. A set sends on one part more than may
differ, those first that have the most shingles. What two unlike sets share by chance is a shingle here and there,
hardly ever a whole part, so that candidates do not grow with the square of the table.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import free_name, in_arrow, slices, written

SEED, BITS = 42, 64
RADIUS, BLOCKS = 4, 6
#: Nodes that a slice has on average, at most; lanes that are compared at once.
GROUP, LANES = 1024, 1 << 16

#: Least Jaccard similarity of near copies, as a fraction. Nodes that a key may have before its nodes are bundled, and
#: a shingle before it counts for less; most such shingles; shingles among which they are counted at once.
SIMILAR = (4, 5)
MEMBERS, COMMON, COUNTED = 64, 1 << 20, 1 << 21
#: Sets of a bundle and shingles in them, at most on average; shingles that are compared at once.
BUNDLE, BUNDLE_HASHES, WORDS = 256, 1 << 16, 4096
#: Bits of the map that tells ids that are not in a table.
MAP_BITS = 1 << 23

_UPPER = {c: c + 32 for c in range(65, 91)}
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none without words."""
    found = _SPLIT.findall((text or "").translate(_UPPER))
    n = max(1, len(found) - shingle + 1) if found else 0
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(" ".join(found[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(h)
    octets = h.view(np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:  # of each byte of the hashes, how often it has each value, and from that each bit
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a text's shingles; zero without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``bits`` of each row: the fingerprint as a signed long."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = (x.as_py() for x in batch.column(1))
        bits = pa.array(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), bits], names=["doc_id", "bits"])

    return in_arrow(df.select(df[doc_id], df[text]), run, f"doc_id {kind}, bits bigint")


def block_masks() -> list[int]:
    """For each pair of blocks the bits of both."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(kept) for kept in itertools.combinations(blocks, BLOCKS - RADIUS)]


def planes(values: np.ndarray) -> list[int]:
    """For each bit one integer with a lane for each value (a row of one word or more)."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def as_lanes(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def lanes_of(lanes: int, n: int) -> np.ndarray:
    raw = np.frombuffer(lanes.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def within(own: list[int], shift: int, alive: int, radius: int) -> int:
    """Of the lanes ``alive`` those whose value and the one ``shift`` lanes on differ in at most
    ``radius`` bits."""
    # Counters with as many digits as the radius has, beginning at a value from which the
    # first difference too many is a carry out of the highest digit.
    digits = max(1, radius.bit_length())
    start = (1 << digits) - 1 - radius
    count = [alive if start >> k & 1 else 0 for k in range(digits)]
    for plane in own:
        carry = (plane ^ (plane >> shift)) & alive
        for k in range(digits):
            if not carry:
                break
            count[k], carry = count[k] ^ carry, count[k] & carry
        if carry:
            alive &= ~carry
            if not alive:
                return 0
            count = [c & alive for c in count]
    return alive


def linked(group: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its part: rows of a group, which stand together, are in one
    part if values within the radius connect them."""
    n = len(values)
    root = np.arange(n)
    size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n))
    size = np.repeat(size, size)
    rows, shift, rebuild = np.arange(n), 1, 1
    own: list[int] = []
    while True:
        if shift == rebuild:  # keep only groups with rows that far apart
            rows, rebuild = rows[size[rows] > shift], rebuild * 2
            own = planes(values[rows]) if len(rows) else []
        if len(rows) <= shift:
            return root
        a, b = rows[:-shift], rows[shift:]
        open_lanes = (group[a] == group[b]) & (root[a] != root[b])
        if open_lanes.any():
            hit = lanes_of(within(own, shift, as_lanes(open_lanes), radius), len(rows))
            for i, j in zip(rows[hit].tolist(), rows[hit + shift].tolist()):
                x, y = root[i], root[j]
                if x != y:
                    # A part lies within one group: relabel there only.
                    near = slice(max(0, min(x, y)), min(n, max(i, j) + int(size[i])))
                    part = root[near]
                    part[part == max(x, y)] = min(x, y)
        shift += 1


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between nodes (``node, bits``) that connect all within the radius."""
    keys = [F.col("bits").bitwiseAND(_signed(m)) for m in block_masks()]
    each = F.array(*(F.struct(F.lit(k).alias("k"), key.alias("agree")) for k, key in enumerate(keys)))
    keyed = nodes.select("node", "bits", F.explode(each).alias("e")).select("node", "bits", "e.k", "e.agree")
    sizes = keyed.groupBy("k", "agree").agg(F.count("*").alias("size")).filter("size > 1")
    cut = F.ceil(F.col("size") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("bits"), cut).cast("int")
    met = F.transform(F.sequence(F.lit(0), cut - 1), lambda t: F.struct(F.least(own, t).alias("s"), F.greatest(own, t).alias("t")))
    groups = (
        keyed.join(sizes, ["k", "agree"])
        .select("node", "bits", "k", "agree", F.explode(met).alias("m"))
        .select("node", "bits", "k", "agree", "m.s", "m.t")
    )
    keys = ["k", "agree", "s", "t"]
    sorted_groups = groups.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "node", "bits")

    def run(batches):
        held: pa.Table | None = None

        def compared(part: pa.Table):
            cols = [part.column(c).to_numpy() for c in keys]
            new = np.zeros(part.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            values = part.column("bits").to_numpy().view(np.uint64)
            root = linked(np.cumsum(new), values, radius)
            node = part.column("node").to_numpy()
            other = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], names=["a", "b"])

        def last_group(part: pa.Table) -> int:
            """Where the last group begins, which the next batch may continue."""
            same = np.ones(part.num_rows, bool)
            for c in keys:
                values = part.column(c).to_numpy()
                same &= values == values[-1]
            return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            if held.num_rows >= LANES and (at := last_group(held)):
                yield compared(held.slice(0, at).combine_chunks())
                held = held.slice(at).combine_chunks()
        if held is not None and held.num_rows:
            yield compared(held)

    return sorted_groups.mapInArrow(run, "a bigint, b bigint").distinct()


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest number reachable, for nodes that have a link.

    Alternates two steps until nothing changes: every node's greater neighbours are linked to the
    smallest neighbour, and then every node's smaller neighbours are. Stars of a component
    so merge into one. Each round's links are a table in the shared folder.
    """
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a != b")
            .distinct()
        )
        new = written(small, "links")
        # Stars only, each around its smallest node, are what does not change any more.
        heads = new.select(F.col("b").alias("a")).distinct()
        if new.join(heads, "a", "left_semi").isEmpty() and _single(new):
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = new


def _single(edges: DataFrame) -> bool:
    return edges.groupBy("a").count().filter("count > 1").isEmpty()


def near_duplicates(df: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id reachable over links, its own included.

    Texts without words (null, empty, white space) have the fingerprint zero and are linked
    like any other. Repeated rows each get their row. A row with a null id is a node only through
    others with the same fingerprint; without any its component is null. An empty table gives an
    empty one. Other columns are not read.
    """
    prints = written(fingerprints(df, shingle, doc_id, text), "fingerprints")
    nodes = written(prints.groupBy("bits").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes.filter("node IS NOT NULL")))
    placed = nodes.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return prints.join(placed, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def distinct_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle)).view(np.int64)


def similar(shared, a, b):
    """Whether sets of the sizes a and b that share so many are similar, in whole numbers."""
    return SIMILAR[1] * shared >= SIMILAR[0] * (a + b - shared)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def set_prints(df: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text`` to ``doc_id``, ``same`` (a digest that equal shingle sets share), ``size`` of the set and
    ``bits``, its fingerprint. Some rows have ``often`` and ``times``: shingles that several of the different sets
    up to there have, and how many."""

    def run(batches):
        for batch in batches:
            found = [distinct_hashes(x.as_py(), shingle) for x in batch.column(1)]
            for a, b in slices([len(h) for h in found], COUNTED):
                sets = found[a:b]
                same = [xxhash.xxh128_digest(h.tobytes()) for h in sets]
                key, n = np.unique(np.concatenate(list(dict(zip(same, sets)).values())), return_counts=True)
                often = [key[n > 1], *[key[:0]] * (len(sets) - 1)]
                times = [n[n > 1], *[n[:0]] * (len(sets) - 1)]
                columns = [batch.column(0).slice(a, b - a), pa.array(same, pa.binary()), pa.array([len(h) for h in sets], pa.int32())]
                columns += [pa.array(np.array([majority(h) for h in sets], np.uint64).view(np.int64)), _lists(often), _lists(times)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "size", "bits", "often", "times"])

    return df.mapInArrow(run, "doc_id bigint, same binary, size int, bits bigint, often array<bigint>, times array<bigint>")


def common_shingles(prints: DataFrame) -> np.ndarray:
    """Shingles that more than ``MEMBERS`` sets have, ascending. Only those that repeat among sets counted at once are
    known, and the ``COMMON`` most frequent returned: it decides on an order, and every order finds all."""
    seen = prints.filter("size(often) > 0").select(F.explode(F.arrays_zip("often", "times")).alias("e"))
    counted = seen.select(F.col("e.often").alias("key"), F.col("e.times").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > MEMBERS).orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()
    return np.sort(found.column("key").to_numpy())


def most_apart(size: int) -> int:
    """In how many elements a set may differ from a similar one."""
    return size * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[0]


def levels(size: int) -> list[int]:
    """The levels a set is compared at: that of its size, and the next if a similar set may be there. Similar sets
    so meet at the level of the larger one."""
    own = size.bit_length() - 1
    return [own, own + 1] if (size * SIMILAR[1] // SIMILAR[0]).bit_length() - 1 > own else [own]


def level_parts(level: int) -> int:
    """Parts of a level: more than its largest set sends on, so that parts with few shingles stay behind."""
    return most_apart((2 << level) - 1) * 13 // 10 + 4


def part_keys(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of a set's parts, of which similar sets have one in common, if they are not equal.

    A part's key names its level, its place and its shingles. Of sets that differ in k shingles all parts but k
    are equal; the first of those in one order, whichever it is, is among the first k + 1 of either set. Parts come
    first that have more shingles which are not in ``common`` (ascending), and then more shingles at all.
    """
    if not most_apart(len(h)):
        return h[:0]
    own = h.view(np.uint64)
    rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h if len(common) else np.ones(len(h), bool)
    keys = []
    for level in levels(len(h)):
        n = level_parts(level)
        part = (own % np.uint64(n)).astype(np.int64)
        key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
        np.add.at(key, part, own)
        key ^= key >> np.uint64(32)
        key = key * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)
        order = np.lexsort((key, -np.bincount(part, minlength=n), -np.bincount(part[rare], minlength=n)))
        keys.append(key[order[: most_apart(len(h)) + 1]])
    return np.concatenate(keys).view(np.int64)


def keyed_sets(df: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """``doc_id, text`` to ``doc_id``, ``same`` and ``size`` as above, and ``keys`` of the set's parts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, size, keys = [], [], []
        for x in batch.column(1):
            h = distinct_hashes(x.as_py(), shingle)
            same.append(xxhash.xxh128_digest(h.tobytes()))
            size.append(len(h))
            keys.append(part_keys(h, common))
        columns = [batch.column(0), pa.array(same, pa.binary()), pa.array(size, pa.int32()), _lists(keys)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "size", "keys"])

    return in_arrow(df, run, "doc_id bigint, same binary, size int, keys array<bigint>")


def candidates(keyed: DataFrame) -> DataFrame:
    """``key, a, b``: pairs of nodes (``key, node, size``) that share a key and may be similar (its key is
    null). Of a key with more than ``MEMBERS`` nodes there is a row for each node instead, its b null."""
    most = MEMBERS

    def compared(part: pa.Table):
        key, node, size = (part.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "size"))
        members = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
        many = np.repeat(members > most, members)
        hot = np.unique(np.stack([key[many], node[many]], 1), axis=0)
        found = [np.zeros((0, 2), np.int64)]
        key, node, size = (x[~many] for x in (key, node, size))
        for shift in range(1, most):
            at = np.flatnonzero(key[shift:] == key[:-shift])
            if not len(at):
                break
            to = at + shift
            near = similar(np.minimum(size[at], size[to]), size[at], size[to]) & (node[at] != node[to])
            found.append(np.sort(np.stack([node[at[near]], node[to[near]]], 1), 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        nulls = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(hot), pa.int64())
        columns = [pa.array(hot[:, 0]), pa.array(hot[:, 1]), nulls[1]], [nulls[0], pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
        for c in columns:
            yield pa.RecordBatch.from_arrays(c, names=["key", "a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            key = held.column("key").to_numpy()
            at = int(np.searchsorted(key, key[-1]))  # the next batch may continue the last key
            if held.num_rows >= LANES and at:
                yield from compared(held.slice(0, at).combine_chunks())
                held = held.slice(at).combine_chunks()
        if held is not None:
            yield from compared(held)

    sorted_keys = keyed.select("key", "node", "size").repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(run, "key bigint, a bigint, b bigint")


def set_links(sets: list[np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all similar pairs between the first ``left`` sets and the others, or of all sets
    if that is zero."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count > 1  # what one set only has cannot be shared
    column = (np.cumsum(held) - 1)[word]
    owner, column = owner[held[word]], column[held[word]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    shared = np.zeros((n, n), np.int64)
    for first in range(0, int(held.sum()), WORDS):
        a, b = np.searchsorted(column, [first, first + WORDS])
        dense = np.zeros((n, WORDS), np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        shared += (dense @ dense.T).astype(np.int64)
    near = np.triu(similar(shared, size[:, None], size), 1)
    if left:
        near[:left, :left] = near[left:, left:] = False
    root, links = np.arange(n), []
    for i, j in np.argwhere(near).tolist():
        if root[i] != root[j]:
            root[root == max(root[i], root[j])] = min(root[i], root[j])
            links.append((i, j))
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def bundled_links(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links between nodes with a common key (``key, node``), by their sets (``node, hashes``).

    A node goes to a bundle of one of its keys, the least, so that a group of near copies fills a few. A
    bundle is one packed row, and every two bundles that have a key in common are compared in one task.
    """
    own = sets.select("node", F.size("hashes").alias("size")).join(hot.groupBy("node").agg(F.min("key").alias("home")), "node")
    weights = own.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BUNDLE), F.ceil(F.sum("size") / BUNDLE_HASHES)).alias("cuts"))
    homes = own.select("node", "home").distinct().join(weights, "home")
    placed = written(homes.select("node", F.struct("home", F.pmod(F.xxhash64("node"), "cuts").alias("cut")).alias("bundle")), "bundles")

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.table({"home": table["home"][:1], "cut": table["cut"][:1], "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    members = placed.join(sets, "node").select("bundle.home", "bundle.cut", "node", "hashes")
    packs = members.groupBy("home", "cut").applyInArrow(pack, "home bigint, cut bigint, packed binary")
    packs = written(packs.select(F.struct("home", "cut").alias("bundle"), "packed"), "packs")
    met = hot.join(placed, "node").select("key", "bundle").distinct()
    pairs = met.withColumnRenamed("bundle", "x").join(met.withColumnRenamed("bundle", "y"), "key").filter("x <= y").select("x", "y").distinct()
    both = pairs.join(packs.select(F.col("bundle").alias("x"), F.col("packed").alias("left")), "x").join(
        packs.select(F.col("bundle").alias("y"), F.col("packed").alias("right")), "y"
    )

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in (left, right) if x.is_valid]
                node = np.concatenate([t["node"].to_numpy() for t in tables])
                a, b = set_links([x.values.to_numpy() for t in tables for x in t["hashes"]], tables[0].num_rows if len(tables) > 1 else 0)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return both.select(F.when(F.col("x") != F.col("y"), F.col("left")), "right").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links between nodes (``node, bits``), which connect all whose fingerprints are within the radius."""
    firsts = written(nodes.groupBy("bits").agg(F.min("node").alias("node")), "nodes")
    equal = nodes.join(firsts.withColumnRenamed("node", "a"), "bits").select("a", F.col("node").alias("b")).filter("a <> b")
    return equal.unionByName(links(firsts))


def marks(h: np.ndarray) -> bytes:
    """Bits of a power of two, twice the set's size or more: whether an odd number of its hashes fall on each."""
    n = 1 << max(6, (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (n - 1), minlength=n) & 1, bitorder="little").tobytes()


def marks_apart(a: bytes, b: bytes) -> int:
    """In how many bits the marks of two sets differ, the longer ones folded: never more than the sets in elements."""
    x, y = (np.frombuffer(m, np.uint64) for m in (a, b))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (``a, b``) whose sets (``node, hashes, marks``) are similar.

    First by the marks: similar sets differ in few elements, so pairs whose marks differ in more bits are none, and their
    sets stay where they are.
    """

    def sets_of(pairs: DataFrame) -> DataFrame:
        return sets.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = [marks_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("a_marks"), batch.column("b_marks"))]
        most = sum(batch.column(c).to_numpy().astype(np.int64) for c in ("a_size", "b_size")) * (SIMILAR[1] - SIMILAR[0])
        return batch.select(["a", "b"]).filter(pa.array((SIMILAR[0] + SIMILAR[1]) * np.array(apart) <= most))

    own = sets_of(pairs)
    x, y = (own.select(F.col("node").alias(c), F.col("marks").alias(f"{c}_marks"), F.size("hashes").alias(f"{c}_size")) for c in "ab")
    left = written(in_arrow(pairs.join(x, "a").join(y, "b"), close, "a bigint, b bigint"), "pairs")
    own = sets_of(left)
    x, y = (own.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in "ab")
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return left.join(x, "a").join(y, "b").filter(similar(shared, F.size("a_hashes"), F.size("b_hashes"))).select("a", "b")


def between(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Those of the pairs (``a, b``) that are not in one component (``node, component``) already."""
    x, y = (components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in "ab")
    apart = F.coalesce("a_in", "a") != F.coalesce("b_in", "b")
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(apart).select("a", "b")


def may_be_in(df: DataFrame, id_: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``id_`` may be in ``ids`` (one column), among them all that are, and the other rows.

    By a map of ``MAP_BITS`` bits of the ids' hashes. It has a fixed size and so can go to all tasks, however many ids there are:
    a join is then asked of the first rows only, and the texts of the others are not shuffled.
    """
    word, bits = (free_name(df, x) for x in ("word", "bits"))

    def at(column) -> tuple:
        place = F.pmod(F.xxhash64(column.cast("bigint")), F.lit(MAP_BITS))
        return F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")

    row, bit = at(ids[ids.columns[0]])
    found = ids.select(row.alias(word), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias(bits))
    found = written(found.groupBy(word).agg(F.bit_or(bits).alias(bits)), "id-map")
    row, bit = at(df[id_])
    told = df.withColumn(word, row).join(F.broadcast(found), word, "left")
    held = F.call_function("getbit", F.coalesce(F.col(bits), F.lit(0).cast("bigint")), bit) == 1
    return tuple(told.filter(x).select(*(df[c] for c in df.columns)) for x in (held, ~held))


def similar_links(docs: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """``a, b``: links that connect all nodes whose shingle sets are similar, and no others. A node is the
    smallest id of equal sets, in ``prints`` (``doc_id, same, size, bits, often, times``) of ``docs``."""
    firsts = prints.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("size").alias("size"))
    proposed = written(fingerprint_links(firsts.filter("size > 0").select(F.col("doc_id").alias("node"), "bits")), "fingerprint-links")
    keyed = keyed_sets(docs, shingle, common_shingles(prints)).filter("size(keys) > 0").join(firsts.select("same", "doc_id"), ["same", "doc_id"], "left_semi")
    found = written(candidates(keyed.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"), "size")), "candidates")
    pairs, hot = found.filter("b IS NOT NULL").select("a", "b").distinct(), found.filter("b IS NULL").select("key", F.col("a").alias("node"))
    wanted = found.select("a", "b").unionByName(proposed).select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = written(wanted.filter("doc_id IS NOT NULL").distinct(), "wanted")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [distinct_hashes(x.as_py(), shingle) for x in batch.column(1)]
        columns = [batch.column(0), _lists(sets), pa.array([marks(h) for h in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["node", "hashes", "marks"])

    # With the few sets that the map lets through besides: to join them away would shuffle all.
    sets = in_arrow(may_be_in(docs, "doc_id", wanted)[0], hashed, "node bigint, hashes array<bigint>, marks binary")
    sets = written(sets.filter("size(hashes) > 0"), "sets")
    near = written(confirmed(proposed, sets), "near")
    apart = written(between(pairs, components(near)), "apart")
    return near.unionByName(confirmed(apart, sets)).unionByName(bundled_links(hot, sets))


def copies(df: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` of the rows linked with a smaller id by texts of similarity ``SIMILAR`` or more, once each.

    The similarity is that of Jaccard, of the texts' distinct shingles (by 64-bit hash). Links are exact and
    complete; they join to components, so that the ends of a chain need not be similar. Texts without words are
    equal. Null ids are nobody's copies. Rows with one id are one document, linked by any of its texts.
    """
    docs = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[text].alias("text")).filter("doc_id IS NOT NULL")
    prints = written(set_prints(docs, shingle), "prints")
    equal = prints.groupBy("same").agg(F.min("doc_id").alias("a"))
    equal = prints.join(equal, "same").select("a", F.col("doc_id").alias("b")).filter("a <> b").distinct()
    found = components(similar_links(docs, prints, shingle).unionByName(equal))
    return found.filter("node <> component").select(F.col("node").alias("doc_id"))


def without_copies(df: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that are nobody's copies: of each group the document with the smallest id, and rows with a
    null id. Rows with one id are one document, which stays or goes as a whole."""
    key = free_name(df, "copy_of")
    gone = written(copies(df, shingle, doc_id, text).select(F.col("doc_id").alias(key)), "copies")
    maybe, kept = may_be_in(df, doc_id, gone)
    return kept.union(maybe.join(gone, maybe[doc_id] == gone[key], "left_anti"))
