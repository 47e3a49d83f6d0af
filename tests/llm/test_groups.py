"""Operators that compare texts with each other, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, awkward, cut, passages, rows_of, smallest_reachable, with_clashes

from tidecast.llm import decontaminate, simhash, suffix_dedup


def test_linked_lanes_equal_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        n = int(r.integers(1, 150))
        values = r.integers(0, 1 << 63, 5, dtype=np.uint64)[r.integers(0, 5, n)].copy()
        for i in range(n):
            for b in r.integers(0, 64, r.integers(0, 5)):
                values[i] ^= np.uint64(1) << np.uint64(b)
        group = np.sort(r.integers(0, 4, n))
        near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 4) & (group[:, None] == group[None, :])
        assert simhash.linked(group, values).tolist() == smallest_reachable(range(n), near)


@pytest.mark.parametrize("slice_size", [simhash.GROUP, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, slice_size):
    """Also with groups cut into many slices, which must all meet."""
    monkeypatch.setattr(simhash, "GROUP", slice_size)
    r = np.random.default_rng(2)
    base = [[f"w{r.integers(10**6)}" for _ in range(120)] for _ in range(6)]
    rows = list(AWKWARD)
    for i in range(90):
        words = list(base[r.integers(6)])
        for _ in range(r.integers(0, 3)):
            words[r.integers(120)] = f"x{r.integers(1000)}"
        rows.append((100 + i, " ".join(words).upper() if i % 2 else " ".join(words)))
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = simhash.near_duplicates(df, 4).toPandas()
    assert len(got) == len(rows)
    known = got.dropna(subset=["doc_id"])
    bits = np.array([int(x, 16) for x in known["fingerprint"]], np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    assert known["component_id"].tolist() == smallest_reachable(known["doc_id"].tolist(), near)
    assert set(got[got["doc_id"].isin([1, 2, 3])]["fingerprint"]) == {"0" * 16}


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(awkward(spark).limit(0), 4).count() == 0
    assert simhash.without_copies(awkward(spark).limit(0), 5).count() == 0


def test_copies_of_similar_texts(spark):
    """One word in fifty changed is a copy, one in five is not; of a group the smallest id stays."""
    r = np.random.default_rng(3)
    rows = []
    for g in range(20):
        words = [f"w{r.integers(10**6)}" for _ in range(200)]
        near, far = list(words), list(words)
        for i in range(0, 180, 60):
            near[i + int(r.integers(50))] = "changed"
        for i in range(0, 200, 5):
            far[i] = f"other{i}"
        rows += [(3 * g, " ".join(near)), (3 * g + 1, " ".join(words)), (3 * g + 2, " ".join(far))]
    rows.append((None, rows[0][1]))
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    left = simhash.without_copies(df, 5)
    assert left.columns == df.columns
    ids = {x["doc_id"] for x in left.collect()}
    assert ids == {None, *(d for d, _ in rows if d is not None and d % 3 != 1)}


def exact_copies(rows, size=5):
    """Ids that exact links of a Jaccard similarity of 0.8 lead from to a smaller id."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    ids = [d for d, _ in rows]
    return {d for d, first in zip(ids, smallest_reachable(ids, near)) if d != first}


def around_the_border(r, groups, n=120):
    """Texts that have changed words enough for similarities from 0.7 to 0.9, against the first of their group."""
    rows = []
    for g in range(groups):
        base = [f"w{r.integers(10**6)}" for _ in range(n)]
        for k in range(8):
            words = list(base)
            for at in r.choice(n - 10, k // 2 + k % 2, replace=False):
                words[at + 5] = f"x{r.integers(10**6)}"
            rows.append((len(rows), " ".join(words + [f"y{r.integers(10**6)}" for _ in range(r.integers(0, 5))])))
    return [(int(i), t) for i, (_, t) in zip(r.permutation(len(rows)), rows)]


def test_copies_are_exact_around_the_border(spark):
    rows = around_the_border(np.random.default_rng(7), 40)
    expected = exact_copies(rows)
    assert len(rows) / 4 < len(expected) < len(rows) - 40  # some go and some stay
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {x["doc_id"] for x in simhash.copies(df, 5).collect()} == expected


def test_fingerprints_propose_and_the_exact_check_decides(spark, monkeypatch):
    """The stage goes by the fingerprints of op6: what they propose is confirmed or dropped, and the rest is still found."""
    rows = around_the_border(np.random.default_rng(9), 20)
    asked, links = [], simhash.links

    def seen(nodes):
        asked.append(nodes.count())
        return links(nodes, 14)  # wide, so that some proposals are none

    monkeypatch.setattr(simhash, "links", seen)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x["doc_id"] for x in simhash.without_copies(df, 5).collect()} == {i for i, _ in rows} - exact_copies(rows)
    assert asked and asked[0] > len(rows) / 2


def test_a_repeated_line_makes_no_copies(spark):
    """Long texts that share one line, repeated between words of their own."""
    r = np.random.default_rng(8)
    line = [f"line{k}" for k in range(10)]
    rows = []
    for i in range(10):
        words = [w for _ in range(40) for w in [*line, *(f"w{r.integers(10**9)}" for _ in range(11))]]
        rows.append((i, " ".join(words)))
    assert exact_copies(rows) == set()
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert simhash.copies(df, 5).count() == 0


def test_similar_sets_share_a_key():
    """Sets just similar enough, of all sizes and across levels, with some shingles that count for less."""
    r = np.random.default_rng(12)
    for n in [*range(4, 70), 127, 128, 204, 205, 255, 256, 1000]:
        for _ in range(20):
            a = r.integers(-(2**63), 2**63 - 1, n)
            gone = int(r.integers(n // 5 + 1))
            more = 0
            while simhash.similar(n - gone, n, n - gone + more + 1):
                more += 1
            b = np.append(a[gone:], r.integers(-(2**63), 2**63 - 1, more))
            assert simhash.similar(n - gone, n, len(b))
            common = np.sort(r.choice(a, n // 3, replace=False))
            x, y = (set(simhash.part_keys(np.sort(h), common).tolist()) for h in (a, b))
            assert x & y or not gone + more
            assert simhash.marks_apart(simhash.marks(a), simhash.marks(b)) <= gone + more
    other = r.integers(-(2**63), 2**63 - 1, 1000)
    assert simhash.marks_apart(simhash.marks(a), simhash.marks(other)) > 2000 / 9


def test_phrases_shared_by_chance_make_no_pairs(spark, monkeypatch):
    """Each two of the texts share some phrases; pairs of all that do would grow with the square of the table."""
    r = np.random.default_rng(13)
    phrases = [" ".join(f"p{k}w{i}" for i in range(5)) for k in range(150)]
    rows = []
    for i in range(300):
        words = [w for k in r.choice(150, 20, replace=False) for w in [phrases[k], *(f"w{r.integers(10**9)}" for _ in range(10))]]
        rows.append((i, " ".join(words)))
    found, candidates = [], simhash.candidates

    def seen(keyed):
        found.append(candidates(keyed).filter("b IS NOT NULL").distinct().count())
        return candidates(keyed)

    monkeypatch.setattr(simhash, "candidates", seen)
    assert simhash.copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).count() == 0
    assert found[0] < 30  # thousands by single phrases


def test_only_rows_that_may_be_in_a_table_are_joined(spark):
    rows = [(i, f"t{i}") for i in range(2000)] + [(None, "none"), (3, "again")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    held, other = simhash.may_be_in(df, "doc_id", spark.createDataFrame([(3,), (1999,), (10**9,)], "id bigint"))
    assert held.columns == other.columns == df.columns
    assert {"t3", "again", "t1999"} <= {x["text"] for x in held.collect()}
    assert held.count() < 10 and held.count() + other.count() == len(rows)


@pytest.mark.parametrize("members", [1, 4, simhash.MEMBERS])
def test_copies_lose_no_pair(spark, monkeypatch, members):
    """Pairs just at 0.8, awkward rows, and groups in one bundle, in many, or in none."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "BUNDLE", 8)
    r = np.random.default_rng(9)
    rows = []
    for g in range(300):  # 96 shingles each; similarities of 0.81, 0.75 and 0.83
        words = [f"w{r.integers(10**9)}" for _ in range(100)]
        other = words[:91] + [f"x{r.integers(10**9)}" for _ in range(9)]
        if g % 3 == 0:
            other[0] = "changed"
        if g % 3 == 1:
            other[40] = "changed"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    rows += [(1000 + d, t) for d, t in around_the_border(r, 4, 60)]
    expected = exact_copies(rows)
    assert {2 * g + 1 for g in range(300) if g % 3 != 1} <= expected and not expected & {2 * g + 1 for g in range(1, 300, 3)}
    rows += [(None, rows[0][1]), (3000, rows[1][1].upper()), (2, rows[2][1])]
    rows += [(5000 + d, t) for d, t in AWKWARD if d is not None and d not in (2, 3)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    assert {x["doc_id"] for x in simhash.copies(df, 5).collect()} == expected | {3000}


@pytest.mark.parametrize(("chunk", "part"), [(suffix_dedup.CHUNK, suffix_dedup.PART), (500, 8 << 20), (2 << 20, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk, part):
    """Whole tables at once, and cut into many chunks and parts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rows = passages() + AWKWARD
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    assert rows_of(suffix_dedup.digests(df)) == cut(rows)


def test_a_task_sends_a_part_one_row(spark, monkeypatch):
    """And not one for each chunk: rows as many as parts and chunks grow with the square of the texts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rows = [(d, 0, t) for d, t in passages() if d is not None and t]
    docs = spark.createDataFrame(rows, "doc_id bigint, text_hash bigint, text string").coalesce(1)
    sent = suffix_dedup.named_pieces(docs, 4).select("part").collect()
    assert len(sent) == len({x["part"] for x in sent}) == 4


@pytest.mark.parametrize("deal", [700, 5000])
def test_repeats_equal_brute_force_dealt_in_many_rows(spark, monkeypatch, deal):
    for name, value in (("CHUNK", 400), ("PART", 900), ("DEAL", deal), ("SHARE", 2), ("SHARES", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages(6) + AWKWARD
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(3)
    assert rows_of(suffix_dedup.digests(df)) == cut(rows)


def test_packed_rows_come_back():
    r = np.random.default_rng(15)
    kinds = [np.dtype(x) for x in ("<i8", "<i8", "<i4", "i1", "<u4")]
    columns = [r.integers(np.iinfo(k).min, np.iinfo(k).max, 300, k) for k in kinds]
    content = [bytes(r.integers(0, 256, k % 7, np.uint8)) for k in range(300)]
    part = r.integers(0, 5, 300)
    sent = suffix_dedup.dealt(columns, part, pa.array(content, pa.binary()))
    assert sent.column("part").to_pylist() == [0, 1, 2, 3, 4]
    found, joined = suffix_dedup.unpacked(pa.chunked_array([sent.column("packed")]), kinds)
    order = np.argsort(part, kind="stable")
    assert all((x == c[order]).all() and x.dtype == c.dtype for x, c in zip(found, columns))
    assert joined.tobytes() == b"".join(content[i] for i in order)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.digests(awkward(spark).limit(0)).count() == 0


def test_removed_keeps_all_columns(spark):
    rows = passages(9, 20)
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = suffix_dedup.removed(df)
    assert got.columns == df.columns and got.count() == len(rows)
    before = {d: t for d, t in rows if d is not None}
    for r in got.collect():
        if r["doc_id"] == 0:
            assert r["text"] == before[0]
        if r["doc_id"] == 74:  # the same text as document 0
            assert len((r["text"] or "").encode()) < 50


def test_intervals_are_classes_of_equal_strings():
    r = np.random.default_rng(4)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    data[500:700] = data[100:300]
    data[2000:2300] = 97
    order, begins = suffix_dedup.intervals(data, 50)
    raw = data.tobytes()
    strings = [raw[i : i + 50] for i in order]
    whole = [i for i in range(1, len(strings)) if len(strings[i]) == len(strings[i - 1]) == 50]
    assert all(begins[i] == (strings[i] != strings[i - 1]) for i in whole)
    assert strings == sorted(strings)


def contained(documents, items, least=0.8, size=5):
    def shingles(t):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    held = set()
    for d, t in documents:
        own = shingles(t)
        for i, x in items:
            item = shingles(x)
            if item and d is not None and i is not None and len(item & own) >= least * len(item) - 1e-9:
                held.add((d, i, len(item), len(item & own)))
    return sorted(held, key=str)


def test_contained_items_equal_brute_force(spark):
    r = np.random.default_rng(6)
    words = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(r.choice(words, r.integers(1, 60)))) for i in range(40)]
    items += [(40, None), (41, ""), (None, "w1 w2 w3"), (42, items[0][1].upper())]
    documents = list(AWKWARD)
    for d in range(100, 160):
        text = list(r.choice(words, 400))
        for _ in range(3):
            own = (items[r.integers(40)][1]).split()
            for k in range(0, len(own), int(r.integers(8, 40))):  # some changed, in half the documents
                own[k] = "changed" if d % 2 else own[k]
            text[50:50] = own
        documents.append((d, " ".join(text)))
    docs = with_clashes(spark.createDataFrame(documents, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contained(docs, bench).drop("containment")
    assert rows_of(got) == contained(documents, items)
    left = decontaminate.without_contained(docs, bench)
    assert left.columns == docs.columns
    gone = {d for d, *_ in contained(documents, items)}
    assert left.count() == sum(d not in gone for d, _ in documents)
    assert decontaminate.contained(docs.limit(0), bench).count() == 0
    assert decontaminate.contained(docs, bench.limit(0)).count() == 0


def test_hashes_of_texts_travel_for_repeated_ids_only(spark, monkeypatch):
    """They do not compress, and every piece of a text takes one along."""
    seen, named = [], suffix_dedup.named_pieces

    def kept(docs, parts):
        seen.extend(docs.select("doc_id", "text_hash").collect())
        return named(docs, parts)

    monkeypatch.setattr(suffix_dedup, "named_pieces", kept)
    same, own = "a passage that stands in three of these texts here, twice under one id", "x" * 60
    rows = [(1, same), (2, f"{own} {same}"), (2, f"{same} {own[:9]}"), (3, own[:55])]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == sorted(
        (d, len(t), len(same) if d == 2 else 55 if d == 3 else 0) for d, t in rows
    )
    assert {r["text_hash"] for r in seen if r["doc_id"] != 2} == {0}
    assert len({r["text_hash"] for r in seen if r["doc_id"] == 2} - {0}) == 2
