"""Fill-in-the-middle, collocations and WARC bundles, against brute force and exact round trips."""

import hashlib
import random
import re
from collections import Counter

import pytest
import zstandard
from helpers import AWKWARD, awkward, rows_of, with_clashes

from tidecast.llm import collocations, fill_middle, warc


def cut_by_hand(doc, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def lines(seed=4, n=60):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab é<>PSM\n\n") for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [(100 + i, t) for i, t in enumerate(texts)] + [(90, "x<P>\ny\n"), (91, "a\r\nb\x85c d\n"), (92, "\n\n\n")]


@pytest.mark.parametrize("chunk", [7, 1 << 14])
def test_outputs_and_digests_equal_cutting_by_hand(spark, chunk):
    recipe = fill_middle.Recipe(chunk=chunk)
    rows = AWKWARD + lines() if chunk > 7 else lines()
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    pieces = fill_middle.output_pieces(df, recipe)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(d, *cut_by_hand(d, t)[:4], sha(cut_by_hand(d, t)[4]), sha(t or "")) for d, t in rows]
    assert rows_of(fill_middle.digests(pieces)) == sorted(expected, key=str)
    whole = fill_middle.texts(pieces)
    assert rows_of(whole) == sorted(((d, *cut_by_hand(d, t)) for d, t in rows), key=str)
    restored = [(r["doc_id"], fill_middle.restored(r["output"], r["form"])) for r in whole.collect()]
    assert sorted(restored, key=str) == sorted(((d, t or "") for d, t in rows), key=str)


def test_pieces_are_short_and_whole_lines(spark):
    text = "".join(f"line {i}\n" for i in range(9000)) + "y" * 50000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = [bytes(r["piece"]) for r in fill_middle.output_pieces(df).collect()]
    assert max(map(len, found)) <= fill_middle.CHUNK and b"".join(found).decode() == cut_by_hand(1, text)[4]
    assert sum(not p.endswith(b"\n") for p in found) <= 3 + 50000 // fill_middle.CHUNK + 1


def test_rate_and_empty_tables(spark):
    rows = lines()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    recipe = fill_middle.Recipe(rate=40)
    got = {r["doc_id"]: r["form"] for r in fill_middle.digests(fill_middle.output_pieces(df, recipe), recipe).collect()}
    assert got == {d: cut_by_hand(d, t, 40)[1] for d, t in rows} and len(set(got.values())) == 3
    empty = fill_middle.output_pieces(df.limit(0))
    assert fill_middle.digests(empty).count() == 0 and fill_middle.texts(empty).count() == 0


def mined(rows, least, best, absorbed=100):
    """Collocations by counting every phrase."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    good = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    drop = set()
    for (lang, w), a in good.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= absorbed * good[lang, w[i : i + m]]:
                    drop.add((lang, w[i : i + m]))
    scored = []
    for (lang, w), a in good.items():
        if (lang, w) not in drop:
            cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((lang, -score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score))
    out, rank = [], Counter()
    for lang, _, _, phrase, *rest in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= best:
            out.append((lang, rank[lang], phrase.decode(), *rest))
    return sorted(out, key=str)


def talk(seed=2, n=300):
    r = random.Random(seed)
    words = ["The", "cat", "sat", "on", "é\x85", "a　b", "mat", "x", "日本", "\x1c"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(words[: r.randint(1, 10)]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
        rows.append((r.choice(["en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("fr", " . "), ("de", "one two three four five six. " * 40), ("de", "one two three four five six. " * 40)]


@pytest.mark.parametrize("least, best, absorbed, bits", [(12, 1000, 100, 26), (12, 7, 80, 6)])
def test_collocations_equal_counting(spark, least, best, absorbed, bits):
    """With few bits most phrases are counted in vain, and none differently."""
    rows = talk()
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    expected = mined(rows, least, best, absorbed)
    assert len({w[2].count(" ") for w in expected}) > 1
    assert rows_of(collocations.collocations(df, "text", "lang", least, best, absorbed, bits)) == expected


def test_collocations_of_little(spark):
    df = spark.createDataFrame([("en", "a b"), ("en", None)], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0
    # A shard without blocks, and a phrase that all occurrences have in one block.
    df = spark.createDataFrame([("en", "a b, " * 100)], "lang string, text string")
    assert rows_of(collocations.collocations(df)) == [("en", 1, "a b", 100, 100, 100, 200, 2000)]


def web(seed=1):
    r = random.Random(seed)
    same = "<p>é" + "x" * 2000
    rows = [(i, f"https://h/{i}\r\nX: 1", "".join(r.choice("ab<é\n") for _ in range(r.randint(0, 3000)))) for i in range(40)]
    rows += [(100 + i, "https://h/s", same) for i in range(30)] + [(129, "again", same)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", same), (None, "u", None)]
    return rows + [(300, "u", "z" * 1000), (301, "u", "z" * 1000), (302, "u", "y" * 999), (303, "u", "y" * 999)]


def expected_records(rows):
    winner = {}
    for k, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000 and k is not None:
            winner[h] = max(winner.get(h, k), k)
    out = []
    for k, _, h in rows:
        raw, w = (h or "").encode(), winner.get(h or "")
        refers = w if w is not None and w != k else None
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame, bundle", [(1 << 18, 1 << 23), (4000, 3000)])
def test_archives_read_back(spark, tmp_path, frame, bundle):
    rows = web()
    pages = with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, frame=frame, bundle=bundle)
    back = warc.read_archive(spark, path)
    assert rows_of(back.drop("payload")) == expected_records(rows)
    by_key = {k: (h or "").encode() for k, _, h in rows if k is not None}
    for r in back.filter("record_type = 'response' AND key IS NOT NULL").collect():
        assert bytes(r["payload"]) == by_key[r["key"]]
    files = [p for p in (tmp_path / "archive").glob("part-*") if p.stat().st_size]
    assert (len(files) > 3) == (bundle == 3000)
    places = {(r["bundle"].rpartition("/")[2], r["key"]): r for r in warc.index(spark, path).collect()}
    seen = 0
    for file in files:
        content = file.read_bytes()
        reader = warc.SeekableReader(content)
        # Any decoder reads the file; every place of the index is a whole record.
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert whole == b"".join(reader.frame(i) for i in range(len(reader.table) - 1))
        for identifier, f, offset, length in reader.index():
            record = reader.frame(f)[offset : offset + length]
            assert warc.parse(record)[0]["WARC-Record-ID"] == identifier
            key = warc.key_of(identifier)
            assert places[file.name, key and int(key)]["length"] > 0
            seen += 1
    assert seen == len(rows)


def test_damage_is_noticed_and_empty_tables(spark, tmp_path):
    bundle = warc.Bundle("0-0")
    bundle.add("<urn:record:1>", warc.to_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None))
    content = bytearray(bundle.close())
    assert [warc.parse(r)[1] for r in warc.SeekableReader(bytes(content)).records()] == [b"payload"]
    content[-30] ^= 1  # a size or a checksum in the seek table
    with pytest.raises(Exception):
        list(warc.SeekableReader(bytes(content)).records())
    with pytest.raises(ValueError):
        warc.SeekableReader(b"not a bundle at all")
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_text_ids(spark):
    pages = spark.createDataFrame([("a b>é", "u", "w" * 1500), ("c", "u", "w" * 1500)], "page_id string, url string, html string")
    got = rows_of(warc.round_trip(pages).select("key", "record_type", "refers_to"))
    assert got == [("a b>é", "revisit", "c"), ("c", "response", None)]


def test_awkward_rows_pass_through(spark):
    rows = awkward(spark).selectExpr("doc_id AS page_id", "CAST(NULL AS STRING) AS url", "text AS html")
    assert rows_of(warc.round_trip(rows)) == expected_records([(d, None, t) for d, t in AWKWARD])
