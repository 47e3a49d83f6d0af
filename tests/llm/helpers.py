"""Small tables with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (0, "The quick brown fox jumps over the lazy dog, again and again. " * 3),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "Ünïcödé ÉÀ 日本語 😀 👍🏽 \x85 \u3000 x"),
    (6, "a" * 3000),
    (7, "word " * 5000),
    (7, "word " * 5000),
    (None, "no id at all but some words to speak of here"),
    (None, None),
    (8, "ÄÖ\n\n\nline one\nline one\nline two <|endoftext|> </s> don't 12345 $$$"),
]
CLASHES = "score double, kept boolean, n_tokens int, fingerprint string, decoded string, spans string, _id int, Doc_Key string"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id bigint, text string")


def with_clashes(df):
    """Further columns with the names that operators use themselves."""
    return df.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASHES.split(", ")])


def passages(seed=5, n=60):
    """Texts made of shared stretches, with exact copies, a short and a periodic one."""
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(r.randint(0, 6)):
            b, a = r.choice(base), r.randint(0, 399)
            text += b[a : a + r.randint(0, 120)] + "".join(r.choice("xyz ") for _ in range(r.randint(0, 9)))
        rows.append((i, text))
    more = [(3, rows[3][1]), (70, None), (71, ""), (72, "a" * 500), (73, "a" * 300), (None, rows[5][1]), (74, rows[0][1])]
    return rows + more


def cut(rows, length=50):
    """Each row's digests after removing what a smaller id has, byte by byte."""
    first: dict[bytes, int] = {}
    for d, t in rows:
        raw = (t or "").encode() if d is not None else b""
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1 if d is not None else 0):
            if first[raw[p : p + length]] < d:
                gone[p : p + length] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def figures(text, least):
    """Word figures of a text by counting windows."""
    words = WORD.findall(text or "")
    n = len(words)

    def cover(k):
        seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    while any(v > 1 for v in Counter(tuple(words[i : i + longest + 1]) for i in range(n - longest)).values()):
        longest += 1
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), cover(3), cover(least), longest]


def smallest_reachable(ids, linked):
    """For each id the smallest one that links lead to; ``linked`` is a matrix."""
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label.tolist()
        label = new


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
