"""Toxicity, URL filters and licences; the registered queries; the pipeline."""

import pytest
from compare import connect, differences
from helpers import AWKWARD, awkward, rows_of, with_clashes

import __spark_entry__ as contract
import corpus_pipeline
from tidecast.llm import licenses, queries, toxicity, url_filter
from tidecast.llm.oracle import ORACLE


def toxic_rows(n=400):
    """Texts of made-up words; every fourth has insults in it and is labelled toxic."""
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("lor", "min", "tas")]
    rows, labels = [], []
    for i in range(n):
        own = [words[(i * 7 + k * k * 3 + k) % len(words)] for k in range(60)]
        if i % 4 == 0:
            for k in range(5, 60, 11):
                own[k] = ("zorgling", "quibnash", "vexmuck")[(i + k) % 3]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_of_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = with_clashes(spark.createDataFrame(rows + [(None, None), (900, ""), (0, rows[0][1])], "doc_id bigint, text string"))
    marks = spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    got = toxicity.scores(docs, marks).collect()
    assert len(got) == len(rows) + 3
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(4, 0), (5, 0)], 0.0), ([(4, 1), (5, 1), (6, 1)], 1.0)])
def test_toxicity_without_both_labels(spark, labels, score):
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.scores(awkward(spark), marks).collect()
    assert len(got) == len(AWKWARD) and {r["score"] for r in got} == {score}
    assert toxicity.scores(awkward(spark).limit(0), marks).count() == 0


URLS = [
    ("HTTP://WWW.Example.ORG/es/1?x=/en/", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#top", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.b.example.org/en/2", "a.b.example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
    ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("https://x.org", "x.org", "", None, None),
    ("https://xcom/de/", "xcom", "/de/", None, None),
    ("no scheme/de/", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("x://?q", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_url_rules_and_model(spark):
    more = [(f"https://h{i}.com/{'de' if i % 2 else 'fr'}/{i}", "", "", "", "") for i in range(60)]
    rows = [(i, u[0]) for i, u in enumerate(URLS + more)] + [(0, URLS[0][0]), (None, URLS[0][0])]
    pages = with_clashes(spark.createDataFrame(rows, "page_id bigint, url string"))
    got = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    # What the rules say of .com holds for the same paths elsewhere.
    new = spark.createDataFrame([(i, f"https://h{i}.net/{'de' if i % 2 else 'fr'}/{i}") for i in range(40)], "page_id bigint, url string")
    judged = url_filter.judge(pages.select("page_id", "url").unionByName(new.selectExpr("page_id + 1000 AS page_id", "url")), queries.URL_RULES)
    found = [(r["page_id"], r["verdict"]) for r in judged.filter("page_id >= 1000").collect()]
    assert sum((v == "block") == bool(i % 2) for i, v in found) >= 36


def test_urls_without_both_verdicts(spark):
    pages = spark.createDataFrame([(1, "https://x.com/de/a"), (2, None)], "page_id bigint, url string")
    assert {r["verdict"] for r in url_filter.judge(pages, queries.URL_RULES).collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_licences_are_found_and_inherited(spark):
    files = [
        ("f", 1, "a/LICENSE", "Released under the MIT License."),
        ("f", 2, "a/x.txt", "no licence here"),
        ("f", 3, "a/b/c/y.txt", None),
        ("f", 4, "a/b/COPYING.md", "x\nThis work is licensed under the GNU General Public License, version 3.\ny"),
        ("f", 5, "a/b/z.txt", "All rights reserved.\ntext"),
        ("f", 6, "top.txt", ""),
        ("f", 7, None, "Licensed under the Apache License, Version 2.0."),
        ("f", 8, "ab/x.txt", "the licensed of a version " * 40),
        ("f", 8, "ab/x.txt", "the licensed of a version " * 40),
        (None, None, "d/", "Licensed under CC BY-NC 4.0."),
        ("f", 9, "d/e", "t"),
    ]
    df = spark.createDataFrame(files, "kind string, id bigint, path string, text string")
    got = licenses.scan(with_clashes(df))
    assert got.count() == len(files)
    said = {r["id"]: (r["own_licence"], r["licence"], r["from_directory"]) for r in got.collect()}
    assert said == {
        1: ("MIT", "MIT", None),
        2: (None, "MIT", "a/"),
        3: (None, "GPL-3.0", "a/b/"),
        4: ("GPL-3.0", "GPL-3.0", None),
        5: ("proprietary", "proprietary", None),
        6: (None, None, None),
        7: ("Apache-2.0", "Apache-2.0", None),
        8: (None, None, None),
        9: (None, "CC-BY-NC-4.0", "d/"),
        None: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
    }
    assert licenses.scan(df.limit(0)).count() == 0


GNU = "you can redistribute it and/or modify\n# it under the terms of the GNU {} License as published by\n# the Free Software Foundation, either version {} of the License, or"
NOTICES = [
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance', "Apache-2.0"),
    ("The article ends here and is our own. Released under the MIT License.", "MIT"),
    ("# Licensed under the MIT license. See LICENSE file in the project root for full text.", "MIT"),
    ("Copyright (c) 2024 Jane Doe. All rights reserved.", "proprietary"),
    ("MIT License\n\nCopyright (c) 2024 Jane Doe", "MIT"),
    ("a page that mentions the MIT License in passing", None),
    ("# This program is free software: " + GNU.format("General Public", 3), "GPL-3.0"),
    ("# This program is free software: " + GNU.format("General Public", 2), "GPL-2.0"),
    ("# This program is free software: " + GNU.format("Lesser General Public", 3), "LGPL-3.0"),
    ("# This program is free software: " + GNU.format("Affero General Public", 3), "AGPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 9.", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-4.0"),
    ("Copyright 2020 X. All rights reserved. SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("x " * 3000 + "licensed under the apache\n * license, version 2.0" + " y" * 3000, "Apache-2.0"),
    ("all rights of the reserved kind, licensed to nobody, a general public", None),
]


def test_notices_of_headers(spark):
    files = [("f", i, f"d{i}/x.py", text) for i, (text, _) in enumerate(NOTICES)]
    got = licenses.scan(spark.createDataFrame(files, "kind string, id int, path string, text string"))
    assert {NOTICES[r["id"]][0][:80]: r["own_licence"] for r in got.collect()} == {t[:80]: name for t, name in NOTICES}


def test_whole_licence_files_and_ties(spark):
    """A whole text in a licence file, reworded a little; of equally near licences the first name."""
    text = next(t for t in licenses.TEMPLATES["MIT"] if len(t) > 300).replace("to deal in the Software", "to deal with the Software")
    files = [
        ("f", 1, "a/LICENSE", "Copyright (c) 2024 Jane Doe\n\n" + text.replace(", ", ",\n")),
        ("f", 2, "a/src/x.c", "int x;"),
        ("f", 3, "b/x.c", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC"),
        ("f", 4, "c/COPYING", "This is under the MIT License"),
        ("f", 5, "c/y.c", ""),
    ]
    got = licenses.scan(spark.createDataFrame(files, "kind string, id int, path string, text string")).collect()
    assert {r["id"]: (r["own_licence"], r["licence"]) for r in got} == {
        1: ("MIT", "MIT"), 2: (None, "MIT"), 3: ("ISC", "ISC"), 4: ("MIT", "MIT"), 5: (None, "MIT"),
    }


def test_notices_without_their_longest_words(spark):
    """A notice is found by any of its telling words, not only by the three longest, which these lack."""
    notice = "Permssion is hereby granted, free of charge, to any person obtainng a copy of this softwre"
    templates = licenses.Templates()
    assert not {a[0] for a in templates.anchors(licenses.LEAST) if a[1] == 5} & set(notice.lower().replace(",", "").split())
    files = [("f", 1, "a/x.c", "x\n" * 50 + notice), ("f", 2, "b/x.c", "granted to nobody, a charge to every person")]
    got = licenses.scan(spark.createDataFrame(files, "kind string, id int, path string, text string"))
    assert {r["id"]: r["own_licence"] for r in got.collect()} == {1: "MIT", 2: None}


def test_files_left_out_have_no_window_near_enough():
    """Gates and the bound on cosines: a text of a template's required words and enough others passes both."""
    templates = licenses.Templates()
    gates = set(templates.gates(licenses.LEAST))
    for i, required in enumerate(templates.required):
        weights = {w: x for t, _, w, x in templates.terms if t == i}
        assert required & gates or sum(x * x for w, x in weights.items() if w not in gates) ** 0.5 < licenses.LEAST


def test_telling_words_lose_no_line():
    """A line of a template's words without the telling ones stays below the threshold."""
    templates = licenses.Templates()
    telling = set(templates.telling(licenses.LEAST))
    for t in {x[0] for x in templates.terms}:
        rest = sum(x * x for k, _, w, x in templates.terms if k == t and w not in telling)
        assert rest**0.5 < licenses.LEAST


def test_registered():
    names = set(contract.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(ORACLE) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = queries.QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert differences(result.toPandas(), expected.df()) == []


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] and counts[-1] > 0
    result = rows_of(corpus_pipeline.run(spark, sf_dir).select("doc_id", "text", "decoded"))
    assert [x[0] for x in result] == [x[0] for x in rows_of(docs.select("doc_id", "text"))]
    assert all(bytes(d) == (t or "").encode() for _, t, d in result)
