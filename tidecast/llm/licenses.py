"""License scans: TF-IDF cosine to templates, then inheritance from directories.

A template is a notice as it stands in headers, a licence file's title or a licence's whole text. A file is one
sequence of words, whatever its lines and comment marks, and a template is laid over it wherever one of its
anchors, its telling words, stands in the file: at the place that brings the two words together. What it
covers, a window of as many words as the template has, is compared with it as sparse vectors, weighted by
frequency in the window and by how few templates have the word (a word of no template weighs most), so
neither the rest of a line nor a wrapped line dilutes it, and a licence file is compared whole with a whole text.
Besides the least cosine the window must have the words that tell a licence from its siblings: its name, kind
and version. Equal windows are compared once, however many files have them. Left out first are templates whose words
in the whole file cannot reach the cosine, or that miss a word a window must have, and files that no template is left for.

A file without a licence of its own takes that of the nearest directory above it which
has a licence file (or an index page, whose path ends in ``/``, with a licence). This is
found for distinct directories, by joining each with its ancestors' paths, and joined to
the files without a licence by their directory; the directories' side is written first, so that Spark knows
its size. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import lower_ascii, written

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} "
    "License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_WORK = "This work is licensed under the GNU {kind} License, version {version}."


def _gnu(kind: str, name: str, version: str, published: str) -> list[str]:
    return [
        _GNU.format(kind=kind, version=version),
        _GNU_WORK.format(kind=kind, version=version),
        f"GNU {kind} License Version {version}, {published}",
        f"SPDX-License-Identifier: {name}-or-later",
        f"SPDX-License-Identifier: {name}-only",
        f"SPDX-License-Identifier: {name}",
    ]


def _creative_commons(kind: str, short: str) -> list[str]:
    return [
        f"Licensed under CC {short} 4.0.",
        f"Licensed under CC-{short}-4.0.",
        f"SPDX-License-Identifier: CC-{short}-4.0",
        f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
    ]


#: Fixed texts: the notices and texts by which files name their licence.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "GPL-3.0": _gnu("General Public", "GPL-3.0", "3", "29 June 2007"),
    "GPL-2.0": _gnu("General Public", "GPL-2.0", "2", "June 1991"),
    "LGPL-3.0": _gnu("Lesser General Public", "LGPL-3.0", "3", "29 June 2007"),
    "LGPL-2.1": _gnu("Lesser General Public", "LGPL-2.1", "2.1", "February 1999"),
    "AGPL-3.0": _gnu("Affero General Public", "AGPL-3.0", "3", "19 November 2007"),
    "CC-BY-4.0": _creative_commons("Attribution", "BY"),
    "CC-BY-SA-4.0": _creative_commons("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-ND-4.0": _creative_commons("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-NC-4.0": _creative_commons("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-NC-SA-4.0": _creative_commons("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _creative_commons("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "proprietary": ["All rights reserved."],
}

#: Titles name a licence at the start of a text and in licence files only; elsewhere they are mentions.
TITLES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}

#: The licence of a file that names no other.
LAST = "proprietary"
#: Words that tell licences apart, as every word with a digit does, and ``under``, which tells a notice from a mention.
NAMES = "under|spdx-license-identifier|apache|mit|isc|bsd|mozilla|gnu|lesser|affero|general|reserved|rights|all|cc|by|by-[a-z-]+|attribution|attribution-[a-z-]+"
#: Anchors of a template that the SQL of the query lays it by; `scan` takes all.
ANCHORS = 3

#: Least cosine.
LEAST = 0.7

TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = "(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([._-][^/]*)?$"


class Templates:
    """The templates' vectors: ``terms`` has a row (template, licence, token, weight) for each
    word, and every template's weights have a norm of one. ``idf`` weighs the words of windows;
    ``required`` has the words that a template's window must have."""

    def __init__(self, texts: Mapping[str, list[str]] = TEMPLATES, titles: Mapping[str, list[str]] = TITLES):
        named = [(name, t, kind) for kind, group in ((False, texts), (True, titles)) for name, ts in group.items() for t in ts]
        self.words = [re.findall(TOKEN, t.lower()) for _, t, _ in named]
        self.licences = [name for name, _, _ in named]
        self.is_title = [kind for _, _, kind in named]
        df = Counter(w for words in self.words for w in set(words))
        self.rare = math.log(1 + len(named))  # the weight of a word that no template has
        self.idf = {w: math.log(1 + len(named) / n) for w, n in sorted(df.items())}
        self.required = [{w for w in words if re.search("[0-9]", w) or re.fullmatch(NAMES, w)} for words in self.words]
        self.terms = []
        for template, words in enumerate(self.words):
            v = {w: n * self.idf[w] for w, n in sorted(Counter(words).items())}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.terms += [(template, self.licences[template], w, x / norm) for w, x in v.items()]

    def anchors(self, least: float, most: int | None = ANCHORS) -> list[tuple[str, int, str, bool, int, int]]:
        """(token, template, licence, is title, place in the template from 0, words of the template).

        Of each template the ``most`` longest telling words, or with None also all of its own that ``telling`` needs.
        """
        telling, rows = set(self.telling(least)), []
        for i, words in enumerate(self.words):
            chosen = sorted({w for w in words if w in telling}, key=lambda w: (-len(w), w))[: most or ANCHORS]
            chosen += [] if most else self.telling_of(i, least)
            rows += [(w, i, self.licences[i], self.is_title[i], k, len(words)) for k, w in enumerate(words) if w in chosen]
        return rows

    def telling(self, least: float) -> list[str]:
        """Words one of which every window has that reaches the threshold.

        Of each template the longest words (the rarest in ordinary text), until those left have
        a norm below the threshold: a window with only those has a cosine of that norm at most.
        """
        return sorted({w for template in range(len(self.words)) for w in self.telling_of(template, least)})

    def telling_of(self, template: int, least: float) -> list[str]:
        """Those of one template."""
        own = sorted(((len(w), x, w) for t, _, w, x in self.terms if t == template), reverse=True)
        words, left = [], 1.0
        for _, x, w in own:
            if math.sqrt(max(left, 0.0)) < least:
                break
            words.append(w)
            left -= x * x
        return words

    def gates(self, least: float) -> list[str]:
        """Words one of which every file has that has a window of the least cosine with the words required: of each template
        the longest one required, or where that is short the telling ones."""
        words: set[str] = set()
        for template, required in enumerate(self.required):
            longest = max(required, key=lambda w: (len(w), w), default="")
            words |= {longest} if len(longest) > 3 else set(self.telling_of(template, least))
        return sorted(words)


def possible(present: Column, templates: Templates, least: float) -> Column:
    """The templates that a file with these words may have a window of, as structs with ``template`` and its ``anchors``.

    It has the words that the template requires, and the template's weights of all words in the file have the
    threshold as their norm: no window's cosine is above that.
    """
    anchors = templates.anchors(least, None)
    every = F.array(*(
        F.struct(
            F.lit(i).alias("template"),
            F.lit(sorted({a[0] for a in anchors if a[1] == i})).alias("anchors"),
            F.lit(sorted(templates.required[i])).cast("array<string>").alias("required"),
            F.map_from_arrays(F.lit([w for t, _, w, _ in templates.terms if t == i]), F.lit([x for t, _, _, x in templates.terms if t == i])).alias("weights"),
        )
        for i in range(len(templates.words))
    ))
    # Similarities are rounded to six digits.
    lowest = (least - 1e-6) ** 2

    def fits(t: Column) -> Column:
        squares = F.aggregate(present, F.lit(0.0), lambda total, w: total + F.coalesce(F.pow(t["weights"][w], 2.0), F.lit(0.0)))
        return F.when(F.size(F.array_except(t["required"], present)) == 0, squares >= lowest).otherwise(False)

    return F.transform(F.filter(every, fits), lambda t: F.struct(t["template"].alias("template"), t["anchors"].alias("anchors")))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and these columns, from a one-row generator: what refers to them later does not evaluate them again."""
    one = F.array(F.struct(*(c.alias(name) for name, c in columns.items())))
    return df.select(*keep, F.explode(one).alias("one")).select(*keep, "one.*")


def windows(files: DataFrame, templates: Templates, least: float, keep: list[str]) -> DataFrame:
    """``keep, template, licence, window``: what each template covers where one of its anchors stands."""
    reach = max(map(len, templates.words))
    table = files.sparkSession.createDataFrame(
        templates.anchors(least, None), "token string, template int, licence string, is_title boolean, place int, n int"
    )
    lowered = lower_ascii(F.col("text"))
    gate = "|".join(re.escape(w) for w in templates.gates(least))
    tokens = F.regexp_extract_all(lowered, F.lit(f"({TOKEN})"), F.lit(1))
    present = F.array_intersect(F.col("tokens"), F.lit(sorted(templates.idf)))
    own = F.array_distinct(F.flatten(F.col("possible.anchors")))
    spots = F.transform(
        F.col("tokens"), lambda t, i: F.when(F.array_contains("own", t), F.struct(t.alias("token"), (i + 1).alias("at")))
    )
    carried = [*keep, "template_ids"]
    gated = files.filter(F.rlike(lowered, F.lit(f"(?<![a-z0-9])(?:{gate})(?![a-z0-9])")))
    words = _once(_once(gated, keep, tokens=tokens), [*keep, "tokens"], present=present)
    left = _once(words, [*keep, "tokens"], possible=possible(F.col("present"), templates, least)).filter(F.size("possible") > 0)
    found = (
        _once(left, [*keep, "tokens"], own=own, template_ids=F.col("possible.template"))
        .select(*carried, "tokens", F.explode(F.array_compact(spots)).alias("spot"))
        .select(*carried, "spot", F.greatest(F.col("spot.at") - reach, F.lit(1)).alias("from"), "tokens")
        .select(*carried, "spot", "from", F.slice("tokens", F.col("from"), F.lit(2 * reach)).alias("near"))
        .select(*carried, "spot.token", "spot.at", "from", "near")
        .join(F.broadcast(table), "token")
        .filter(F.array_contains("template_ids", F.col("template")))
    )
    start = F.col("at") - F.col("place")
    counts = ~F.col("is_title") | (start == 1) | F.coalesce(F.rlike("path", F.lit(LICENCE_FILE)), F.lit(False))
    covered = F.slice("near", F.greatest(start, F.lit(1)) - F.col("from") + 1, F.col("n") + F.least(start, F.lit(1)) - 1)
    return found.filter(counts).select(*keep, "template", "licence", F.array_join(covered, " ").alias("window")).distinct()


def window_licences(found: DataFrame, templates: Templates, least: float) -> DataFrame:
    """``window, template, similarity`` of the distinct windows that are near enough and have the required words."""
    terms = [(t, w, x, w in templates.required[t]) for t, _, w, x in templates.terms]
    spark = found.sparkSession
    terms = F.broadcast(spark.createDataFrame(terms, "template int, token string, weight double, needed boolean"))
    idf = F.broadcast(spark.createDataFrame(list(templates.idf.items()), "token string, idf double"))
    needs = F.broadcast(spark.createDataFrame([(i, len(r)) for i, r in enumerate(templates.required)], "template int, needs long"))
    counted = (
        found.select("window", "template").distinct()
        .select("window", "template", F.explode(F.split("window", " ")).alias("token"))
        .groupBy("window", "template", "token").count()
    )
    x = F.col("count") * F.coalesce("idf", F.lit(templates.rare))
    weighted = counted.join(idf, "token", "left").join(terms, ["template", "token"], "left").withColumn("x", x)
    compared = weighted.groupBy("window", "template").agg(
        F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))).alias("dot"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
        F.count(F.when(F.col("needed"), 1)).alias("has"),
    )
    near = compared.join(needs, "template").filter("has = needs")
    return near.select("window", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).filter(F.col("similarity") >= least)


def directory(path: Column) -> Column:
    """Up to the last ``/``; empty at the top."""
    return F.regexp_extract(path, "(?s)^(.*/)?[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """A directory's own path and those above it, the empty one included."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    )


def scan(files: DataFrame, templates: Templates | None = None, least: float = LEAST) -> DataFrame:
    """A row for each row of ``files`` (kind, id, path, text): kind, id, path, ``own_licence`` and
    ``similarity`` of its nearest window, ``licence`` (its own or inherited) and ``from_directory``
    (where an inherited one is from, else null).

    Of equally near templates the first name counts; ``LAST`` counts only where no other licence is near.
    Null and empty texts have no licence of their own. A null path has no directory and
    inherits nothing. Rows with the same kind, id and path share their licences. Files without
    any licence have nulls; an empty table gives an empty one. Other columns are not read. A very long text is
    taken whole, as one row's words, if it has an anchor.
    """
    templates = templates or Templates()
    key = ["kind", "id", "path"]
    found = written(windows(files.select(*key, "text"), templates, least, key), "licence-windows")
    near = found.join(window_licences(found, templates, least), ["window", "template"])
    order = F.struct((F.col("licence") == LAST).alias("last"), (-F.col("similarity")).alias("less"), "licence")
    best = (
        near.groupBy(*key)
        .agg(F.min(order).alias("best"))
        .select(
            *(F.col(k).alias(f"_{k}") for k in key),
            (-F.col("best.less")).alias("similarity"),
            F.col("best.licence").alias("own_licence"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    scanned = files.select(*key).join(written(best, "own-licences"), same, "left").drop(*(f"_{k}" for k in key))
    scanned = written(scanned.withColumn("folder", directory(F.col("path"))), "scanned-files")

    says = F.rlike("path", F.lit(LICENCE_FILE)) | F.endswith("path", F.lit("/"))
    declared = (
        scanned.filter(says & F.col("own_licence").isNotNull())
        .groupBy(F.col("folder").alias("above"))
        .agg(F.min(F.struct((F.col("own_licence") == LAST).alias("last"), (-F.col("similarity")).alias("less"), "own_licence")).getField("own_licence").alias("declared"))
    )
    inherited = (
        scanned.filter("own_licence IS NULL AND folder IS NOT NULL")
        .select("folder")
        .distinct()
        .withColumn("above", F.explode(ancestors(F.col("folder"))))
        .join(declared, "above")
        .groupBy("folder")
        .agg(F.max(F.struct(F.length("above").alias("size"), "above", "declared")).alias("nearest"))
        .select("folder", "nearest.above", "nearest.declared")
    )
    nothing = F.lit(None).cast("string")
    own = scanned.filter("own_licence IS NOT NULL").select(
        *key, "own_licence", "similarity", F.col("own_licence").alias("licence"), nothing.alias("from_directory")
    )
    rest = scanned.filter("own_licence IS NULL").join(written(inherited, "inherited-licences"), "folder", "left")
    return own.unionByName(
        rest.select(*key, "own_licence", "similarity", F.col("declared").alias("licence"), F.col("above").alias("from_directory"))
    )
