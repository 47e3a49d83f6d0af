"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tidecast.llm import collocations, decontaminate, fill_middle, licenses, quality, queries, warc

_WORDS = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    """Repeated windows of k words cover what repeats of k or more words cover, and a repeat
    is longer than m words exactly if a window of m + 1 words repeats."""

    def covered(k: int) -> str:
        return f"""
            SELECT doc_id, count(*) AS n FROM (
                SELECT DISTINCT doc_id, unnest(range(p, p + {k})) FROM (
                    SELECT doc_id, unnest(ps) AS p FROM (
                        SELECT doc_id, list(p) AS ps FROM (
                            SELECT doc_id, p, array_to_string(w[p : p + {k - 1}], ' ') AS g
                            FROM (SELECT doc_id, w, unnest(range(1, n_words - {k} + 2)) AS p FROM counted)
                        ) GROUP BY doc_id, g HAVING count(*) > 1
                    )
                )
            ) GROUP BY doc_id"""

    return f"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
        ), counted AS (
            SELECT *, len(w) AS n_words,
                list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORDS}')) AS lines
            FROM texts
        ), windows AS ({covered(3)}), repeats AS ({covered(quality.MIN_REPEAT)}),
        long_repeats AS ({covered(quality.MAX_REPEAT + 1)}),
        figures AS (
            SELECT doc_id, n_words, length(array_to_string(w, '')) AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(windows.n, 0) AS n_repeat_words, coalesce(repeats.n, 0) AS n_covered_words,
                long_repeats.n IS NOT NULL AS long_repeat
            FROM counted LEFT JOIN windows USING (doc_id) LEFT JOIN repeats USING (doc_id)
                LEFT JOIN long_repeats USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
            n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_WINDOW_PERCENT} * n_words AS base_failed,
            NOT base_failed AND 100 * n_covered_words <= {quality.MAX_COVER_PERCENT} * n_words AND NOT long_repeat AS kept
        FROM figures
    """


ORACLE: dict[str, str] = {"op9_quality": _quality()}


def _licenses() -> str:
    t = licenses.Templates()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    terms = ", ".join(f"({i}, {quote(w)}, {x!r}::DOUBLE, {w in t.required[i]})" for i, _, w, x in t.terms)
    idf = ", ".join(f"({quote(w)}, {x!r}::DOUBLE)" for w, x in t.idf.items())
    anchors = ", ".join(f"({quote(w)}, {i}, {quote(name)}, {title}, {k}, {n})" for w, i, name, title, k, n in t.anchors(licenses.LEAST))
    order = lambda name: f"{{'last': {name} = '{licenses.LAST}', 's': -similarity, 'licence': {name}}}"
    return rf"""
        WITH terms(template, token, weight, needed) AS (VALUES {terms}), idf(token, idf) AS (VALUES {idf}),
        anchors(token, template, licence, is_title, place, n) AS (VALUES {anchors}),
        needs AS (SELECT template, count(*) FILTER (needed) AS needs FROM terms GROUP BY template),
        files AS (
            SELECT 'document' AS kind, doc_id AS id, source || '/' || doc_id AS path, text FROM documents
            UNION ALL
            SELECT 'page', page_id,
                translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    || regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1),
                regexp_replace(html, '<[^>]*>', chr(10), 'g') FROM pages
        ), texts AS MATERIALIZED (
            SELECT row_number() OVER () AS file, path,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.TOKEN}') AS w, kind, id
            FROM files
        ), tokens AS (SELECT file, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM texts),
        placed AS (
            SELECT file, template, licence, n, pos - place AS start, is_title FROM tokens JOIN anchors USING (token)
        ), windows AS MATERIALIZED (
            SELECT DISTINCT file, template, licence, array_to_string(w[greatest(start, 1) : start + n - 1], ' ') AS win
            FROM placed JOIN texts USING (file)
            WHERE NOT is_title OR start = 1 OR coalesce(regexp_matches(path, '{licenses.LICENCE_FILE}'), false)
        ), counted AS (
            SELECT win, template, token, count(*) AS c
            FROM (SELECT win, template, unnest(string_split(win, ' ')) AS token FROM (SELECT DISTINCT win, template FROM windows)) GROUP BY ALL
        ), near AS (
            SELECT win, template, round(sum(x * coalesce(weight, 0)) / sqrt(sum(x * x)), 6) AS similarity
            FROM (
                SELECT win, c.template, weight, needed, c * coalesce(idf, {t.rare!r}) AS x
                FROM counted c LEFT JOIN idf USING (token) LEFT JOIN terms ON terms.template = c.template AND terms.token = c.token
            ) JOIN needs USING (template)
            GROUP BY win, template, needs HAVING count(*) FILTER (needed) = needs
        ), best AS (
            SELECT file, min({order("licence")}) AS b FROM windows JOIN near USING (win, template)
            WHERE similarity >= {licenses.LEAST} GROUP BY file
        ), own AS (
            SELECT kind, id, path, min(b) AS b FROM texts JOIN best USING (file) GROUP BY ALL
        ), scanned AS (
            SELECT f.kind, f.id, f.path, -b.s AS similarity, b.licence AS own_licence, regexp_extract(f.path, '(?s)^(.*/)?[^/]*$', 1) AS folder
            FROM files f LEFT JOIN own ON f.kind = own.kind AND f.id IS NOT DISTINCT FROM own.id AND f.path IS NOT DISTINCT FROM own.path
        ), declared AS (
            SELECT folder AS above, min({order("own_licence")}).licence AS declared FROM scanned
            WHERE own_licence IS NOT NULL AND (ends_with(path, '/') OR regexp_matches(path, '{licenses.LICENCE_FILE}')) GROUP BY 1
        ), inherited AS (
            SELECT folder, max({{'n': length(above), 'above': above, 'declared': declared}}) AS n
            FROM (SELECT DISTINCT folder FROM scanned WHERE own_licence IS NULL) JOIN declared ON starts_with(folder, above) GROUP BY folder
        )
        SELECT kind, id, path, own_licence, similarity, coalesce(own_licence, n.declared) AS licence,
            CASE WHEN own_licence IS NULL THEN n.above END AS from_directory
        FROM scanned LEFT JOIN inherited USING (folder)
    """


ORACLE["op10_licenses"] = _licenses()


def _contained() -> str:
    k = decontaminate.SHINGLE

    def shingled(table: str, key: str) -> str:
        words = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')"
        return f"""
            SELECT DISTINCT {key}, array_to_string(w[i : i + {k - 1}], ' ') AS s
            FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"""

    return f"""
        WITH d AS ({shingled("documents", "doc_id")}), b AS ({shingled("benchmark", "item_id")}),
        sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment
        FROM shared JOIN sizes USING (item_id) WHERE n_shared >= {decontaminate.LEAST} * n_shingles - 1e-9
    """


ORACLE["op5_decontaminate"] = _contained()


def _fill_middle() -> str:
    r = fill_middle.Recipe()
    h = [f"('0x' || h[{8 * i + 1} : {8 * i + 8}])::BIGINT" for i in range(4)]
    marked = " OR ".join(f"contains(t, '{m}')" for m in (r.prefix_mark, r.suffix_mark, r.middle_mark))
    return rf"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                sha256('{r.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), cuts AS (SELECT *, len(u) AS n, {h[0]} % (len(u) + 1) AS c1, {h[1]} % (len(u) + 1) AS c2 FROM texts),
        sections AS (
            SELECT doc_id, t, n,
                CASE WHEN t = '' OR {marked} OR {h[2]} % 100 >= {r.rate} THEN 'plain' WHEN {h[3]} % 100 < {r.spm} THEN 'spm' ELSE 'psm' END AS form,
                array_to_string(u[1 : least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
                array_to_string(u[greatest(c1, c2) + 1 :], '') AS s
            FROM cuts
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t
                WHEN 'psm' THEN '{r.prefix_mark}' || p || '{r.suffix_mark}' || s || '{r.middle_mark}' || m
                ELSE '{r.suffix_mark}' || s || '{r.prefix_mark}' || p || '{r.middle_mark}' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM sections
    """.replace("\\n", "\n")


ORACLE["op11_fill_middle"] = _fill_middle()


def _collocations() -> str:
    least, best, absorbed, longest = queries.LEAST_OCCURRENCES, queries.BEST_PHRASES, queries.ABSORBED, collocations.LONGEST
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i : i + {k - 1}], ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)"
        for k in range(1, longest + 1)
    )
    return rf"""
        WITH pieces AS MATERIALIZED (
            SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
                FROM documents)
        ), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
        longer AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        inside AS (
            SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM longer))
        ), most AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
        kept AS (SELECT longer.* FROM longer LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < {absorbed} * a),
        cuts AS (
            SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, a, n,
                min({{'score': ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT, 'cut': cut, 'l': x.f, 'r': y.f}}) AS s
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
                JOIN totals ON totals.lang = cuts.lang
            GROUP BY ALL
        )
        SELECT lang, rank, phrase, a, s.l AS l, s.r AS r, n, s.score AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank FROM scored
        ) WHERE rank <= {best}
    """


ORACLE["op12_collocations"] = _collocations()
ORACLE["op13_warc"] = f"""
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    equal AS (SELECT h, max(page_id) AS winner FROM payloads WHERE strlen(h) >= {warc.LEAST} GROUP BY h)
    SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
        CASE WHEN page_id IS DISTINCT FROM winner AND winner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
    FROM payloads p LEFT JOIN equal ON p.h = equal.h
"""
