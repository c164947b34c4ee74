"""DuckDB SQL for the queries that SQL can express on whole tables."""

_TERMS = """
    WITH once AS (
        SELECT term, doc_id, block_no, arg_max(freq, (indexed_at, freq)) AS freq FROM (
            SELECT lower(trim(term)) AS term, doc_id, block_no, freq, coalesce(indexed_at, TIMESTAMP '0001-01-01') AS indexed_at
            FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL)
        GROUP BY ALL),
    counted AS (
        SELECT term, CAST(coalesce(sum(freq), 0) AS BIGINT) AS occurrences, count(DISTINCT doc_id) AS documents FROM once GROUP BY 1),
    marked AS (
        SELECT *, CASE WHEN documents <= 2 THEN 'rare'
                       WHEN documents >= 0.25 * (SELECT count(DISTINCT doc_id) FROM docs) THEN 'common' END AS mark FROM counted)"""

_SITES = """
    WITH own AS (
        SELECT path, parent, content, body_start, nullif(lower(trim(split_part(resource, '/', 1))), '') AS site FROM documents_okf),
    votes AS (SELECT parent, site, count(*) AS n FROM own WHERE site IS NOT NULL AND parent IS NOT NULL GROUP BY ALL),
    parents AS (SELECT parent, site FROM votes QUALIFY row_number() OVER (PARTITION BY parent ORDER BY n DESC, site) = 1),
    sited AS (
        SELECT path, coalesce(own.site, parents.site) AS site, decode(encode(content)[coalesce(body_start, 0) + 1:]) AS body
        FROM own LEFT JOIN parents ON own.parent = parents.parent),
    lines AS (
        SELECT path, site, lower(trim(regexp_replace(unnest(string_split(body, chr(10))), '[\\s\\p{Z}\\x{0B}\\x{85}]+', ' ', 'g'))) AS line FROM sited WHERE site IS NOT NULL)"""

_NEAR = """
    WITH texts AS (SELECT DISTINCT path, coalesce(title, '') || ' ' || coalesce(decode(encode(content)[coalesce(body_start, 0) + 1:]), '') AS t FROM documents_okf WHERE path IS NOT NULL),
    words AS (SELECT path, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM texts),
    runs AS (SELECT DISTINCT path, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words),
    sizes AS (SELECT path, count(*) AS n FROM runs GROUP BY 1),
    shared AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS c FROM runs a JOIN runs b ON a.s = b.s AND a.path < b.path GROUP BY ALL),
    near AS (SELECT path_a, path_b, c = x.n AND c = y.n AS equal FROM shared JOIN sizes x ON x.path = path_a JOIN sizes y ON y.path = path_b WHERE c >= 0.6 * (x.n + y.n - c))"""

_CLASSES = f"""{_NEAR.replace("WITH texts", "WITH RECURSIVE texts")},
    sides AS (SELECT path_a AS a, path_b AS b, equal FROM near UNION ALL SELECT path_b, path_a, equal FROM near),
    class AS (SELECT path, least(path, coalesce(min(b), path)) AS first, 1 + count(b) AS size FROM sizes LEFT JOIN (SELECT * FROM sides WHERE equal) ON path = a GROUP BY path)"""

_REPEATED = f"""{_SITES},
    counted AS (SELECT site, line, count(DISTINCT path) AS docs FROM lines WHERE length(line) >= 30 GROUP BY ALL)"""

SQL: dict[str, str] = {
    # of results that SQL can't make: what has to hold of them
    "p1_unchanged": "SELECT DISTINCT path, TRUE AS ok FROM documents_okf WHERE path IS NOT NULL AND content IS NOT NULL",
    "p2_unchanged": """
        SELECT DISTINCT 'documents_okf' AS tbl, path AS rec_key, TRUE AS ok FROM documents_okf WHERE path IS NOT NULL AND content IS NOT NULL
        UNION ALL SELECT DISTINCT 'chunks', source_id || '#' || chunk_no, TRUE FROM chunks WHERE source_id IS NOT NULL AND chunk_no IS NOT NULL AND text IS NOT NULL""",
    "p3_joined": "SELECT DISTINCT source_id, chunk_no, strlen(text) AS bytes, md5(text) AS md5, TRUE AS fits FROM chunks WHERE strlen(text) > 8192",
    "p8_decoded": "SELECT doc_id, strlen(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS md5 FROM documents",
    "p9_kept": """
        WITH w AS (SELECT source, sum(weight) AS weight, CAST(max(greatest(coalesce(max_repeats, 1), 0)) AS INT) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND weight > 0 GROUP BY 1)
        SELECT source, round(weight / (SELECT sum(weight) FROM w), 9) AS target_share, max_repeats, TRUE AS ok FROM w""",
    "p10_counted": "SELECT source, count(*) AS documents, TRUE AS ok FROM documents GROUP BY 1",
    "p3_found": "SELECT DISTINCT source_id, chunk_no FROM chunks WHERE strlen(text) > 8192",
    "p4_found": f"{_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_term_frequencies": f"{_TERMS} SELECT term, occurrences, documents, mark FROM marked",
    "p6_templates": f"""{_SITES},
        long AS (SELECT DISTINCT path, site, line, string_split(line, ' ') AS t FROM lines WHERE length(line) >= 30 AND path IS NOT NULL),
        placed AS (SELECT *, len(t) AS n, list_transform(t[1:4], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS way FROM long),
        nodes AS (SELECT site, n, way, count(DISTINCT line) AS lines, count(DISTINCT path) AS docs FROM placed GROUP BY ALL HAVING count(DISTINCT path) >= 6),
        slots AS (SELECT site, n, way, generate_subscripts(t, 1) AS i, unnest(list_concat(way, t[5:])) AS token FROM placed),
        merged AS (SELECT site, n, way, i, CASE WHEN min(token) = max(token) THEN min(token) ELSE '<*>' END AS token FROM slots GROUP BY ALL),
        named AS (SELECT site, n, way, string_agg(token, ' ' ORDER BY i) AS template FROM merged GROUP BY ALL)
        SELECT site, template, lines, docs FROM nodes JOIN named USING (site, n, way)""",
    "p6_cleaned": f"""{_REPEATED},
        latest AS (SELECT path, site, body, row_number() OVER (PARTITION BY path ORDER BY 1) AS r FROM (SELECT DISTINCT path, site, body FROM sited)),
        heads AS (SELECT path, any_value(content) AS content, any_value(decode(encode(content)[1:coalesce(body_start, 0)])) AS head FROM documents_okf GROUP BY 1),
        cut AS (SELECT path, site, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM latest WHERE r = 1),
        normal AS (SELECT *, lower(trim(regexp_replace(raw, '[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+', ' ', 'g'))) AS line FROM cut),
        kept AS (SELECT n.*, c.docs IS NULL AS keep FROM normal n LEFT JOIN (SELECT * FROM counted WHERE docs >= 6) c ON n.site = c.site AND n.line = c.line),
        joined AS (SELECT path, site, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (keep), '') AS body, count(*) FILTER (NOT keep) AS removed FROM kept GROUP BY ALL)
        SELECT path, coalesce(j.site, l.site) AS site, CASE WHEN content IS NOT NULL THEN head || j.body END AS content, CAST(coalesce(removed, 0) AS INT) AS removed
        FROM latest l LEFT JOIN joined j USING (path) LEFT JOIN heads USING (path) WHERE l.r = 1""",
    "p7_found": f"{_NEAR} SELECT path_a, path_b FROM near",
    "p7_members": f"{_CLASSES} SELECT path, first, size FROM class",
    "p7_groups": f"""{_CLASSES},
        reach AS (SELECT path AS p, path AS q FROM sizes UNION SELECT p, b FROM reach JOIN sides ON q = a),
        parts AS (SELECT p, min(q) AS "group" FROM reach GROUP BY 1),
        degree AS (SELECT a, count(DISTINCT o.first) AS links FROM sides JOIN class m ON m.path = a JOIN class o ON o.path = b WHERE o.first <> m.first GROUP BY 1)
        SELECT p AS path, "group", CAST(coalesce(links, 0) AS BIGINT) AS links FROM parts LEFT JOIN degree ON a = p""",
    "p6_found": f"{_SITES} SELECT site, line FROM lines WHERE length(line) >= 30 GROUP BY ALL HAVING count(DISTINCT path) >= 6",
}
