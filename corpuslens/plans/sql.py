"""DuckDB SQL for the core's queries."""

import regex

from corpuslens.functions.text import STOP_WORDS


def _alphabetic() -> str:
    """Ranges of alphabetic characters that are neither letters nor numbers, such as vowel signs; RE2 has no name for them."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    runs = [m.group() for m in regex.finditer(r"(?V1)[\p{Alphabetic}--[\p{L}\p{N}]]+", every)]
    return "".join(f"\\x{{{ord(r[0]):X}}}-\\x{{{ord(r[-1]):X}}}" for r in runs)


_LETTERS = "\\p{L}\\p{N}" + _alphabetic()
_CONTROL = "".join(chr(c) for c in [*range(1, 32), 127])

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _tokens(source: str, key: str) -> str:
    """`tok(<key>, i, token, pos)` of source(<key>, text, base)."""
    return f"""
    cut AS (SELECT {key}, base, regexp_extract_all(text, '[^{_LETTERS}]*[{_LETTERS}]+') AS m FROM ({source})),
    piece AS (SELECT {key}, base, unnest(m) AS m, generate_subscripts(m, 1) - 1 AS i FROM cut),
    tok AS (
        SELECT {key}, CAST(i AS INT) AS i, lower(w) AS token,
               CAST(base + sum(strlen(m)) OVER (PARTITION BY {key}, base ORDER BY i) - strlen(w) AS BIGINT) AS pos
        FROM (SELECT *, regexp_extract(m, '[{_LETTERS}]+$') AS w FROM piece))"""


_DOCS = _tokens("SELECT doc_id, text, 0 AS base FROM documents WHERE text IS NOT NULL", "doc_id")
_POSTED = f"""{_DOCS},
    posted AS (SELECT token AS term, doc_id, count(*) AS freq, list(pos ORDER BY i)[1:16] AS positions FROM tok GROUP BY ALL),
    sized AS (SELECT d.doc_id, count(t.i) AS token_count FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY 1)"""


def _edits(word: str, term: str) -> str:
    """Levenshtein by character: DuckDB's goes by byte, so letters beyond ASCII become one control character each."""
    letters = "äöüßéèêàâçñóíáúęąćłńśźżôîëï"
    fold = "".join(_CONTROL[i % len(_CONTROL)] for i in range(len(letters)))
    return f"levenshtein(translate({word}, '{letters}', '{fold}'), translate({term}, '{letters}', '{fold}'))"


_MATCH = f"""CASE WHEN strlen(q) < 3 THEN term = q
        WHEN strlen(q) = 3 THEN starts_with(term, q) AND strlen(term) <= 5
        ELSE contains(term, q) OR (abs(strlen(term) - strlen(q)) <= CASE WHEN strlen(q) <= 7 THEN 1 ELSE 2 END
             AND {_edits('term', 'q')} <= CASE WHEN strlen(q) <= 7 THEN 1 ELSE 2 END) END"""


def _match(terms: list[str]) -> str:
    asked = ", ".join(f"('{t}')" for t in terms)
    return f"""
    WITH vocab AS (SELECT DISTINCT lower(trim(term)) AS term FROM postings WHERE term IS NOT NULL)
    SELECT q, term FROM vocab, (VALUES {asked}) a(q) WHERE {_MATCH}"""


def _asked(queries: dict[int, str]) -> str:
    """`asked(query_id, qi, q)`: the terms of each query without stop words."""
    rows = ", ".join(f"({k}, '{q}')" for k, q in queries.items())
    return f"""
    given AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM (VALUES {rows}) v(query_id, query)),
    asked AS (SELECT CAST(query_id AS BIGINT) AS query_id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS qi, unnest(w) AS q FROM given)"""


def _slots(queries: dict[int, str]) -> str:
    return f"""WITH {_POSTED}, {_asked(queries)},
    vocab AS (SELECT DISTINCT term FROM posted),
    found AS (SELECT q, term FROM vocab, (SELECT DISTINCT q FROM asked) WHERE {_MATCH}),
    merged AS (SELECT q, doc_id, sum(freq) AS freq, list_sort(flatten(list(positions))) AS positions FROM posted JOIN found USING (term) GROUP BY ALL),
    slots AS (SELECT query_id, qi, doc_id, CAST(freq AS BIGINT) AS freq, positions FROM merged JOIN asked USING (q))"""


_HITS = """
    hits AS (SELECT query_id, doc_id, count(*) AS coverage, CAST(sum(freq) AS BIGINT) AS freq FROM slots GROUP BY ALL),
    ranked AS (
        SELECT query_id, doc_id, coverage, freq, token_count, CAST(freq * 1000 // greatest(token_count, 1) AS BIGINT) AS score FROM hits JOIN sized USING (doc_id)),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, score DESC, doc_id) AS INT) AS rank FROM ranked)"""


def _rank(queries: dict[int, str]) -> str:
    return f"{_slots(queries)}, {_HITS}"


_ALL = {1: "Which battery clamp holds the Öl sensor node?", 2: "node node charging map", 3: "zeroo signaal emergancy buttom", 4: "öl 12 amr red the"}

_ANCHORS = f"""{_slots(_ALL)},
    places AS (SELECT DISTINCT query_id, doc_id, unnest(positions) AS p FROM slots),
    near AS (
        SELECT query_id, doc_id, a.p, count(DISTINCT qi) AS near
        FROM places a JOIN (SELECT query_id, doc_id, qi, unnest(positions) AS y FROM slots) s USING (query_id, doc_id)
        WHERE abs(s.y - a.p) <= 500 GROUP BY ALL),
    anchors AS (SELECT query_id, doc_id, p, CAST(near AS INT) AS near, CAST(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY near DESC, p) - 1 AS INT) AS k FROM near)"""

_WINDOWS = f"""{_ANCHORS},
    taken AS (
        SELECT query_id, doc_id, list_reduce(
            list_prepend(CAST([] AS STRUCT(s BIGINT, e BIGINT)[]), list([{{'s': p, 'e': p}}] ORDER BY k)),
            lambda acc, x: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda w: x[1].s >= w.s AND x[1].s < w.e)) > 0 THEN acc
                           ELSE list_append(acc, {{'s': greatest(x[1].s - 150, 0), 'e': x[1].s + 300}}) END) AS w
        FROM anchors GROUP BY ALL),
    windows AS (SELECT query_id, doc_id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS k, unnest(w) AS w FROM taken)"""

_SPACE = r"[\s\x{0B}\x{85}\p{Z}]"

# bytes of a character cut at either end fall out: continuation bytes in front, an unfinished sequence behind
_EXCERPTS = rf"""{_WINDOWS},
    bytes AS (SELECT query_id, doc_id, k, hex(encode(text)[w.s + 1:w.e]) AS h FROM windows JOIN documents USING (doc_id)),
    whole AS (
        SELECT query_id, doc_id, k, decode(unhex(regexp_replace(regexp_replace(h, '^(?:[89AB][0-9A-F])+', ''),
               '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){{0,2}})$', ''))) AS x FROM bytes),
    excerpts AS (SELECT query_id, doc_id, k, regexp_replace(regexp_replace(x, '^(?:{_SPACE}|\x{{FFFD}})+', ''), '(?:{_SPACE}|\x{{FFFD}})+$', '') AS excerpt FROM whole)"""

_PAGES = r"""
    raw AS (SELECT DISTINCT source_id || '#' || chunk_no AS source_id, text FROM chunks WHERE source_id IS NOT NULL AND chunk_no IS NOT NULL),
    split AS (SELECT source_id, string_split(text, chr(12)) AS p FROM raw WHERE text IS NOT NULL),
    pages AS (SELECT source_id, CAST(generate_subscripts(p, 1) AS INT) AS page_no, unnest(p) AS text FROM split)"""
_LINES = rf"""{_PAGES},
    cut AS (SELECT source_id, page_no, string_split(replace(regexp_replace(text, '\r?\n\z', ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM pages WHERE text <> ''),
    lines AS (
        SELECT *, lower(trim(regexp_replace(line, '{_SPACE}+', ' ', 'g'))) AS norm
        FROM (SELECT source_id, page_no, len(l) AS n, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM cut)),
    stats AS (
        SELECT source_id, norm, count(*) AS total, CAST(sum(CASE WHEN line_no < 10 OR line_no + 5 >= n THEN 1 ELSE 0 END) AS BIGINT) AS in_zone
        FROM lines WHERE norm <> '' GROUP BY ALL),
    boiler AS (SELECT source_id, norm FROM stats WHERE total >= 3 AND in_zone * 5 >= total * 4)"""
_CLEAN = rf"""{_LINES},
    kept AS (
        SELECT * FROM lines l WHERE norm = '' OR NOT (regexp_matches(norm, '^page [0-9]+( of [0-9]+)?$') OR contains(line, '.....')
            OR EXISTS (SELECT 1 FROM boiler b WHERE b.source_id = l.source_id AND b.norm = l.norm))),
    texts AS (SELECT source_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY ALL),
    clean AS (SELECT p.source_id, p.page_no, coalesce(t.text, '') AS text FROM pages p LEFT JOIN texts t ON p.source_id = t.source_id AND p.page_no = t.page_no)"""


# documents as pages of their source, with dots for the bars of tables
_SOURCE_PAGES = "pages AS (SELECT source AS source_id, CAST(doc_id AS INT) AS page_no, replace(text, ' | ', ' ..... ') AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"


def _over_sources(sql: str) -> str:
    return sql.replace(_PAGES, _SOURCE_PAGES)


_OCR = "'Part (' || source_id || '#' || chunk_no || ')' || chr(10) || chr(10) || text"
_EXTRACTED = _PAGES.replace("chunk_no AS source_id, text FROM", f"chunk_no AS source_id, CASE WHEN length(text) % 5 = 0 THEN {_OCR} ELSE text END AS text, length(text) % 5 = 0 AS ocr FROM")


def _pack(source: str) -> str:
    """Packing as a recursive walk over the parts of each source."""
    trim = lambda x: f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
    return rf"""
    trimmed AS (SELECT source_id, page_no, {trim('text')} AS text FROM {source}),
    whole AS (SELECT * FROM trimmed WHERE text <> ''),
    paras AS (SELECT source_id, page_no, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS l FROM whole WHERE strlen(text) > 16384),
    parts AS (
        SELECT source_id, page_no, 0 AS part_no, 0 AS parts, text FROM whole WHERE strlen(text) <= 16384
        UNION ALL SELECT source_id, page_no, generate_subscripts(l, 1) - 1, len(l), unnest(l) FROM paras),
    walk AS (SELECT *, strlen(text) AS b, row_number() OVER (PARTITION BY source_id ORDER BY page_no, part_no) AS r FROM parts),
    placed AS (
        SELECT source_id, r, page_no, part_no, text, 1 AS chunk_no, b AS size, parts > 0 AND part_no + 1 = parts AS closed FROM walk WHERE r = 1
        UNION ALL
        SELECT w.source_id, w.r, w.page_no, w.part_no, w.text,
               CASE WHEN p.closed OR (w.parts > 0 AND w.part_no = 0) OR p.size + 2 + w.b > 8192 THEN p.chunk_no + 1 ELSE p.chunk_no END,
               CASE WHEN p.closed OR (w.parts > 0 AND w.part_no = 0) OR p.size + 2 + w.b > 8192 THEN w.b ELSE p.size + 2 + w.b END,
               w.parts > 0 AND w.part_no + 1 = w.parts
        FROM placed p JOIN walk w ON w.source_id = p.source_id AND w.r = p.r + 1)
    SELECT source_id, chunk_no, min(page_no) AS first_page, max(page_no) AS last_page, string_agg(text, chr(10) || chr(10) ORDER BY r) AS text
    FROM placed GROUP BY ALL"""


def _packed(source: str) -> str:
    """The same as a table `packed`."""
    walk, _, last = _pack(source).rpartition("\n    SELECT source_id, chunk_no,")
    return f"{walk},\n    packed AS (SELECT source_id, chunk_no,{last})"


_META = "meta AS (SELECT DISTINCT * EXCLUDE (next_stem) FROM docs)"


def _field(name: str, block: str = "block") -> str:
    return f"""(CASE WHEN len(regexp_extract_all({block}, '(?m)^{name}: (.*)$', 1)) > 0 THEN trim(regexp_extract_all({block}, '(?m)^{name}: (.*)$', 1)[1]) END)"""


_IMAGES = """
    images AS (
        SELECT source AS source_id, CAST(doc_id % 50 AS INT) AS page, CAST(doc_id AS INT) AS idx, text FROM documents
        WHERE source IS NOT NULL AND text IS NOT NULL AND strlen(text) * 10 >= 10240),
    one AS (SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY source_id, text ORDER BY page, idx) = 1),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page, idx) AS n, row_number() OVER (PARTITION BY source_id, page ORDER BY idx) AS k FROM one),
    chosen AS (
        SELECT source_id, page, idx, n <= 500 AS kept,
               CASE WHEN n <= 500 THEN replace(lower(source_id), ' ', '-') || printf('-p%03d-%d.png', page, k) END AS name
        FROM numbered)"""

_INGESTED = f"""
        WITH RECURSIVE {_CLEAN.replace(_PAGES, _EXTRACTED)}, {_packed('clean')},
        part AS (SELECT p.*, r.ocr, count(*) OVER (PARTITION BY p.source_id) = 1 AS alone, 'Part (' || p.source_id || ')' AS stem, 'part-' || p.source_id AS slug FROM packed p JOIN raw r ON r.source_id = p.source_id),
        based AS (SELECT *, CASE WHEN alone THEN slug ELSE slug || printf('-p%03d-%03d', first_page, last_page) END AS base FROM part),
        nth AS (SELECT *, row_number() OVER (PARTITION BY base, source_id ORDER BY chunk_no) AS n FROM based),
        named AS (
            SELECT *, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS name, CASE WHEN alone THEN stem ELSE stem || ' (pages ' || first_page || '-' || last_page || ')' END AS title,
                   CASE WHEN NOT alone THEN slug END AS parent, CASE WHEN NOT alone THEN first_page || '-' || last_page END AS pages FROM nth)
        SELECT source_id, name, title, parent, pages,
               '---' || chr(10) || concat_ws(chr(10), 'type: technical-note', 'title: ' || title, 'description: Extracted from a source file.', 'resource: site/' || source_id || '.txt', 'parent: ' || parent, 'pages: ' || pages,
                   'tags: [extracted, ' || CASE WHEN ocr THEN 'ocr, ' ELSE '' END || 'technical-note]', 'timestamp: 2024-01-01T00:00:00Z') || chr(10) || '---' || chr(10) || chr(10) || text AS content
        FROM named"""

_HEADERS = f"""
        WITH files AS (SELECT DISTINCT path, content FROM documents_okf WHERE content IS NOT NULL),
        named AS (SELECT *, regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]*$', '\\1') AS stem,
                  CASE WHEN starts_with(content, '---' || chr(10)) AND contains(content[5:], chr(10) || '---') THEN split_part(content[5:], chr(10) || '---', 1) END AS block FROM files)
        SELECT path, stem, coalesce({_field('title')}, stem) AS title, coalesce({_field('type')}, 'uncategorised') AS doc_type, coalesce({_field('resource')}, '') AS resource,
               {_field('description')} AS description, {_field('parent')} AS parent, {_field('pages')} AS pages,
               coalesce(array_to_string(list_filter(list_transform(string_split(trim({_field('images')}, '[]'), ','), lambda x: trim(x)), lambda x: x <> ''), ', '), '') AS images,
               CAST(CASE WHEN contains(content, chr(10) || '---' || chr(10)) THEN strlen(split_part(content, chr(10) || '---' || chr(10), 1)) + 5 ELSE 0 END AS INT) AS body_start
        FROM named"""

# the bundle of documents_okf, indexed by body
_PARSED = f"""head AS ({_HEADERS}),
    parsed AS (
        SELECT h.stem || chr(1) || h.path AS doc_id, h.*, decode(encode(f.content)[h.body_start + 1:]) AS body FROM head h JOIN (SELECT DISTINCT path, content FROM documents_okf WHERE content IS NOT NULL) f ON f.path = h.path)"""
_BUNDLE = _POSTED.replace(_DOCS, _PARSED + "," + _tokens("SELECT doc_id, body AS text, body_start AS base FROM parsed", "doc_id")).replace("FROM documents d", "FROM parsed d")
_CHAINS = """started AS (SELECT *, TRY_CAST(trim(split_part(pages, '-', 1)) AS INT) AS s FROM parsed),
        chained AS (SELECT doc_id, stem, title, CASE WHEN parent IS NOT NULL AND s IS NOT NULL THEN lead(stem) OVER (PARTITION BY parent, s IS NULL ORDER BY s, doc_id) END AS next_stem FROM started)"""

SQL: dict[str, str] = {
    "p5_found": """
        SELECT lower(trim(term)) AS term FROM postings WHERE term IS NOT NULL
        GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM postings)""",
    "p5_term_totals": """
        SELECT lower(trim(term)) AS term, count(*) AS rows, count(DISTINCT doc_id) AS documents,
               CAST(coalesce(sum(len(positions)), 0) AS BIGINT) AS positions
        FROM postings WHERE term IS NOT NULL GROUP BY 1""",
    "tokenize_documents": f'WITH {_DOCS} SELECT doc_id, i, token, pos AS "offset" FROM tok',
    "tokenize_bodies": "WITH "
    + _tokens("SELECT DISTINCT path, body_start AS base, decode(encode(content)[coalesce(body_start, 0) + 1:]) AS text FROM documents_okf WHERE content IS NOT NULL", "path")
    + ' SELECT path, i, token, pos AS "offset" FROM tok',
    "postings_build": f"WITH {_POSTED} SELECT term, doc_id, freq, array_to_string(positions, ' ') AS positions FROM posted",
    "doc_lengths": f"WITH {_POSTED} SELECT doc_id, token_count FROM sized",
    "vocabulary_stats": f"WITH {_DOCS} SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT token) AS terms FROM tok",
    "term_match_exact": _match(["ok", "mm", "öl", "zz"]),
    "term_match_prefix": _match(["map", "sto", "nod", "für"]),
    "term_match_substring": _match(["node", "char", "prüf", "zone"]),
    "term_match_fuzzy": _match(["charfing", "robott", "größen", "emergancy", "sensr"]),
    **{
        name: _rank(q) + " SELECT query_id, rank, doc_id, coverage, freq, token_count, score FROM numbered"
        for name, q in {"search_single": {1: "battery"}, "search_partial": {1: _ALL[1], 3: _ALL[3]}, "search_duplicate_terms": {2: _ALL[2]}, "search_batch": _ALL}.items()
    },
    "search_slots": f"{_slots(_ALL)} SELECT query_id, qi, doc_id, freq, array_to_string(positions, ' ') AS positions FROM slots",
    "proximity_anchors": f"{_ANCHORS} SELECT query_id, doc_id, k, p, near FROM anchors",
    "excerpt_windows": f"{_WINDOWS} SELECT query_id, doc_id, k, w.s AS s, w.e AS e FROM windows",
    "excerpt_text": f"{_EXCERPTS} SELECT query_id, doc_id, k, excerpt FROM excerpts",
    "search_top": f"""{_EXCERPTS},
        {_HITS},
        shown AS (SELECT query_id, doc_id, string_agg(excerpt, ' | ' ORDER BY k) AS excerpts FROM excerpts GROUP BY ALL)
        SELECT query_id, rank, doc_id, coverage, freq, token_count, score, excerpts FROM numbered JOIN shown USING (query_id, doc_id) WHERE rank <= 20""",
    "stopword_filter": f"""
        WITH {_META} SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({_STOP}, w)), ' ') AS terms
        FROM meta WHERE title IS NOT NULL""",
    "line_stats": f"WITH {_LINES} SELECT source_id, norm, total, in_zone FROM stats",
    "boilerplate_lines": f"WITH {_LINES} SELECT source_id, norm FROM boiler",
    "clean_pages": f"WITH {_CLEAN} SELECT source_id, page_no, text FROM clean",
    "chunk_pages": f"WITH RECURSIVE {_PAGES}, {_pack('pages')}",
    "clean_and_chunk": f"WITH RECURSIVE {_CLEAN}, {_pack('clean')}",
    "boilerplate_of_sources": f"WITH {_over_sources(_LINES)} SELECT source_id, norm FROM boiler",
    "clean_pages_of_sources": f"WITH {_over_sources(_CLEAN)} SELECT source_id, page_no, text FROM clean",
    "contents_rows": f"WITH {_over_sources(_LINES)} SELECT source_id, count(*) AS rows FROM lines WHERE contains(line, '.....') GROUP BY 1",
    "page_markers": """
        SELECT doc_id, doc_id % 3 <> 1 AS marker FROM documents WHERE doc_id % 3 <> 0 OR n_chars IS NOT NULL""",
    "ingest_documents": _INGESTED,
    "ingest_failures": f"""
        WITH RECURSIVE {_CLEAN.replace(_PAGES, _EXTRACTED)}, {_packed('clean')}
        SELECT source_id, CASE WHEN coalesce(ocr, false) THEN 'no text, even by OCR' ELSE 'no text' END AS error FROM raw WHERE source_id NOT IN (SELECT source_id FROM packed)""",
    "ingest_summary": f"""
        WITH RECURSIVE {_CLEAN.replace(_PAGES, _EXTRACTED)}, {_packed('clean')}
        SELECT CASE WHEN source_id IN (SELECT source_id FROM packed) THEN 'ok' ELSE 'failed' END AS status, count(*) AS sources FROM raw GROUP BY 1""",
    "bundle_files": f"""
        WITH made AS ({_INGESTED})
        SELECT replace(name, '#', '-') AS stem, title, 'technical-note' AS doc_type, 'site/' || source_id || '.txt' AS resource, parent, pages, CAST(strlen(split_part(content, chr(10) || '---' || chr(10), 1)) + 5 AS INT) AS body_start FROM made""",
    "service_search": f"""{_slots({1: _ALL[1]}).replace(_POSTED, _BUNDLE)}, {_HITS},
        {_CHAINS}
        SELECT rank, stem, title, coverage, freq, token_count, score, next_stem AS continues FROM numbered JOIN chained USING (doc_id) WHERE rank <= 20""",
    "service_documents": f"""WITH {_BUNDLE},
        {_CHAINS}
        SELECT stem, next_stem, (SELECT count(*) FROM parsed) AS documents, (SELECT count(DISTINCT term) FROM posted) AS terms FROM chained""",
    "chain_next": f"""
        WITH {_META}, started AS (SELECT *, TRY_CAST(trim(split_part(pages, '-', 1)) AS INT) AS s FROM meta)
        SELECT doc_id, stem, CASE WHEN parent IS NOT NULL AND s IS NOT NULL THEN
               lead(stem) OVER (PARTITION BY parent, s IS NULL ORDER BY s, doc_id) END AS next_stem FROM started""",
    "list_docs": f"WITH {_META} SELECT doc_type, array_to_string(list(title ORDER BY title) FILTER (title IS NOT NULL), chr(10)) AS titles FROM meta GROUP BY 1",
    "resources": f"""
        WITH {_META} SELECT 'corpus://docs/' || stem AS uri, stem AS name, title, 'text/markdown' AS mime_type, description FROM meta
        UNION ALL SELECT 'corpus://images/' || i, i, 'Diagram from ' || title, 'image/png', NULL FROM (SELECT title, unnest(images) AS i FROM meta)""",
    "header_parse": _HEADERS,
    "header_roundtrip": f"""
        WITH {_META}, r AS (SELECT *, coalesce(array_to_string(images, ', '), '') AS im FROM meta WHERE title IS NOT NULL)
        SELECT path, trim(title) AS title, coalesce(trim(doc_type), 'uncategorised') AS doc_type, coalesce(trim(resource), '') AS resource, trim(description) AS description, trim(parent) AS parent, trim(pages) AS pages, im AS images,
               CAST(strlen('---' || chr(10) || concat_ws(chr(10), 'type: ' || doc_type, 'title: ' || title, 'description: ' || description, 'resource: ' || resource, 'parent: ' || parent,
                    'pages: ' || pages, CASE WHEN im <> '' THEN 'images: [' || im || ']' END) || chr(10) || '---' || chr(10)) AS INT) AS body_start
        FROM r""",
    "slugify": f"WITH {_META} SELECT doc_id, translate(replace(lower(title), ' ', '-'), '.()', '') AS slug FROM meta WHERE title IS NOT NULL",
    "route_sources": """
        SELECT source_id, path, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('docx', 'doc', 'pptx', 'ppt') THEN 'office' WHEN e = 'txt' THEN 'text' END AS routed
        FROM (SELECT *, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) AS e FROM source_files)""",
    "batch_summary": """
        SELECT CASE WHEN lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) IN ('pdf', 'docx', 'doc', 'pptx', 'ppt', 'txt') THEN 'ok' ELSE 'skipped' END AS status, count(*) AS sources
        FROM (SELECT DISTINCT source_id, path FROM source_files) GROUP BY 1""",
    "name_chunks": """
        WITH c AS (SELECT DISTINCT source_id, chunk_no, coalesce(first_page, 0) AS f, coalesce(last_page, 0) AS l FROM chunks WHERE source_id IS NOT NULL),
        n AS (SELECT *, count(*) OVER (PARTITION BY source_id) = 1 AS alone, 'source-' || source_id || '-v10' AS slug, 'Source (' || source_id || ') v1.0' AS stem FROM c),
        b AS (SELECT *, CASE WHEN alone THEN slug ELSE slug || printf('-p%03d-%03d', f, l) END AS base FROM n),
        k AS (SELECT *, row_number() OVER (PARTITION BY base, source_id ORDER BY chunk_no) AS n FROM b)
        SELECT source_id, chunk_no, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS name,
               CASE WHEN alone THEN stem ELSE stem || ' (pages ' || f || '-' || l || ')' END AS title,
               CASE WHEN NOT alone THEN slug END AS parent, CASE WHEN NOT alone THEN f || '-' || l END AS pages FROM k""",
    "name_collisions": """
        WITH s AS (SELECT DISTINCT path, regexp_replace(translate(replace(lower(regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]*$', '\\1')), ' ', '-'), '.()', ''), '[0-9]+', '', 'g') AS name FROM source_files WHERE path IS NOT NULL)
        SELECT name, count(DISTINCT path) AS sources FROM s GROUP BY 1 HAVING count(DISTINCT path) > 1""",
    "asset_select": f"WITH {_IMAGES} SELECT source_id, page, idx, name, kept FROM chosen",
    "asset_range_join": f"""
        WITH {_IMAGES}, c AS (SELECT source AS source_id, CAST(doc_id AS INT) AS chunk_no, CAST(doc_id % 40 AS INT) AS first_page, CAST(doc_id % 40 + 3 AS INT) AS last_page,
                              count(*) OVER (PARTITION BY source) = 1 AS alone FROM documents WHERE source IS NOT NULL)
        SELECT c.source_id, chunk_no, first_page, last_page,
               (SELECT '[' || string_agg(name, ', ' ORDER BY page, idx) || ']' FROM chosen i WHERE i.source_id = c.source_id AND name IS NOT NULL AND (alone OR page BETWEEN first_page AND last_page)) AS images
        FROM c""",
}
