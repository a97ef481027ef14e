"""DuckDB's SQL for the operators that SQL can express."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]+"

_WORDS = f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{BLANK}'), lambda x: x <> '') AS ws FROM d)"""

_CLOSURE = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(n, m) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON r.m = e.a),
component AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n)"""

QUALITY = rf"""WITH {_WORDS},
base AS (SELECT doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{BLANK}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(string_split(t, chr(10))) AS n_lines FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS key
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(5) AS r(o) GROUP BY doc_id),
often AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY doc_id, word HAVING count(*) >= 5),
spaced AS (SELECT doc_id, chr(10) || regexp_replace(t, '[\x09-\x0D]', chr(10), 'g') || chr(10) AS s FROM d),
stutter AS (SELECT DISTINCT doc_id FROM (SELECT o.doc_id, s, word || repeat(' ' || word, 4) AS x FROM often o JOIN spaced USING (doc_id))
    WHERE contains(s, ' ' || x || ' ') OR contains(s, chr(10) || x || ' ') OR contains(s, ' ' || x || chr(10)) OR contains(s, chr(10) || x || chr(10))),
counted AS (SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, n_lines, s.doc_id IS NOT NULL AS stutters
    FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN stutter s USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words
         OR 5 * n_dup_lines > greatest(3, n_lines) * 2 OR stutters) AS kept FROM judged"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_CLOSURE},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN component ON component.n = vec_id LEFT JOIN degree ON degree.a = vec_id"""

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{BLANK}'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS x
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
{_CLOSURE}
SELECT documents.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, documents.doc_id) AS component_id,
    documents.doc_id = coalesce(component_id, documents.doc_id) AS kept
FROM documents LEFT JOIN size ON size.doc_id = documents.doc_id LEFT JOIN component ON component.n = documents.doc_id"""

SUBSTRING = f"""WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS key
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS low FROM win) WHERE low < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
lost AS (SELECT word.doc_id, word, i, max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM word LEFT JOIN hit USING (doc_id, i)),
left_ AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM lost GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN left_ USING (doc_id)"""
