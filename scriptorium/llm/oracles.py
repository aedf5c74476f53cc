"""SQL for DuckDB that gives the rows of those queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from scriptorium.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' .' || len(w)] ELSE [] END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, len(s) AS n, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
parts AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.rep AS u, b.rep AS v FROM parts a JOIN parts b ON a.g = b.g AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT r.node, e.v FROM reach r JOIN both_ways e ON e.u = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND c.s = list_sort(d.s) LEFT JOIN roots r ON r.node = c.rep"""

TOP_K = """
WITH vectors AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


LICENSES = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
phrases AS (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {_values(list(licenses.PHRASES.items()))}) AS t(phrase, label)),
places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS place FROM words, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY doc_id),
templates AS (SELECT label, list_distinct(string_split(words, ' ')) AS t FROM (VALUES {_values(licenses.TEMPLATES)}) AS t(label, words)),
blocks AS (SELECT doc_id, regexp_extract_all(unnest(string_split({_LOWER}, chr(10))), '{_ALNUM}') AS b FROM documents),
contained AS (SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS share FROM blocks, templates WHERE len(list_intersect(t, b)) >= ceil({licenses.CONTAINMENT} * len(t) - 1e-9)),
found AS (SELECT doc_id, label, max(share) AS share FROM (SELECT doc_id, label, share FROM contained UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id, label),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id),
base_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN base_labels USING (doc_id) LEFT JOIN labels USING (doc_id)"""

LINE_DEDUP = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
sets AS (SELECT doc_id, k, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACED}'))) AS s FROM lines),
classes AS (SELECT s, len(s) AS n, min(struct_pack(d := doc_id, k := k)) AS at FROM sets WHERE len(s) > 0 GROUP BY s),
later AS (SELECT DISTINCT s FROM (SELECT y.s, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS shared FROM classes x JOIN classes y ON x.at < y.at AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n)
  WHERE 9 * shared >= 4 * total),
marked AS (SELECT l.doc_id, l.k, l.line, len(l.s) > 0 AND (g.s IS NOT NULL OR struct_pack(d := l.doc_id, k := l.k) <> c.at) AS gone
  FROM sets l LEFT JOIN classes c ON c.s = l.s LEFT JOIN later g ON g.s = l.s)
SELECT doc_id, count(*) AS n_lines, coalesce(list(CAST(k AS INTEGER) ORDER BY k) FILTER (gone), []) AS removed_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id"""

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM pieces, (VALUES (1), (2), (3)) AS t(k)),
counts AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 10),
cuts AS (SELECT c.lang, c.k, c.p, c.f AS a, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, x.k AS first_words
  FROM counts c JOIN counts x ON x.lang = c.lang AND x.k < c.k AND x.p = c.p[1:x.k] JOIN counts y ON y.lang = c.lang AND y.k = c.k - x.k AND y.p = c.p[x.k + 1:c.k]),
scored AS (SELECT lang, k, p, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, first_words) AS o FROM cuts) WHERE o = 1),
longest AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, p[1:2] AS p, f FROM counts WHERE k = 3 UNION ALL SELECT lang, p[2:3], f FROM counts WHERE k = 3) GROUP BY lang, p),
kept AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score FROM scored s LEFT JOIN longest g ON g.lang = s.lang AND g.p = s.p WHERE g.f IS NULL OR 100 * g.f < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

_HEX5 = "CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)"
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
WARC = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM hashed)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: {"|| ".join(f"substr({_BASE32}, CAST(({_HEX5} >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
stats AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM words),
items AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark) GROUP BY item_id, t),
tfs AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM words) WHERE t IN (SELECT t FROM items) GROUP BY doc_id, n, t),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM dfs, stats),
scored AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (t) JOIN tfs USING (t), stats GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
