"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import AdmissionConfig, ChunkConfig, ImportConfig
from scriptorium.functions import text as T
from scriptorium.functions import storage
from scriptorium.functions.cuts import cut, keep, shared_dir
from scriptorium.operators import admission, chunking, evaluate, filters, importer, ingest, planner, store
from scriptorium.operators import headings as H
from scriptorium.plans import corpora as C
from scriptorium.plans import samples
from scriptorium.sources import files as source

QUERIES: dict = {}
ORACLES: dict = {}
#: Lines of a window of fixed_lines and of a block under a heading.
WINDOW, BLOCK = 5, 12


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


def _sql_windows(source: str, k: int) -> str:
    """Windows of the files of a table (path, text), numbered from 1 with the blank ones left out."""
    return f"""lined AS (SELECT path, {C.sql_lines("text")} AS lines FROM {source}),
starts AS (SELECT path, lines, unnest(range(1, len(lines) + 1, {k})) AS s FROM lined),
windows AS (SELECT path, s AS start_line, least(s + {k - 1}, len(lines)) AS end_line, array_to_string(lines[s:least(s + {k - 1}, len(lines))], chr(10)) AS content FROM starts),
chunks AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_line) AS chunk_no, start_line, end_line, content, '' AS heading_path FROM windows WHERE NOT ({C.sql_blank("content")}))"""


PAGE = " OR ".join(f"regexp_matches(x, '{p}')" for p in filters.PAGE_LINES)
SQL_FILTERED = rf"""ruled AS (SELECT *, CASE WHEN NOT regexp_matches(content, '[\p{{L}}\p{{N}}]') THEN 'no_text'
    WHEN len(list_filter({C.sql_lines("content")}, lambda x: {C.sql_strip("x")} <> '')) > 0
      AND len(list_filter(list_transform({C.sql_lines("content")}, lambda y: {C.sql_strip("y")}), lambda x: x <> '' AND NOT ({PAGE}))) = 0 THEN 'page_furniture'
    WHEN length({C.sql_strip("content")}) < 10 THEN 'too_short' END AS rule,
    replace(replace(lower(regexp_replace(content, '[{T.SPACE}]+', '', 'g')), 'ß', 'ss'), 'ſ', 's') AS key FROM chunks),
filtered AS (SELECT *, CASE WHEN rule IS NULL AND row_number() OVER (PARTITION BY path, key, rule IS NULL ORDER BY chunk_no) > 1 THEN 'duplicate' ELSE rule END AS drop_rule FROM ruled)"""

SQL_HEADS = rf"""lines AS (SELECT path, unnest({C.sql_lines("text")}) AS line, generate_subscripts({C.sql_lines("text")}, 1) AS ln FROM conv_md),
n_lines AS (SELECT path, max(ln) AS n FROM lines GROUP BY path),
heads AS (SELECT * FROM (SELECT path, ln, length(regexp_extract(line, '^ *(#{{1,6}})[ \t]', 1)) AS level, {C.sql_strip(r"regexp_replace(line, '^ *#{1,6}[ \t]', '')")} AS title
  FROM lines WHERE regexp_matches(line, '^ *#{{1,6}}[ \t]')) WHERE title <> ''),
paths AS (SELECT h.path, h.ln, h.level, h.title, string_agg(a.title, ' > ' ORDER BY a.ln) AS heading_path FROM heads h JOIN heads a ON a.path = h.path AND a.ln <= h.ln AND (a.ln = h.ln OR a.level < h.level)
  WHERE NOT EXISTS (SELECT 1 FROM heads b WHERE b.path = h.path AND b.ln > a.ln AND b.ln <= h.ln AND b.level <= a.level) GROUP BY ALL),
blocks AS (SELECT path, ln AS start_line, coalesce(lead(ln) OVER (PARTITION BY path ORDER BY ln) - 1, n) AS end_line, level, title, heading_path FROM paths JOIN n_lines USING (path)
  UNION ALL SELECT path, 1, min(ln) - 1, 0, '', '' FROM heads GROUP BY path HAVING min(ln) > 1)"""
def _sql_split(most: int) -> str:
    """Pieces of at most so many lines of the blocks."""
    return f"""walk AS (
  SELECT path, start_line AS s, end_line AS e, 0 AS i, 0 AS pos, 0 AS filled, FALSE AS cut FROM blocks WHERE end_line - start_line + 1 > {most}
  UNION ALL
  SELECT path, s, e, i + 1, CASE WHEN c THEN i + 1 ELSE pos END, CASE WHEN c THEN 0 ELSE f END, c FROM (
    SELECT *, (e - s + 1 - pos > {most}) AND (i - pos + 1 >= {most} OR (blank AND i - pos + 1 >= {max(2, most // 2)} AND f >= 2)) AS c FROM (
      SELECT w.path, w.s, w.e, w.i, w.pos, {C.sql_blank("l.line")} AS blank, w.filled + CASE WHEN {C.sql_blank("l.line")} THEN 0 ELSE 1 END AS f
      FROM walk w JOIN lines l ON l.path = w.path AND l.ln = w.s + w.i WHERE w.i <= w.e - w.s))),
ends AS (SELECT path, s, s + i - 1 AS e FROM walk WHERE cut UNION SELECT path, start_line, end_line FROM blocks),
pieces AS (SELECT path, coalesce(lag(e) OVER (PARTITION BY path, s ORDER BY e) + 1, s) AS start_line, e AS end_line, s FROM ends)"""


SQL_SPLIT = _sql_split(BLOCK)
SQL_PIECES = """SELECT p.path, p.start_line, p.end_line, b.heading_path,
    (SELECT string_agg(l.line, chr(10) ORDER BY l.ln) FROM lines l WHERE l.path = p.path AND l.ln BETWEEN p.start_line AND p.end_line) AS content
  FROM pieces p JOIN blocks b ON b.path = p.path AND b.start_line = p.s"""


@query(f"WITH {C.SQL_FILES} SELECT path, substr(sha256(text), 1, 16) AS content_id, len({C.sql_lines('text')}) AS line_count FROM doc_files")
def normalize_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.doc_texts(spark, sf_dir)
    return docs.select("path", T.fingerprint(F.col("text")).alias("content_id"), F.size(T.split_lines(F.col("text"))).cast("long").alias("line_count"))


@query(f"""WITH {C.SQL_FILES}, {C.SQL_JUDGED} SELECT path, CASE WHEN bad IS NULL AND path = first_path THEN 'admitted' ELSE 'rejected' END AS status,
  CASE WHEN bad = 'unreadable' THEN 'loading' WHEN bad IS NOT NULL OR path <> first_path THEN 'admission' END AS stage,
  coalesce(bad, CASE WHEN path <> first_path THEN 'duplicate' END) AS rule,
  CASE WHEN bad = 'secret_content' THEN kind WHEN bad IS NULL AND path <> first_path THEN first_path END AS detail FROM ingested""")
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(C.doc_files(spark, sf_dir)).select("path", "status", "stage", "rule", "detail")


@query(f"""WITH {C.SQL_FILES}, {C.SQL_JUDGED} SELECT count(*) AS scanned, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (bad IS NULL AND path = first_path) AS admitted,
  count(*) FILTER (bad <> 'unreadable' OR (bad IS NULL AND path <> first_path)) AS rejected_admission, count(*) FILTER (bad = 'unreadable') AS rejected_loading,
  (SELECT CAST(coalesce(sum(line_count), 0) AS BIGINT) FROM docs) AS total_lines FROM ingested""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.report(ingest.ingest(C.doc_files(spark, sf_dir)))


@query(rf"""SELECT path, CASE WHEN suffix IN ('.env', '.key', '.pem', '.p12', '.pfx', '.crt', '.der', '.kdbx') THEN 'secret_suffix'
  WHEN regexp_matches(name, '^\.env(\..+)?$') OR regexp_matches(name, '(?i)^credential') OR regexp_matches(name, '(?i)^secret') OR regexp_matches(name, '(?i)_rsa$') THEN 'secret_name'
  WHEN suffix NOT IN ('.md', '.markdown') THEN 'skipped' WHEN size = 0 THEN 'empty_file' WHEN size > 2097152 THEN 'too_large' ELSE 'admitted' END AS outcome
  FROM (SELECT *, lower(regexp_extract(name, '(?s)^.+(\.[^.]+)$', 1)) AS suffix FROM (SELECT *, string_split(path, '/')[-1] AS name FROM {_values(samples.FILES, "path, size")}))""")
def admission_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(samples.FILES, "path string, size long")
    config = AdmissionConfig()
    skipped = F.when(~admission.suffix(F.col("path")).isin(*config.suffixes), "skipped")
    return files.select("path", F.coalesce(admission.secret_name(F.col("path")), skipped, admission.size_rule(F.col("size"), config), F.lit("admitted")).alias("outcome"))


_CHUNK = ["path", "chunk_no", "start_line", "end_line", "content", "heading_path"]


@query(f"WITH {C.SQL_FILES}, {_sql_windows('doc_files', WINDOW)} SELECT path, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, content, heading_path FROM chunks")
def fixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_lines(C.doc_texts(spark, sf_dir), WINDOW).select(_CHUNK)


@query(f"WITH {C.SQL_CONV}, {SQL_HEADS} SELECT path, CAST(ln AS INTEGER) AS line, CAST(level AS INTEGER) AS level, title FROM heads")
def find_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.conv_md(spark, sf_dir)
    lined = docs.select("path", T.split_lines(F.col("text")).alias("lines"))
    return lined.select("path", F.inline_outer(H.find_headings(F.col("lines")))).filter("line is not null")


@query(f"WITH {C.SQL_CONV}, {SQL_HEADS} SELECT path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(level AS INTEGER) AS level, title, heading_path FROM blocks")
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.heading_blocks(C.conv_md(spark, sf_dir)).select("path", "start_line", "end_line", "level", "title", "heading_path")


@query(f"""WITH RECURSIVE {C.SQL_CONV}, {SQL_HEADS}, {SQL_SPLIT} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line) AS INTEGER) AS chunk_no, CAST(start_line AS INTEGER) AS start_line,
  CAST(end_line AS INTEGER) AS end_line, content, heading_path FROM (SELECT p.path, p.start_line, p.end_line, b.heading_path,
    (SELECT string_agg(l.line, chr(10) ORDER BY l.ln) FROM lines l WHERE l.path = p.path AND l.ln BETWEEN p.start_line AND p.end_line) AS content
  FROM pieces p JOIN blocks b ON b.path = p.path AND b.start_line = p.s) WHERE NOT ({C.sql_blank("content")})""")
def markdown_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.markdown_heading(C.conv_md(spark, sf_dir), BLOCK).select(_CHUNK)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_all(C.doc_texts(spark, sf_dir).unionByName(C.conv_md(spark, sf_dir)), ChunkConfig(max_lines=2))


_BOTH = f"{C.SQL_FILES}, {C.SQL_CONV}, both_files AS (SELECT path, text FROM doc_files UNION ALL SELECT path, text FROM conv_md), {_sql_windows('both_files', 2)}, {SQL_FILTERED}"


@query(f"WITH {_BOTH} SELECT path, CAST(chunk_no AS INTEGER) AS chunk_no, drop_rule FROM filtered")
def filter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("path", "chunk_no", "drop_rule")


@query(f"WITH {_BOTH} SELECT coalesce(drop_rule, 'kept') AS drop_rule, count(*) AS n FROM filtered GROUP BY 1")
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.dropped_by_rule(_judged(spark, sf_dir))


@query(f"""WITH RECURSIVE {C.SQL_CONV}, {SQL_HEADS}, {SQL_SPLIT} SELECT path || ':' || start_line || '-' || end_line AS citation, CASE WHEN heading_path = '' THEN content ELSE '【' || heading_path || '】' || chr(10) || chr(10) || content END AS prompt
  FROM (SELECT p.path, p.start_line, p.end_line, b.heading_path, (SELECT string_agg(l.line, chr(10) ORDER BY l.ln) FROM lines l WHERE l.path = p.path AND l.ln BETWEEN p.start_line AND p.end_line) AS content
  FROM pieces p JOIN blocks b ON b.path = p.path AND b.start_line = p.s) WHERE NOT ({C.sql_blank("content")})""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.markdown_heading(C.conv_md(spark, sf_dir), BLOCK)
    return chunks.select(chunking.citation(chunks).alias("citation"), chunking.prompt_text(chunks).alias("prompt"))


SQL_PLAN = f"""live AS (SELECT *, status = 'processing' AND epoch(TIMESTAMP '{C.NOW}') - epoch(CAST(started_at AS TIMESTAMP)) <= 1800 AS held FROM ledger),
matched AS (SELECT s.path, s.doc_id, i.path AS i_path, i.doc_id AS i_id, i.status, i.chunk_count AS i_n, i.started_at AS i_at, coalesce(i.held, FALSE) AS i_held,
    p.path AS p_path, p.doc_id AS p_id, p.chunk_count AS p_n, p.started_at AS p_at, coalesce(p.held, FALSE) AS p_held, p.doc_id IN (SELECT doc_id FROM docs) AS stays
  FROM docs s LEFT JOIN live i ON i.doc_id = s.doc_id LEFT JOIN live p ON p.path = s.path),
acted AS (SELECT *, CASE WHEN i_held OR p_held THEN 'locked' WHEN status = 'ready' AND i_path = path THEN 'unchanged' WHEN status = 'ready' THEN 'renamed' WHEN i_id IS NOT NULL THEN 'resumed'
    WHEN p_id IS NOT NULL AND NOT stays THEN 'updated' ELSE 'added' END AS action FROM matched),
picked AS (SELECT *, action = 'updated' OR (action = 'locked' AND NOT i_held) AS by_path FROM acted),
scan_plan AS (SELECT action, path, doc_id, CASE WHEN by_path THEN p_path WHEN action <> 'added' THEN i_path END AS previous_path, CASE WHEN by_path THEN p_id WHEN action <> 'added' THEN i_id END AS previous_doc_id,
    coalesce(CASE WHEN by_path THEN p_n WHEN action <> 'added' THEN i_n END, 0) AS chunk_count,
    CASE WHEN action = 'locked' THEN 'in work since ' || CASE WHEN by_path THEN p_at ELSE i_at END WHEN action = 'resumed' AND status = 'failed' THEN 'failed before' WHEN action = 'resumed' THEN 'not finished since ' || i_at END AS reason FROM picked),
plan AS (SELECT * FROM scan_plan UNION ALL SELECT 'removed', path, doc_id, path, doc_id, chunk_count, NULL FROM live
  WHERE NOT held AND doc_id NOT IN (SELECT doc_id FROM docs) AND doc_id NOT IN (SELECT previous_doc_id FROM scan_plan WHERE action = 'updated'))"""
_PLAN = f"{C.SQL_FILES}, {C.SQL_JUDGED}, {C.SQL_LEDGER}, {SQL_PLAN}"


def _plan(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = docs or C.scanned(spark, sf_dir)
    return planner.classify(docs, C.prev_ledger(docs), C.NOW)


@query(f"WITH {_PLAN} SELECT action, path, doc_id, previous_path, previous_doc_id, CAST(chunk_count AS INTEGER) AS chunk_count, reason FROM plan")
def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"""WITH {_PLAN} SELECT action, count(*) AS n, action IN ('added', 'updated', 'resumed') AS needs_work FROM plan GROUP BY action""")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.action_counts(_plan(spark, sf_dir)).withColumn("needs_work", F.col("action").isin(*planner.WORK))


@query(f"""WITH {_PLAN} SELECT (SELECT count(*) FROM plan WHERE action = 'removed') AS removals, (SELECT count(*) FROM ledger) AS known""")
def removal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.scanned(spark, sf_dir)
    ledger = C.prev_ledger(docs)
    gone = _plan(spark, sf_dir, docs).select((F.col("action") == "removed").alias("gone"), F.lit(False).alias("known"))
    both = gone.unionByName(ledger.select(F.lit(False).alias("gone"), F.lit(True).alias("known")))
    return both.agg(F.count_if("gone").alias("removals"), F.count_if("known").alias("known"))


@query(f"WITH {_PLAN}, {_sql_windows('docs', WINDOW)} SELECT c.path AS path, p.previous_path AS previous_path, c.path || ':' || start_line || '-' || end_line AS citation FROM chunks c JOIN plan p ON p.path = c.path AND p.action = 'renamed'")
def renamed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of renamed documents are cited under their new path."""
    docs = C.scanned(spark, sf_dir)
    moved = _plan(spark, sf_dir, docs).filter("action = 'renamed'").select("path", "previous_path")
    chunks = chunking.fixed_lines(docs.select("path", "text").join(moved, "path"), WINDOW)
    return chunks.select("path", "previous_path", chunking.citation(chunks).alias("citation"))


@query(f"WITH {_PLAN} SELECT doc_id FROM ledger WHERE status = 'ready' AND doc_id NOT IN (SELECT doc_id FROM store_docs)")
def reconcile_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = C.prev_ledger(C.scanned(spark, sf_dir))
    return store.reconcile(ledger, C.store_docs(ledger))[1]


@query(f"WITH {_PLAN} SELECT doc_id, CAST(n_chunks AS INTEGER) AS n_chunks FROM store_docs WHERE doc_id NOT IN (SELECT doc_id FROM ledger)")
def store_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = C.prev_ledger(C.scanned(spark, sf_dir))
    return store.orphans(C.store_docs(ledger), ledger)


_CASES = f"cases AS (SELECT * FROM {_values(samples.CASES, 'id, question, path, source_text, expect_start_line, expect_end_line, family, failure_mode')}), sources AS (SELECT DISTINCT path, {C._sql_norm('source_text')} || chr(10) AS text FROM cases)"
_HITS = f"""{_CASES}, {_sql_windows("sources", 6)}, {SQL_FILTERED}, kept AS (SELECT * FROM filtered WHERE drop_rule IS NULL),
outcomes AS (SELECT id, family, c.path AS path, (SELECT k.path || ':' || k.start_line || '-' || k.end_line FROM kept k WHERE k.path = c.path AND k.start_line <= c.expect_start_line AND k.end_line >= c.expect_end_line ORDER BY k.chunk_no LIMIT 1) AS matched_citation FROM cases c)"""


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(samples.CASES, evaluate.CASE)


@query(f"WITH {_HITS} SELECT id, family, path, matched_citation IS NOT NULL AS hit, matched_citation FROM outcomes")
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_cases(spark), ChunkConfig("fixed_lines", 6))


@query(f"""WITH {_HITS} SELECT 'fixed_lines' AS strategy, CAST(6 AS INTEGER) AS max_lines, coalesce(family, 'all') AS family, CAST(sum(CASE WHEN matched_citation IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS hits, count(*) AS total
  FROM outcomes GROUP BY ROLLUP (family)""")
def eval_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_family(_cases(spark), ChunkConfig("fixed_lines", 6))


#: Top-level statements of the sample file of Python, as its text shows them: (path, first line, last line).
STATEMENTS = [("service.py", 1, 1), ("service.py", 3, 3), ("service.py", 6, 11), ("service.py", 14, 20), ("service.py", 23, 25)]


def _sql_chunks(strategy: str, k: int) -> str:
    """Table expressions up to ``chunks``: the sample files (``sources``) by a strategy."""
    if strategy == "fixed_lines":
        return _sql_windows("sources", k)
    own = "'%.py'" if strategy == "code_ast" else "'%.md'"
    windows = f"others AS (SELECT * FROM sources WHERE path NOT LIKE {own}), " + _sql_windows("others", k).replace("chunks AS (", "windowed AS (")
    if strategy == "code_ast":
        spans = f"""SELECT v.path, v.start_line, v.end_line, array_to_string({C.sql_lines("text")}[v.start_line:v.end_line], chr(10)) AS content, '' AS heading_path
  FROM (SELECT * FROM {_values(STATEMENTS, "path, start_line, end_line")}) v JOIN sources USING (path)"""
    else:
        windows = f"conv_md AS (SELECT path, text FROM sources WHERE path LIKE {own}), {SQL_HEADS}, {_sql_split(k)}, {windows}"
        spans = SQL_PIECES
    return f"""{windows}, spans AS ({spans}),
chunks AS (SELECT * FROM windowed UNION ALL SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_line) AS chunk_no, start_line, end_line, content, heading_path FROM spans WHERE NOT ({C.sql_blank("content")}))"""


def _sql_hits(strategy: str, k: int) -> str:
    """``by_family`` of one setting."""
    return f"""SELECT '{strategy}' AS strategy, {k} AS max_lines, coalesce(family, 'all') AS family, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS total FROM (
  WITH RECURSIVE {_CASES}, {_sql_chunks(strategy, k)}, {SQL_FILTERED}
  SELECT c.family, EXISTS (SELECT 1 FROM filtered k WHERE k.drop_rule IS NULL AND k.path = c.path AND k.start_line <= c.expect_start_line AND k.end_line >= c.expect_end_line) AS hit FROM cases c) GROUP BY ROLLUP (family)"""


SETTINGS = [(s, k) for s in ("fixed_lines", "code_ast", "markdown_heading") for k in (3, 6)]


@query(f"SELECT strategy, CAST(max_lines AS INTEGER) AS max_lines, family, hits, total FROM ({' UNION ALL '.join(_sql_hits(*x) for x in SETTINGS)})")
def eval_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(_cases(spark), [ChunkConfig(*x) for x in SETTINGS])


@query(f"""WITH {_CASES}, {_sql_chunks("code_ast", 3)} SELECT path, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, content, heading_path FROM chunks""")
def code_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _cases(spark).select("path", F.col("source_text").alias("text")).distinct()
    return chunking.code_ast(files, 3).select(_CHUNK)


_IMPORT = f"""WITH {C.SQL_FILES}, {C.SQL_JUDGED}, {C.SQL_LEDGER}, known AS (SELECT * FROM ledger WHERE NOT (status = 'ready' AND doc_id NOT IN (SELECT doc_id FROM store_docs))),
{SQL_PLAN.replace("FROM ledger", "FROM known")}, {_sql_windows("docs", WINDOW)}, {SQL_FILTERED},
counted AS (SELECT path, count(*) AS n FROM filtered WHERE drop_rule IS NULL GROUP BY path),
worked AS (SELECT p.doc_id, p.path, coalesce(n, 0) AS n FROM plan p LEFT JOIN counted c USING (path) WHERE action IN ('added', 'updated', 'resumed')),
gone AS (SELECT doc_id FROM plan WHERE action = 'removed' UNION SELECT previous_doc_id FROM plan WHERE action = 'updated'),
kept AS (SELECT k.doc_id, coalesce(r.path, k.path) AS path, k.status, k.chunk_count FROM known k LEFT JOIN plan r ON r.doc_id = k.doc_id AND r.action = 'renamed'
  WHERE k.doc_id NOT IN (SELECT doc_id FROM worked) AND k.doc_id NOT IN (SELECT doc_id FROM gone)),
final AS (SELECT * FROM kept UNION ALL SELECT doc_id, path, 'ready', n FROM worked)"""


@query(f"""{_IMPORT} SELECT f.doc_id, f.path, status, CAST(chunk_count AS INTEGER) AS chunk_count, CAST(coalesce(w.n, s.n_chunks) AS INTEGER) AS stored
  FROM final f LEFT JOIN worked w ON w.doc_id = f.doc_id LEFT JOIN store_docs s ON s.doc_id = f.doc_id""")
def import_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after an import of all files into a store with finished, failed, stale, renamed, lost and orphaned documents, and
    the number of chunks that the store has of each."""
    ledger = C.prev_ledger(C.scanned(spark, sf_dir))
    target = store.CorpusStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    known = C.store_docs(ledger).join(ledger.select("doc_id", "path"), "doc_id", "left").select("doc_id", "path", "n_chunks", F.lit("").alias("part"))
    target.commit(target.current(), ledger=target.write(ledger, "ledger"), docs=target.write(known, "docs"))
    config = ImportConfig(chunk=ChunkConfig("fixed_lines", WINDOW))
    version = importer.import_documents(C.doc_files(spark, sf_dir), target, C.NOW, config).version
    stored = target.docs(version).select("doc_id", F.col("n_chunks").alias("stored"))
    return target.ledger(version).join(stored, "doc_id", "left").select("doc_id", "path", "status", "chunk_count", "stored")


_SCANNED = """files AS (SELECT doc_id, source, text, doc_id % 12 AS m, CASE WHEN doc_id % 12 = 2 THEN '.env.' || doc_id WHEN doc_id % 12 = 3 THEN '_' || doc_id || '.md' WHEN doc_id % 12 = 4 THEN doc_id || '.txt' ELSE doc_id || '.md' END AS name,
    CASE WHEN doc_id % 12 = 1 THEN '.hidden' WHEN doc_id % 12 = 5 THEN 'node_modules' WHEN doc_id % 12 = 6 THEN 'deep/er/still' ELSE 'd' || (doc_id % 7) END AS folder FROM documents)"""


@query(rf"""WITH {_SCANNED} SELECT 'docs/' || source || '/' || folder || '/' || name AS path, CAST(strlen(text) + CASE WHEN m = 7 THEN 1 ELSE 0 END AS BIGINT) AS size,
  m IN (2, 4) AS unread, CASE WHEN m IN (2, 4) THEN NULL WHEN m = 7 THEN sha256('FF' || hex(text)) ELSE sha256(hex(text)) END AS bytes_sha256
  FROM files WHERE m NOT IN (1, 5)""")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a tree of files, written by tasks and scanned: hidden and ignored folders, hidden names, other suffixes
    and bytes that are no text among them. The tree is deleted once it is read."""
    root = storage.qualified(spark, f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}")
    m, number = F.col("doc_id") % 12, F.col("doc_id").cast("string")
    name = F.when(m == 2, F.concat(F.lit(".env."), number)).when(m == 3, F.concat(F.lit("_"), number, F.lit(".md"))).when(m == 4, F.concat(number, F.lit(".txt"))).otherwise(F.concat(number, F.lit(".md")))
    folder = F.when(m == 1, ".hidden").when(m == 5, "node_modules").when(m == 6, "deep/er/still").otherwise(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")))
    body = F.when(m == 7, F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    files = C.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", folder, name).alias("path"), body.alias("content"))
    try:
        cut(source.write_files(files, root), "written").count()
        rows = source.scan(spark, root).select("path", "size", F.col("content").isNull().alias("unread"), F.sha2(F.hex("content"), 256).alias("bytes_sha256"))
        return keep(rows, "scanned")
    finally:
        storage.delete(spark, root)


@query(f"WITH {_PLAN} SELECT path, action, CASE WHEN action = 'renamed' THEN previous_path || ' -> ' || path || ' (same content)' WHEN action = 'updated' THEN path || ' (new content, was ' || previous_doc_id || ')' WHEN action = 'removed' THEN path || ' (gone)' WHEN action = 'locked' THEN path || ' (in work elsewhere)' WHEN action = 'resumed' THEN path || ' (' || coalesce(reason, 'taken over') || ')' ELSE path END AS description FROM plan")
def plan_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.in_order(planner.described(_plan(spark, sf_dir))).select("path", "action", "description")


@query(f"""WITH {C.SQL_FILES}, {_sql_windows('doc_files', WINDOW)} SELECT path, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, content, heading_path FROM chunks""")
def chunks_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents by the table function, in SQL."""
    chunking.register_table_functions(spark)
    C.doc_texts(spark, sf_dir).createOrReplaceTempView("texts_of_documents")
    return spark.sql(f"SELECT d.path, c.* FROM texts_of_documents d, LATERAL chunk_text('fixed_lines', d.path, d.text, {WINDOW}) c")


_TURNS = f"{C.SQL_CONV}, asked AS (SELECT 'conv/' || conv_id || '-' || (turn // {C.TURNS}) || '.md' AS path, conv_id || ':' || turn AS id, role AS family, 'Turn ' || turn || ' ' || role AS title FROM conversations)"


@query(rf"""WITH RECURSIVE {_TURNS}, {SQL_HEADS}, {_sql_split(BLOCK)}, spans AS ({SQL_PIECES}),
chunks AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_line) AS chunk_no, start_line, end_line, content, heading_path FROM spans WHERE NOT ({C.sql_blank("content")})), {SQL_FILTERED},
cases AS (SELECT a.id, a.family, a.path, h.ln AS line FROM asked a JOIN heads h ON h.path = a.path AND h.title = a.title)
SELECT id, family, path, matched_citation IS NOT NULL AS hit, matched_citation FROM (SELECT c.id, c.family, c.path, min(CASE WHEN k.drop_rule IS NULL THEN k.path || ':' || k.start_line || '-' || k.end_line END) AS matched_citation
  FROM cases c LEFT JOIN filtered k ON k.path = c.path AND k.start_line <= c.line AND k.end_line >= c.line + 2 GROUP BY ALL)""")
def eval_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each turn of each conversation: the lines of its heading and the first line under it."""
    texts = C.conv_md(spark, sf_dir)
    heads = chunking.heading_blocks(texts).select("path", "title", F.col("start_line").alias("line"))
    turn = F.col("turn").cast("string")
    asked = C.table(spark, sf_dir, "conversations").select(
        C.conv_path().alias("path"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn).alias("id"), F.col("role").alias("family"), F.concat(F.lit("Turn "), turn, F.lit(" "), "role").alias("title")
    )
    cases = asked.join(heads, ["path", "title"]).select("id", "family", "path", F.col("line").alias("expect_start_line"), (F.col("line") + 2).alias("expect_end_line"))
    return evaluate.outcomes_in(texts, cases, [ChunkConfig("markdown_heading", BLOCK)]).drop("setting")
