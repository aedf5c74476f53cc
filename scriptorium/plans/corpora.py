"""Corpora that the driver's tables give, built alike for Spark and as SQL.

documents become one file each (``doc_files``), conversations files with headings (``conv_md``: one each, longer ones one for
each 5,000 turns, so that a file is bounded), and from the files comes a ledger of an earlier import (``prev_ledger``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.cuts import cut
from scriptorium.operators import ingest

NOW = "2026-09-19T00:00:00"
TURNS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text", F.octet_length("text").cast("long").alias("size"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).select("path", T.normalize(F.col("text")).alias("text"))


def conv_path() -> Column:
    """The file of a turn (conv_id, turn)."""
    return F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / TURNS).cast("string"), F.lit(".md"))


def conv_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.floor(F.col("turn") / TURNS).cast("long")
    sign = F.when(F.col("turn") % 2 == 0, "## ").otherwise("### ")
    piece = F.concat(sign, F.lit("Turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", block.alias("block"), "turn", piece.alias("piece"))
    whole = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"))
    body = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    head = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    return whole.withColumn("turn", F.col("block") * TURNS).select(conv_path().alias("path"), T.normalize(F.concat(head, body)).alias("text"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted doc_files with the number that their path holds, written once, as plans read them several times."""
    docs = ingest.documents(ingest.ingest(doc_files(spark, sf_dir)))
    return cut(docs.withColumn("n", F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("long")), "scanned")


def prev_ledger(docs: DataFrame) -> DataFrame:
    """A ledger in which a tenth each is renamed, changed, missing, failed, in work and left behind, and some is gone."""
    m = F.col("n") % 10
    own = docs.filter(m != 3).select(
        F.when(m == 2, F.substring(F.sha2(F.concat(F.lit("old"), "doc_id"), 256), 1, 16)).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(m == 1, F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        F.when(m == 4, "failed").when(m.isin(5, 6), "processing").otherwise("ready").alias("status"),
        F.when(m.isin(4, 5, 6), 0).otherwise(F.col("line_count")).alias("chunk_count"),
        F.when(m == 5, "2026-09-18T23:55:00").when(m == 6, "2026-09-18T22:00:00").otherwise("2026-09-01T00:00:00").alias("started_at"),
        F.when(m.isin(4, 5, 6), "").otherwise("2026-09-01T00:00:00").alias("ready_at"),
    )
    gone = docs.filter("n % 50 = 7").select(
        F.substring(F.sha2(F.concat(F.lit("gone"), "doc_id"), 256), 1, 16).alias("doc_id"), F.concat(F.lit("gone/"), F.col("path")).alias("path"), F.lit("ready").alias("status"),
        F.lit(1).alias("chunk_count"), F.lit("2026-09-01T00:00:00").alias("started_at"), F.lit("2026-09-01T00:00:00").alias("ready_at"),
    )
    return own.unionByName(gone)


def store_docs(ledger: DataFrame) -> DataFrame:
    """Documents of a store that lacks some finished ones, and has some that the ledger does not know."""
    own = ledger.filter("status = 'ready' and left(doc_id, 1) <> '0'").select("doc_id", F.col("chunk_count").alias("n_chunks"))
    more = ledger.filter("left(doc_id, 1) = '1'").select(F.substring(F.sha2(F.concat(F.lit("orphan"), "doc_id"), 256), 1, 16).alias("doc_id"), F.lit(0).alias("n_chunks"))
    return own.unionByName(more)


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{T.SPACE}]+|[{T.SPACE}]+\\z', '', 'g')"


def _sql_norm(c: str) -> str:
    return _sql_strip(f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')")


def sql_lines(c: str) -> str:
    parts = f"string_split_regex({c}, '{T.LINE_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END"


def sql_blank(c: str) -> str:
    return f"NOT regexp_matches({c}, '[^{T.SPACE}]')"


sql_strip = _sql_strip

SECRETS = """CASE WHEN regexp_matches(text, 'sk-[A-Za-z0-9]{16,}') THEN 'api_key'
    WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'aws_access_key'
    WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key'
    WHEN regexp_matches(text, '(?i)(password|passwd|pwd)\\s*[:=]\\s*\\S+') THEN 'password'
    WHEN regexp_matches(text, '(?i)(api[_-]?key|secret|token)\\s*[:=]\\s*[''"]?[A-Za-z0-9_\\-]{16,}') THEN 'key_assignment' END"""

#: Common table expressions, each of which needs those before it.
SQL_FILES = f"""doc_files AS (
  SELECT 'docs/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md' AS path, {_sql_norm("text")} AS text, strlen(text) AS size FROM documents)"""
SQL_CONV = f"""conv_md AS (
  SELECT 'conv/' || conv_id || '-' || (turn // {TURNS}) || '.md' AS path,
    {_sql_norm(f"'# Conversation ' || conv_id || chr(10) || chr(10) || string_agg((CASE WHEN turn % 2 = 0 THEN '## ' ELSE '### ' END) || 'Turn ' || turn || ' ' || role || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10), '' ORDER BY turn)")} AS text
  FROM conversations GROUP BY conv_id, turn // {TURNS})"""
SQL_JUDGED = f"""judged AS (
  SELECT path, text, CASE WHEN size = 0 THEN 'empty_file' WHEN size > 2097152 THEN 'too_large' WHEN text = '' THEN 'unreadable' WHEN ({SECRETS}) IS NOT NULL THEN 'secret_content' END AS bad,
    {SECRETS} AS kind, substr(sha256(text), 1, 16) AS doc_id FROM doc_files),
ingested AS (
  SELECT path, text, bad, kind, doc_id, first_value(path) OVER (PARTITION BY doc_id, bad IS NULL ORDER BY string_split(path, '/')) AS first_path FROM judged),
docs AS (
  SELECT path, doc_id, text, len({sql_lines("text")}) AS line_count, CAST(regexp_extract(path, '/(\\d+)\\.md$', 1) AS BIGINT) AS n FROM ingested WHERE bad IS NULL AND path = first_path)"""
SQL_LEDGER = """ledger AS (
  SELECT CASE WHEN n % 10 = 2 THEN substr(sha256('old' || doc_id), 1, 16) ELSE doc_id END AS doc_id,
    CASE WHEN n % 10 = 1 THEN 'old/' || path ELSE path END AS path,
    CASE WHEN n % 10 = 4 THEN 'failed' WHEN n % 10 IN (5, 6) THEN 'processing' ELSE 'ready' END AS status,
    CASE WHEN n % 10 IN (4, 5, 6) THEN 0 ELSE line_count END AS chunk_count,
    CASE WHEN n % 10 = 5 THEN '2026-09-18T23:55:00' WHEN n % 10 = 6 THEN '2026-09-18T22:00:00' ELSE '2026-09-01T00:00:00' END AS started_at
  FROM docs WHERE n % 10 <> 3
  UNION ALL
  SELECT substr(sha256('gone' || doc_id), 1, 16), 'gone/' || path, 'ready', 1, '2026-09-01T00:00:00' FROM docs WHERE n % 50 = 7),
store_docs AS (
  SELECT doc_id, chunk_count AS n_chunks FROM ledger WHERE status = 'ready' AND left(doc_id, 1) <> '0'
  UNION ALL SELECT substr(sha256('orphan' || doc_id), 1, 16), 0 FROM ledger WHERE left(doc_id, 1) = '1')"""
