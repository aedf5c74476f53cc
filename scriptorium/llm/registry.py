"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import storage
from scriptorium.functions.cuts import shared_dir
from scriptorium.llm import collocations, decontaminate, language, licenses, line_dedup, main_text, oracles, pieces, quality, ranked, secrets, topk, warc
from scriptorium.llm.ngram_join import ngram_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the public 32k model lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least_words=1)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"), wrapped=True).drop("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), piece_model())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, the numbers of those removed, and the digest of the text that stays."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), secrets.train())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the archives that are written; the archives themselves are deleted once they are read."""
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        return warc.archived(_table(spark, sf_dir, "pages"), root)
    finally:
        storage.delete(spark, root)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_OWN = (op1_ngram_join, op2_topk_search, op3_decontamination, op4_license_scan, op5_quality, op6_sentencepiece, op7_language_id, op8_main_text, op9_line_dedup, op10_secret_scan, op11_warc, op12_ranked_search, op13_collocations)
QUERIES = {x.__name__: x for x in _OWN}

#: The others are beyond SQL: trained models, a tokenizer, edit distances inside texts, HTML.
ORACLES: dict[str, str] = {
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op2_topk_search": oracles.TOP_K,
    "op4_license_scan": oracles.LICENSES,
    "op9_line_dedup": oracles.LINE_DEDUP,
    "op11_warc": oracles.WARC,
    "op12_ranked_search": oracles.RANKED,
    "op13_collocations": oracles.COLLOCATIONS,
}
