"""A training corpus from the documents table: five stages, each over all that its predecessor kept.

All stages but the last return the columns of documents and drop others, whatever their names. Repeated rows have one fate.
A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, scratch
from scriptorium.llm import decontaminate, language, line_dedup, pieces
from scriptorium.llm.ngram_join import ngram_components
from scriptorium.llm.registry import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with the model's bounds; those that it rejects go, and so do null texts and texts
    without a letter. Rows without doc_id are judged by their text too."""
    return language.accepted(docs, language.fit_on_documents(docs)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one; a document of which no line is left goes.

    Null texts, empty ones and rows without doc_id stay as they are. Of equal lines, the one with the least doc_id stays. n_chars is
    counted anew where a text was changed."""
    kept = line_dedup.dedup_lines(docs).filter("size(removed_lines) = 0 or text <> ''")
    return kept.withColumn("n_chars", F.when(F.size("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least doc_id; documents without doc_id, null texts and empty ones stay.

    Rows of one doc_id are one document: they go if all of them have a partner with a lesser one."""
    fates = ngram_components(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("goes"))
    gone = fates.filter("goes").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts and rows without doc_id stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=1).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of a document's ids and of what they decode to; a null text is an empty one."""
    return pieces.digests(docs, piece_model())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", tokens),
]

#: Models and tokenizers are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), name)
        _, stage = STAGES[-1]  # its rows outlive the scratch
        return stage(spark, docs, sf_dir)
