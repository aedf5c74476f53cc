"""From files to documents: every file gets a status, by two passes over contents and one shuffle of ids and paths. Texts are never
shuffled, nor written on the way; what is left behind is the table of repeated ids that the result reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scriptorium.config import AdmissionConfig
from scriptorium.functions import text as T
from scriptorium.functions.cuts import cut, small
from scriptorium.operators import admission


def path_order(path: Column) -> Column:
    """Scan order: by the parts of a path, so a directory's files come before files whose names go on."""
    return F.split(path, "/")


def ingest(files: DataFrame, config: AdmissionConfig | None = None, more: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """A row for each file: path, status (admitted, rejected, skipped), stage, rule, detail, doc_id, text, line_count.

    files has path, size and content (binary; null if it could not be read) or text in its place. Names are judged
    before suffixes, so files with keys are on record; then sizes; content is touched for what is left. Of files
    with one text the first in scan order is admitted. more: rules of the user by name, each from the columns of path and
    normalized text to a condition, tried after the built-in ones.
    """
    config = config or AdmissionConfig()
    name_rule = admission.secret_name(F.col("path")) if config.block_secret_filenames else F.lit(None).cast("string")
    wanted = admission.suffix(F.col("path")).isin(*config.suffixes)
    if "content" in files.columns:
        decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    else:
        decoded = F.col("text")
    early = files.select(
        "path",
        F.coalesce(name_rule, F.when(~wanted, "skipped"), admission.size_rule(F.col("size"), config)).alias("early"),
        decoded.alias("raw"),
    )
    read = early.withColumn("text", F.when(F.col("early").isNull(), T.normalize(F.col("raw")))).drop("raw")
    unread = F.when(F.col("early").isNull() & (F.col("text").isNull() | (F.col("text") == "")), "unreadable")
    secret = admission.secret_text(F.col("text")) if config.scan_content_for_secrets else F.lit(None).cast("string")
    own = [F.when(breaks(F.col("path"), F.col("text")), F.lit(name)) for name, breaks in (more or {}).items()]
    judged = read.withColumn("late", F.coalesce(unread, secret)).withColumn("own", F.when(F.col("early").isNull() & F.col("late").isNull(), F.coalesce(*own, F.lit(None))).cast("string"))
    judged = judged.withColumn("doc_id", F.when(F.coalesce("early", "late", "own").isNull(), T.fingerprint(F.col("text"))))
    # copies are found by ids and paths alone, so texts are neither shuffled nor written; the files are read again with what is known of copies
    order = F.struct(path_order(F.col("path")).alias("parts"), "path")
    # files without id are a group that counts none: a filter on the id would be moved down to the contents, and normalize them for each use
    groups = judged.groupBy("doc_id").agg(F.min(order).getField("path").alias("first_path"), F.count("doc_id").alias("n"))
    found = judged.join(small(cut(groups.filter("n > 1").drop("n"), "copies")), "doc_id", "left")
    copy = F.coalesce(F.col("first_path") != F.col("path"), F.lit(False))
    rule = F.coalesce("early", F.when(F.col("late") == "unreadable", "unreadable"), F.when(F.col("late").isNotNull(), "secret_content"), "own", F.when(copy, "duplicate"))
    admitted = rule.isNull()
    return found.select(
        "path",
        F.when(admitted, "admitted").when(rule == "skipped", "skipped").otherwise("rejected").alias("status"),
        F.when(rule == "unreadable", "loading").when(~admitted & (rule != "skipped"), "admission").alias("stage"),
        F.when(rule != "skipped", rule).alias("rule"),
        F.when(rule == "secret_content", F.col("late")).when(rule == "duplicate", F.col("first_path")).alias("detail"),
        "doc_id",
        F.when(admitted, F.col("text")).alias("text"),
        F.when(admitted, F.size(T.split_lines(F.col("text")))).alias("line_count"),
    )


def documents(ingested: DataFrame) -> DataFrame:
    return ingested.filter("status = 'admitted'").select("path", "doc_id", "text", "line_count")


def rejected(ingested: DataFrame) -> DataFrame:
    return ingested.filter("status = 'rejected'").select("path", "stage", "rule", "detail")


def report(ingested: DataFrame) -> DataFrame:
    """One row: files scanned, skipped, admitted, rejected at each stage, and lines of the admitted."""
    is_ = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    return ingested.agg(
        F.count("*").alias("scanned"),
        is_("status", "skipped").alias("skipped"),
        is_("status", "admitted").alias("admitted"),
        is_("stage", "admission").alias("rejected_admission"),
        is_("stage", "loading").alias("rejected_loading"),
        F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("total_lines"),
    )


def summary(row: Row) -> str:
    """One line of a report's row."""
    return f"{row.scanned} scanned: {row.admitted} admitted with {row.total_lines} lines, {row.skipped} skipped, {row.rejected_admission} refused, {row.rejected_loading} unreadable"
