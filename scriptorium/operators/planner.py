"""What an import has to do: scanned documents against the ledger, as two joins and a CASE.

Ledger rows have doc_id, path, status (processing, ready, failed), chunk_count, started_at and ready_at (ISO texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.config import ImportConfig

#: Also the schema for a ledger from rows: createDataFrame(rows, LEDGER).
LEDGER = "doc_id string, path string, status string, chunk_count int, started_at string, ready_at string"
#: Actions that cost chunking and embedding.
WORK = ("added", "updated", "resumed")
ACTIONS = ("added", "updated", "renamed", "unchanged", "removed", "locked", "resumed")


class RemovalRefused(ValueError):
    """More of the known documents would go than the ratio allows; nothing was written."""


def seconds(c: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(c))


def is_live(status: Column, started_at: Column, now: str, timeout: int) -> Column:
    """Whether a row is being processed and its time is not over; an unreadable time is over."""
    return (status == "processing") & F.coalesce(seconds(F.lit(now)) - seconds(started_at) <= timeout, F.lit(False))


def check_paths(ledger: DataFrame) -> None:
    """A path belongs to one ledger row at most."""
    twice = [r[0] for r in ledger.groupBy("path").count().filter("count > 1").select("path").limit(5).collect()]
    if twice:
        raise ValueError(f"the ledger has several documents for a path, such as {', '.join(sorted(twice))}")


def classify(docs: DataFrame, ledger: DataFrame, now: str, config: ImportConfig | None = None) -> DataFrame:
    """The plan: action, path, doc_id, previous_path, previous_doc_id, chunk_count, reason for each document of docs
    (path, doc_id; one row a doc_id), and a removal for each ledger row that is gone.

    A row whose path now has other content is updated only if its own content is not elsewhere in the scan; then it is
    renamed, and the new content is added.
    """
    config = config or ImportConfig()
    timeout = config.processing_timeout_seconds
    live = lambda p: is_live(F.col(f"{p}.status"), F.col(f"{p}.started_at"), now, timeout)
    scan = docs.select("path", "doc_id").alias("s")
    here = ledger.join(docs.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left").withColumn("stays", F.col("__id").isNotNull()).drop("__id")
    both = scan.join(ledger.alias("i"), F.col("s.doc_id") == F.col("i.doc_id"), "left").join(here.alias("p"), F.col("s.path") == F.col("p.path"), "left")
    known, occupied = F.col("i.doc_id").isNotNull(), F.col("p.doc_id").isNotNull()
    locked_id, locked_path = F.coalesce(live("i"), F.lit(False)), F.coalesce(live("p"), F.lit(False))
    ready = F.col("i.status") == "ready"
    action = (
        F.when(locked_id | locked_path, "locked")
        .when(known & ready & (F.col("i.path") == F.col("s.path")), "unchanged")
        .when(known & ready, "renamed")
        .when(known, "resumed")
        .when(occupied & ~F.col("p.stays"), "updated")
        .otherwise("added")
    )
    chosen = both.withColumn("action", action).withColumn("by_path", (F.col("action") == "updated") | ((F.col("action") == "locked") & ~locked_id))
    pick = lambda c: F.when(F.col("by_path"), F.col(f"p.{c}")).when(F.col("action") != "added", F.col(f"i.{c}"))
    reason = F.when(F.col("action") == "locked", F.concat(F.lit("in work since "), pick("started_at"))).when(
        F.col("action") == "resumed", F.when(F.col("i.status") == "failed", "failed before").otherwise(F.concat(F.lit("not finished since "), F.coalesce("i.started_at", F.lit("?"))))
    )
    plan = chosen.select(
        "action", F.col("s.path").alias("path"), F.col("s.doc_id").alias("doc_id"), pick("path").alias("previous_path"), pick("doc_id").alias("previous_doc_id"),
        F.coalesce(pick("chunk_count"), F.lit(0)).alias("chunk_count"), reason.alias("reason"),
    )
    # what an update replaces is no removal; nor is a row that someone works on
    replaced = plan.filter("action = 'updated'").select(F.col("previous_doc_id").alias("doc_id"))
    gone = ledger.filter(~is_live(F.col("status"), F.col("started_at"), now, timeout)).join(docs.select("doc_id"), "doc_id", "left_anti").join(replaced, "doc_id", "left_anti")
    removals = gone.select(
        F.lit("removed").alias("action"), "path", "doc_id", F.col("path").alias("previous_path"), F.col("doc_id").alias("previous_doc_id"), "chunk_count", F.lit(None).cast("string").alias("reason")
    )
    return plan.unionByName(removals)


def needs_work(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("action").isin(*WORK))


def blocks_progress(plan: DataFrame) -> DataFrame:
    """What other imports work on now."""
    return plan.filter("action = 'locked'")


def in_order(plan: DataFrame) -> DataFrame:
    """The plan by path, then action."""
    return plan.orderBy("path", "action")


def described(plan: DataFrame) -> DataFrame:
    """The plan with a sentence about each row."""
    said = (
        F.when(F.col("action") == "renamed", F.concat("previous_path", F.lit(" -> "), "path", F.lit(" (same content)")))
        .when(F.col("action") == "updated", F.concat("path", F.lit(" (new content, was "), "previous_doc_id", F.lit(")")))
        .when(F.col("action") == "removed", F.concat("path", F.lit(" (gone)")))
        .when(F.col("action") == "locked", F.concat("path", F.lit(" (in work elsewhere)")))
        .when(F.col("action") == "resumed", F.concat("path", F.lit(" ("), F.coalesce("reason", F.lit("taken over")), F.lit(")")))
    )
    return plan.withColumn("description", F.coalesce(said, "path"))


def summary(counts: dict[str, int]) -> str:
    """One line of a plan's action counts."""
    return ", ".join(f"{counts[a]} {a}" for a in ACTIONS if counts.get(a)) or "nothing to do"


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def check_found(planned: int, found: int) -> None:
    """Every planned document must be among the scanned ones, once."""
    if planned != found:
        raise ValueError(f"{planned} documents are planned, {found} are in the scan")


def check_removals(plan: DataFrame, known: int, most: float, more: int = 0) -> None:
    """Refuses a plan that would remove more than a share of the known documents; more: removals besides the plan's."""
    gone = plan.filter("action = 'removed'").count() + more
    if known and gone / known > most:
        raise RemovalRefused(f"{gone} of {known} known documents would be removed; the limit is {most:.0%}")
