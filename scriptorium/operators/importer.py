"""Imports: scan, plan, claim, chunk, commit. A second import of the same files changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.config import ImportConfig
from scriptorium.functions.cuts import cut, scratch
from scriptorium.operators import chunking, ingest, planner, store
from scriptorium.operators.store import CorpusStore, Version


@dataclass(frozen=True)
class ImportReport:
    """Counts of an import, and the version that it made."""

    version: Version
    actions: dict[str, int]
    documents: int
    chunks: int
    repaired: int
    orphans: int
    failed: int
    ledger_discarded: bool

    def summary(self) -> str:
        notes = [f"{self.documents} documents, {self.chunks} chunks", *([f"{self.repaired} repaired"] * bool(self.repaired)), *([f"{self.orphans} orphans cleared"] * bool(self.orphans))]
        notes += [f"{self.failed} failed"] * bool(self.failed) + ["the ledger told of another store"] * self.ledger_discarded
        return f"{planner.summary(self.actions)} ({'; '.join(notes)})"

    @property
    def succeeded(self) -> int:
        return sum(self.actions.get(a, 0) for a in planner.WORK) - self.failed


def import_documents(
    files: DataFrame,
    target: CorpusStore,
    now: str,
    config: ImportConfig | None = None,
    chunker: Callable[[DataFrame], DataFrame] | None = None,
    remove: bool = True,
    clear_orphans: bool = True,
) -> ImportReport:
    """Brings the store up to the files (path, size, content or text). now is an ISO time.

    Two versions are committed: a claim, whose ledger marks what is worked on, and the result. A crash between them leaves
    rows that the next import takes over when their time is over. chunker makes chunks of docs (doc_id, path, text) and may
    give rows with a text in ``error`` instead: those documents are marked failed, the others are imported. Without
    remove, files are taken as a part of the corpus: what they lack stays. Documents of the store that neither the ledger nor
    the files know are cleared; without clear_orphans they count as removals, which the settings limit. Everything that
    can refuse an import is checked before the claim, so a refused one leaves no trace.
    """
    with scratch(target.spark):
        return _import(files, target, now, config or ImportConfig(), chunker, remove, clear_orphans)


def _import(files: DataFrame, target: CorpusStore, now: str, config: ImportConfig, chunker: Callable[[DataFrame], DataFrame] | None, remove: bool, clear_orphans: bool) -> ImportReport:
    chunker = chunker or (lambda docs: chunking.chunk(docs, config.chunk))
    before = target.current()
    docs = cut(ingest.documents(ingest.ingest(files, config.admission)), "docs")
    ledger, store_docs = target.ledger(before), target.docs(before)
    discarded = bool(target.store_id and before.number and before.store_id != target.store_id)
    if discarded:  # it tells of another store
        ledger = ledger.limit(0)
    ledger, lost = store.reconcile(ledger, store_docs)
    planner.check_paths(ledger)
    plan = planner.classify(docs, ledger, now, config)
    plan = cut(plan if remove else plan.filter("action <> 'removed'"), "plan")
    known = ledger.count()
    planner.check_removals(plan, known, config.max_removal_ratio)
    work = planner.needs_work(plan).select("doc_id", "path", "action", "previous_doc_id")
    texts = docs.join(work.select("doc_id"), "doc_id", "left_semi").select("doc_id", "path", "text")
    planner.check_found(work.count(), texts.count())
    stale = cut(store.orphans(store_docs, ledger.select("doc_id").unionByName(work.select("doc_id"))), "orphans")
    n_orphans = stale.count()
    if n_orphans and not clear_orphans:
        planner.check_removals(plan, max(known, store_docs.count()), config.max_removal_ratio, n_orphans)

    moved = plan.filter("action = 'renamed'").select("doc_id", F.col("path").alias("new_path"), "previous_path")
    out = plan.filter("action = 'removed'").select("doc_id", "path").unionByName(plan.filter("action = 'updated'").select(F.col("previous_doc_id").alias("doc_id"), F.col("previous_path").alias("path")))
    mine = work.select("doc_id", "path").unionByName(out).unionByName(moved.select("doc_id", F.col("new_path").alias("path"))).unionByName(moved.select("doc_id", F.col("previous_path").alias("path")))
    mine = cut(mine.unionByName(lost.join(target.ledger(before).select("doc_id", "path"), "doc_id")), "mine")

    def base(version: Version) -> DataFrame:
        """The ledger of a version, as far as it is to be trusted."""
        return (target.ledger(version).limit(0) if discarded and version.number == before.number else target.ledger(version)).join(lost, "doc_id", "left_anti")

    # the claim: rows in work take the place of all rows of their id or path
    claimed = work.select("doc_id", "path", F.lit("processing").alias("status"), F.lit(0).alias("chunk_count"), F.lit(now).alias("started_at"), F.lit("").alias("ready_at"))

    def claiming(version: Version) -> dict:
        kept = base(version).join(work.select("doc_id"), "doc_id", "left_anti").join(work.select("path"), "path", "left_anti")
        return {"ledger": target.write(kept.select(claimed.columns).unionByName(claimed), "ledger"), "store_id": target.store_id or version.store_id}

    claim = target.commit_on(before, mine, claiming)

    part = uuid.uuid4().hex
    made = cut(_with_error(chunker(texts)), "chunks")
    failed = made.filter("error is not null").select("doc_id").distinct()
    good = made.filter("error is null").join(failed, "doc_id", "left_anti")
    good.select("doc_id", "chunk_no", "start_line", "end_line", "content", "heading_path").write.parquet(target.chunk_folder(part))
    counts = good.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks"))

    mark = failed.withColumn("bad", F.lit(True))
    done = work.join(mark, "doc_id", "left").join(counts, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    rows = done.select(
        "doc_id", "path", F.when(F.col("bad"), "failed").otherwise("ready").alias("status"), F.when(F.col("bad"), 0).otherwise(F.col("n_chunks")).alias("chunk_count"),
        F.lit(now).alias("started_at"), F.when(F.col("bad"), "").otherwise(F.lit(now)).alias("ready_at"),
    )
    renamed = cut(ledger.join(moved.select("doc_id", "new_path"), "doc_id").withColumn("path", F.col("new_path")).select(rows.columns), "renamed")
    fresh = done.filter("bad is null").select("doc_id", "path", "n_chunks", F.lit(part).alias("part"))
    made_tables: list[DataFrame] = []

    def finishing(version: Version) -> dict:
        changed = work.select("doc_id").unionByName(out.select("doc_id")).unionByName(renamed.select("doc_id"))
        final = cut(base(version).join(changed, "doc_id", "left_anti").select(rows.columns).unionByName(renamed).unionByName(rows), "ledger")
        stay = target.docs(version).join(work.select("doc_id"), "doc_id", "left_anti").join(final.select("doc_id"), "doc_id", "left_semi").join(moved.select("doc_id", "new_path"), "doc_id", "left")
        stay = stay.withColumn("path", F.coalesce("new_path", "path")).select(fresh.columns)
        made_tables.append(cut(stay.unionByName(fresh), "store-docs"))
        live = {r[0] for r in made_tables[-1].select("part").distinct().collect()}  # one for each import that is still of use
        parts = tuple(p for p in dict.fromkeys((*version.parts, part)) if p in live)
        return {"ledger": target.write(final, "ledger"), "docs": target.write(made_tables[-1], "docs"), "parts": parts}

    version = target.commit_on(claim, mine, finishing)
    tables = made_tables[-1]
    total = tables.agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
    return ImportReport(
        version, {r[0]: r[1] for r in planner.action_counts(plan).collect()}, total[0], total[1], lost.count(), n_orphans, failed.count(), discarded
    )


def _with_error(chunks: DataFrame) -> DataFrame:
    return chunks if "error" in chunks.columns else chunks.withColumn("error", F.lit(None).cast("string"))
