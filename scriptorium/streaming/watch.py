"""Documents as streams of files.

A file stream sees new files only, never removals or renames, so an import from it removes nothing; a scan of all files does
that. Each micro-batch commits a version of its own, and so rewrites the ledger and the table of documents (small columns;
chunks are only added): batches should be large, by trigger or maxFilesPerTrigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scriptorium.config import ChunkConfig, ImportConfig
from scriptorium.operators import chunking
from scriptorium.operators.importer import import_documents
from scriptorium.operators.store import CorpusStore


def chunk_stream(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Chunks of a stream of docs (path, text). Stateless: a document's chunks come with it, repeats among them included."""
    config = config or ChunkConfig()
    return chunking.get_strategy(config.strategy)(docs, config.max_lines)


def import_stream(files: DataFrame, target: CorpusStore, checkpoint: str, now: Callable[[], str], config: ImportConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Imports each micro-batch of files (path, size, content or text). now gives the ISO time of each batch; trigger is as
    Spark's own, such as {"availableNow": True}. A batch that is tried again finds its documents unchanged, so it is
    imported once."""

    def one(batch: DataFrame, number: int) -> None:
        import_documents(batch, target, now(), config, remove=False, clear_orphans=False)

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
