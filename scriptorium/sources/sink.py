"""A corpus store as a sink.

    spark.dataSource.register(CorpusSink)
    chunks.write.format("corpus_store").option("root", folder).mode("append").save()

chunks has doc_id, path, chunk_no, start_line, end_line, content and heading_path. A save makes one version of the store: documents in it
take the place of those with their ids, others stay; with mode overwrite, none does. Tasks write their files under draft names. The
driver renames the files of the attempts that count and commits the version by one rename, which fails if another import made that
version first; then the next number is tried. A save that fails, or a task that is lost, leaves the former version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scriptorium.functions import storage

CHUNK = pa.schema([("doc_id", pa.string()), ("chunk_no", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("heading_path", pa.string())])
DELTA = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("n_chunks", pa.int32()), ("at", pa.string())])
#: The layout of a version's file.
FORMAT, TRIES = 1, 20


@dataclass
class _Written(WriterCommitMessage):
    """A task's files, without folder."""

    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        missing = {*CHUNK.names, "path"} - set(columns)
        if missing:
            raise ValueError(f"chunks lack {', '.join(sorted(missing))}")
        self.root, self.overwrite, self.now, self.store_id = options["root"].rstrip("/"), overwrite, options.get("now", ""), options.get("store_id", "")
        self.part = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written | None:
        store, root = storage.opened(self.root)
        name, writers = uuid.uuid4().hex, {}
        folder = f"{root}/drafts/{self.part}"
        for batch in iterator:
            if not len(batch):
                continue
            if batch.column("doc_id").null_count:
                raise ValueError("a chunk needs the id of its document")
            rows = pa.Table.from_batches([batch])
            counted = rows.group_by("doc_id").aggregate([("path", "max"), ("doc_id", "count")])
            delta = pa.table([counted.column("doc_id"), counted.column("path_max"), counted.column("doc_id_count").cast(pa.int32()), pa.array([self.now] * len(counted), pa.string())], schema=DELTA)
            for kind, table in (("chunks", rows.select(CHUNK.names).cast(CHUNK)), ("deltas", delta)):
                if kind not in writers:
                    store.create_dir(folder, recursive=True)
                    writers[kind] = pq.ParquetWriter(f"{folder}/{kind}-{name}.parquet", table.schema, filesystem=store)
                writers[kind].write_table(table)
        for w in writers.values():
            w.close()
        return _Written(name if writers else "")

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = storage.opened(self.root)
        names = [m.name for m in messages if m is not None and m.name]
        for kind in ("chunks", "deltas"):
            store.create_dir(f"{root}/{kind}/part={self.part}", recursive=True)
            for name in names:
                store.move(f"{root}/drafts/{self.part}/{kind}-{name}.parquet", f"{root}/{kind}/part={self.part}/{name}.parquet")
        self._drop(store, root)
        for _ in range(TRIES):
            before = self._current(store, root)
            if self.overwrite:
                before |= {"ledger": "", "docs": "", "parts": [], "deltas": []}
            after = before | {"number": before["number"] + 1}
            if names:
                after |= {"parts": [*before["parts"], self.part], "deltas": [*before["deltas"], self.part]}
            if storage.put_new(store, f"{root}/versions/{after['number']:010d}.json", json.dumps(after)):
                return
        raise RuntimeError(f"{TRIES} other imports were first, one after another")

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(*storage.opened(self.root))

    def _drop(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/drafts/{self.part}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/drafts/{self.part}")

    def _current(self, store: fs.FileSystem, root: str) -> dict:
        names = sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True)) if x.base_name.endswith(".json"))
        if not names:
            return {"number": 0, "store_id": self.store_id or uuid.uuid4().hex[:12], "ledger": "", "docs": "", "parts": [], "deltas": [], "format": FORMAT}
        with store.open_input_stream(names[-1]) as f:
            found = json.loads(f.read())
        if found["format"] != FORMAT:
            raise ValueError(f"the store has format {found['format']}, this writes {FORMAT}")
        return {"deltas": []} | found


class CorpusSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_store"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema.names, overwrite)
