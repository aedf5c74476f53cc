"""Folders of files as tables, with those whose names are hidden from Spark's own readers, in any store that ``functions.storage`` opens.

    scan(spark, "hdfs://host/docs")

gives path (under display_root), size and content; a file that cannot be read, one over max_bytes, and one whose suffix is not wanted
has a null content. Folders that are ignored or begin with a dot are not entered.

The listing is a table of its own, made by tasks: a round lists the folders that the round before found, as many at once as there are
tasks, so the driver sees counts only and rounds are as many as folders are deep. The data source reads the listing in parts
of about equal bytes. It takes filters on size and path, and opens no file that they exclude.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from scriptorium.config import AdmissionConfig
from scriptorium.functions import storage
from scriptorium.functions.cuts import cut, scratch, shared_dir

#: Bytes of files, and files, of a task; folders of a task while they are listed; bytes that a task passes on at once.
TASK_BYTES, TASK_FILES, TASK_FOLDERS, BATCH_BYTES = 64 << 20, 1024, 16, 4 << 20


def _folders(batches: Iterator[pa.RecordBatch], ignored: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """(folder, path, size): what the folders hold; a row for a folder below has its name in folder, one for a file in path."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, where = storage.opened(folder)
            try:
                found = store.get_file_info(fs.FileSelector(where))
            except (OSError, PermissionError):
                continue
            rows = []
            for x in found:
                if x.type == fs.FileType.Directory:
                    if x.base_name not in ignored and not x.base_name.startswith("."):
                        rows.append((f"{folder}/{x.base_name}", None, None))
                elif x.type == fs.FileType.File:
                    rows.append((None, f"{folder}/{x.base_name}", x.size))
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["folder", "path", "size"])


def list_files(spark: SparkSession, root: str, ignored: tuple[str, ...] | None = None) -> DataFrame:
    """(path, size) of all files below root, by whole paths; a root that is not there has none."""
    root = storage.qualified(spark, root)
    names = frozenset(AdmissionConfig().ignored_dirs if ignored is None else ignored)
    empty = spark.createDataFrame([], "path string, size long")
    found, folders, count = empty, spark.createDataFrame([(root,)], "folder string"), int(storage.exists(spark, root))
    while count:
        tasks = max(1, min(count // TASK_FOLDERS + 1, spark.sparkContext.defaultParallelism * 16))
        level = cut(folders.repartition(tasks).mapInArrow(partial(_folders, ignored=names), "folder string, path string, size long"), "level")
        found = found.unionByName(level.filter("path is not null").select("path", "size"))
        folders = level.filter("folder is not null").select("folder")
        count = folders.count()
    return found


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes content (binary) of each row to the file path below root, by tasks; (path, size) of what was written. root is a qualified path.

    A file is written under another name and renamed, so a lost task leaves no half file under its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                store, where = storage.opened(f"{root}/{path}")
                folder = where.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}.draft"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(content.as_buffer())
                store.move(draft, where)
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")


class _Part(InputPartition):
    """A file of the listing."""

    def __init__(self, path: str):
        self.path = path


#: How the filters that a listing can answer compare.
_TESTS = {
    EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    StringEndsWith: lambda a, b: a.endswith(b), StringStartsWith: lambda a, b: a.startswith(b), StringContains: lambda a, b: b in a,
}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "size", "content"])


class _Reader(DataSourceReader):
    """Reads the files of a listing (path, size; a folder of Parquet files)."""

    def __init__(self, options: dict[str, str]):
        defaults = AdmissionConfig()
        if "listing" not in options:
            raise ValueError("corpus_files reads a listing: use scan()")
        self.listing, self.root, self.shown = options["listing"], options["root"].rstrip("/"), options.get("display_root", "docs")
        self.most = int(options.get("max_bytes", defaults.max_bytes))
        self.suffixes = tuple(options["suffixes"].split(",")) if options.get("suffixes") else ()
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = {("path",): 0, ("size",): 1}.get(getattr(f, "attribute", None))
            if type(f) in _TESTS and column is not None:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One for each file of the listing."""
        store, where = storage.opened(self.listing)
        return [_Part(f"{self.listing}/{x.base_name}") for x in store.get_file_info(fs.FileSelector(where)) if x.base_name.endswith(".parquet")] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, where = storage.opened(partition.path)
        rows = pq.read_table(where, columns=["path", "size"], filesystem=store)
        held: list[tuple] = []
        size = 0
        for whole, n in zip(rows.column("path").to_pylist(), rows.column("size").to_pylist(), strict=True):
            shown = f"{self.shown}/{whole[len(self.root) + 1 :]}"
            if not all(x is not None and _TESTS[kind](x, value) for column, kind, value in self.tests for x in [(shown, n)[column]]):
                continue
            held.append((shown, n, self._content(whole, n)))
            size += 100 + len(held[-1][2] or b"")
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _content(self, whole: str, size: int | None) -> bytes | None:
        if size is None or size > self.most or (self.suffixes and not whole.lower().endswith(self.suffixes)):
            return None
        files, where = storage.opened(whole)
        try:
            with files.open_input_stream(where, compression=None) as f:
                return f.read()
        except (OSError, PermissionError):
            return None


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "path string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, root: str, display_root: str = "docs", config: AdmissionConfig | None = None) -> DataFrame:
    """(path, size, content) of the files below root; see the module. What is left behind is the listing that the result reads."""
    config = config or AdmissionConfig()
    spark.dataSource.register(CorpusFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    root = storage.qualified(spark, root)
    with scratch(spark):
        files = list_files(spark, root, config.ignored_dirs)
        weight = F.greatest(F.least(F.coalesce("size", F.lit(0)), F.lit(config.max_bytes)), F.lit(TASK_BYTES // TASK_FILES))
        total = files.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
        where = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
        files.repartition(max(1, -(-total // TASK_BYTES))).write.parquet(where)
    options = {"listing": storage.qualified(spark, where), "root": root, "display_root": display_root, "max_bytes": str(config.max_bytes), "suffixes": ",".join(config.suffixes)}
    return spark.read.format("corpus_files").options(**options).load()
