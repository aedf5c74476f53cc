"""Versioned tables of chunks and the ledger, committed together.

A version is one small JSON file that names the folders of its tables. It is written under another name and then
renamed, which fails if another import made that version first: that is the commit, and readers see whole files only. Chunks
lie in the folder of the import that made them (``chunks/part=...``) and are never rewritten; ``docs`` says for each document
where its chunks are and what its path is now. So a rename rewrites a row of ``docs``, and an import writes no more chunks
than it makes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut
from scriptorium.operators.planner import LEDGER
from scriptorium.sources import json_map

DOCS = "doc_id string, path string, n_chunks int, part string"
CHUNKS = "doc_id string, chunk_no int, start_line int, end_line int, content string, heading_path string"
FORMAT = 1
#: How often a commit is tried on the version of another import that was first.
REBASES = 20


class Conflict(RuntimeError):
    """Another import committed first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    store_id: str = ""
    ledger: str = ""
    docs: str = ""
    parts: tuple[str, ...] = ()
    #: Parts that the sink wrote since docs and ledger were; their documents come over those, later ones over earlier ones.
    deltas: tuple[str, ...] = ()
    format: int = field(default=FORMAT)


class CorpusStore:
    """The tables under one folder, of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, store_id: str = ""):
        self.spark, self.root, self.store_id = spark, root.rstrip("/"), store_id
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> Version:
        numbers = self._versions()
        if not numbers:
            return Version(store_id=self.store_id or uuid.uuid4().hex[:12])
        return self._read(numbers[-1])

    def _read(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/versions/{number:010d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        if found["format"] != FORMAT:
            raise ValueError(f"the store has format {found['format']}, this reads {FORMAT}")
        return Version(**found | {"parts": tuple(found["parts"]), "deltas": tuple(found.get("deltas", ()))})

    def at(self, number: int) -> Version:
        """The version of a number, as long as it is kept."""
        if number not in self._versions():
            raise LookupError(f"there is no version {number}")
        return self._read(number)

    def clear_up(self, keep: int = 10, grace_seconds: int = 86_400) -> int:
        """Deletes all versions but the last ``keep``, and the tables and parts that none of those names; the number of folders deleted.

        Folders that are younger than the grace may belong to an import that has not committed yet, so they stay.
        """
        numbers = self._versions()
        kept = [self._read(n) for n in numbers[-max(1, keep) :]]
        named = {x for v in kept for x in (v.ledger, v.docs, *(self.chunk_folder(p) for p in v.parts), *(f"{self.root}/deltas/part={p}" for p in v.deltas))}
        named = {self._path(x).toUri().getPath() for x in named if x}
        for n in numbers[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/versions/{n:010d}.json"), False)
        deleted, limit = 0, time.time() - grace_seconds
        for kind in ("ledger", "docs", "chunks", "deltas", "drafts"):
            folder = self._path(f"{self.root}/{kind}")
            for x in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if x.getPath().toUri().getPath() not in named and x.getModificationTime() / 1000 <= limit:
                    deleted += bool(self._fs.delete(x.getPath(), True))
        return deleted

    def _saved(self, version: Version) -> DataFrame:
        """(doc_id, path, n_chunks, part, at) of the documents of deltas, each as the last one has it."""
        folders = [f"{self.root}/deltas/part={p}" for p in version.deltas]
        rows = self.spark.read.schema("doc_id string, path string, n_chunks int, at string, part string").option("basePath", f"{self.root}/deltas").parquet(*folders)
        whole = rows.groupBy("doc_id", "part").agg(F.max("path").alias("path"), F.sum("n_chunks").cast("int").alias("n_chunks"), F.max("at").alias("at"))
        order = F.array_position(F.array(*map(F.lit, version.deltas)), F.col("part"))
        last = whole.groupBy("doc_id").agg(F.max_by(F.struct("path", "n_chunks", "part", "at"), order).alias("x"))
        return last.select("doc_id", "x.*")

    def ledger(self, version: Version) -> DataFrame:
        base = self.spark.read.schema(LEDGER).parquet(version.ledger) if version.ledger else self.spark.createDataFrame([], LEDGER)
        if not version.deltas:
            return base
        saved = self._saved(version).select("doc_id", "path", F.lit("ready").alias("status"), F.col("n_chunks").alias("chunk_count"), F.col("at").alias("started_at"), F.col("at").alias("ready_at"))
        return base.join(saved.select("doc_id"), "doc_id", "left_anti").join(saved.select("path"), "path", "left_anti").select(saved.columns).unionByName(saved)

    def docs(self, version: Version) -> DataFrame:
        base = self.spark.read.schema(DOCS).parquet(version.docs) if version.docs else self.spark.createDataFrame([], DOCS)
        if not version.deltas:
            return base
        saved = self._saved(version).select("doc_id", "path", "n_chunks", "part")
        return base.join(saved.select("doc_id"), "doc_id", "left_anti").join(saved.select("path"), "path", "left_anti").select(saved.columns).unionByName(saved)

    def chunks(self, version: Version) -> DataFrame:
        """Chunks of the version's documents with their present paths, from one scan of all its parts."""
        if not version.parts:
            return self.spark.createDataFrame([], f"{CHUNKS}, path string")
        folders = [self.chunk_folder(part) for part in version.parts]
        rows = self.spark.read.schema(f"{CHUNKS}, part string").option("basePath", f"{self.root}/chunks").parquet(*folders)
        return rows.join(self.docs(version).select("doc_id", "part", "path"), ["doc_id", "part"]).drop("part")

    def document(self, version: Version, doc_id: str) -> DataFrame:
        """One document's chunks; only its part is read."""
        where = self.docs(version).filter(F.col("doc_id") == doc_id).select("part").first()
        if where is None:
            return self.spark.createDataFrame([], f"{CHUNKS}, path string")
        return self.chunks(replace(version, parts=(where[0],))).filter(F.col("doc_id") == doc_id)

    def put(self, doc_id: str, path: str, chunks: DataFrame) -> Version:
        """Commits a document's chunks (chunk_no, start_line, end_line, content, heading_path) in place of those it had."""
        if not doc_id:
            raise ValueError("a document needs an id")
        now, part = self.current(), uuid.uuid4().hex
        rows = chunks.select(F.lit(doc_id).alias("doc_id"), "chunk_no", "start_line", "end_line", "content", "heading_path")
        rows.write.parquet(self.chunk_folder(part))
        n = self.spark.read.schema(CHUNKS).parquet(self.chunk_folder(part)).count()
        own = self.spark.createDataFrame([(doc_id, path, n, part)], DOCS)
        return self.commit(now, docs=self.write(self.docs(now).filter(F.col("doc_id") != doc_id).unionByName(own), "docs"), parts=(*now.parts, part))

    def delete(self, doc_id: str) -> int:
        """Commits the store without a document; the number of its chunks, 0 for one that is not there."""
        now = self.current()
        known = self.docs(now).filter(F.col("doc_id") == doc_id).select("n_chunks").first()
        if known is None:
            return 0
        self.commit(now, docs=self.write(self.docs(now).filter(F.col("doc_id") != doc_id), "docs"))
        return known[0]

    def doc_ids(self, version: Version) -> DataFrame:
        return self.docs(version).select("doc_id").orderBy("doc_id")

    def counts(self, version: Version) -> DataFrame:
        """One row: documents, chunks."""
        return self.docs(version).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))

    def views(self, version: Version, prefix: str = "corpus") -> None:
        """The version's tables as temporary views <prefix>_ledger, <prefix>_docs and <prefix>_chunks, kept in memory once read."""
        for name, table in (("ledger", self.ledger(version)), ("docs", self.docs(version)), ("chunks", self.chunks(version))):
            table.cache().createOrReplaceTempView(f"{prefix}_{name}")

    def chunk_folder(self, part: str) -> str:
        return f"{self.root}/chunks/part={part}"

    def write(self, df: DataFrame, kind: str) -> str:
        """Writes a table to a folder of its own; the folder's whole path."""
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def commit(self, before: Version, **changes) -> Version:
        """Makes the version after ``before`` current. Deltas of before are put into the tables that are written anew."""
        if before.deltas and "deltas" not in changes:
            changes = {"ledger": self.write(self.ledger(before), "ledger"), "docs": self.write(self.docs(before), "docs")} | changes | {"deltas": ()}
        after = Version(**asdict(before) | changes | {"number": before.number + 1})
        target = f"{self.root}/versions/{after.number:010d}.json"
        self._put(json.dumps(asdict(after)), target, f"version {after.number} was committed by another import")
        return after

    def touched(self, a: Version, b: Version) -> DataFrame:
        """(doc_id, path) of ledger rows that are not alike in two versions, as each of them has it."""
        x, y = self.ledger(a), self.ledger(b)
        return x.exceptAll(y).unionByName(y.exceptAll(x)).select("doc_id", "path").distinct()

    def commit_on(self, before: Version, mine: DataFrame, changes: Callable[[Version], dict]) -> Version:
        """Commits what changes makes of the version that it is given, and, if another import was first, of that one's version, as long as
        the rows that it touched have no id and no path of mine (doc_id, path). Otherwise the conflict is raised."""
        base = before
        for _ in range(REBASES):
            try:
                return self.commit(base, **changes(base))
            except Conflict:
                now = self.current()
                if before.number and now.store_id != before.store_id:
                    raise
                others = cut(self.touched(base, now), "touched")
                if not others.join(mine.select("doc_id"), "doc_id", "left_semi").isEmpty() or not others.join(mine.select("path"), "path", "left_semi").isEmpty():
                    raise
                base = now
        raise Conflict(f"{REBASES} other imports were first, one after another")

    def _put(self, text: str, target: str, conflict: str) -> None:
        """Writes a small file whole or not at all, and never over another."""
        jvm, path, draft = self.spark._jvm, self._path(target), self._path(f"{target}.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(path):
                raise Conflict(conflict) from e
            raise

    def compact(self) -> Version:
        """Rewrites the live chunks to one folder; the older ones are left to whoever clears up."""
        now = self.current()
        part = uuid.uuid4().hex
        self.chunks(now).drop("path").write.parquet(self.chunk_folder(part))
        return self.commit(now, parts=(part,), docs=self.write(self.docs(now).withColumn("part", F.lit(part)), "docs"))


def reconcile(ledger: DataFrame, store_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger without finished documents that the store lacks, and those documents' ids."""
    lost = ledger.filter("status = 'ready'").join(store_docs.select("doc_id"), "doc_id", "left_anti").select("doc_id")
    return ledger.join(lost, "doc_id", "left_anti"), lost


def orphans(store_docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents of the store that the ledger does not know."""
    return store_docs.join(ledger.select("doc_id"), "doc_id", "left_anti")


def read_json_ledger(spark: SparkSession, path: str, split: int = json_map.SPLIT) -> DataFrame:
    """A ledger from one JSON file {version, store_id, docs: {doc_id: row}}; older rows lack a status (then ready) or
    have imported_at for ready_at. A file that is not there is an empty ledger. It is read in ranges of split bytes."""
    row = "struct<path:string,status:string,chunk_count:int,started_at:string,ready_at:string,imported_at:string>"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return spark.createDataFrame([], LEDGER)
    entries = json_map.read_entries(spark, path, "docs", split)
    docs = entries.select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{row}>")).alias("doc_id", "r"))
    known = F.when(F.col("r.status").isin("processing", "ready", "failed"), F.col("r.status")).otherwise("ready")
    empty = F.lit("")
    return docs.select(
        "doc_id", F.coalesce("r.path", empty).alias("path"), known.alias("status"), F.coalesce("r.chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("r.started_at", empty).alias("started_at"), F.coalesce("r.ready_at", "r.imported_at", empty).alias("ready_at"),
    )


def write_json_ledger(ledger: DataFrame, path: str, store_id: str = "") -> None:
    """The ledger as one JSON file in the layout that ``read_json_ledger`` reads, keys sorted, in place of the file that was there.

    For exchange only: a single file has to be written by a single task, which streams the sorted rows.
    """
    spark = ledger.sparkSession
    row = F.to_json(F.struct("doc_id", "path", "status", "chunk_count", "started_at", "ready_at"))
    first = ledger.agg(F.min("doc_id")).first()[0]
    comma = F.when(F.col("doc_id") == F.lit(first), "").otherwise(",")
    keyed = ledger.withColumn("quoted", F.to_json(F.array("doc_id")))
    key = F.expr("substring(quoted, 2, length(quoted) - 2)")
    docs = keyed.select(F.lit(1).alias("part"), "doc_id", F.concat(comma, key, F.lit(": "), row).alias("line"))
    ends = spark.createDataFrame([(0, "", f'{{"version": 1, "store_id": {json.dumps(store_id)}, "docs": {{'), (2, "", "}}")], "part int, doc_id string, line string")
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    docs.unionByName(ends).orderBy("part", "doc_id").select("line").coalesce(1).write.text(draft)
    jvm = spark._jvm
    hadoop_path, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = hadoop_path(draft).getFileSystem(conf)
    (file,) = [x.getPath() for x in fs.listStatus(hadoop_path(draft)) if x.getPath().getName().startswith("part-")]
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(file, hadoop_path(path), options)
    fs.delete(hadoop_path(draft), True)
