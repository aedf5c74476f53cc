"""Cut a plan's lineage with a table in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths of tables that go at the end of the innermost ``scratch``.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end, so what is returned from inside must be cut by ``keep``."""
    before = _passing.set([])
    try:
        yield
    finally:
        paths = _passing.get()
        _passing.reset(before)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """df as a table that outlives every ``scratch`` around."""
    token = _passing.set(None)
    try:
        return cut(df, name)
    finally:
        _passing.reset(token)


#: Rows that go to a Python worker at once while a table is cut; of long texts, Spark's 10,000 fill a worker's memory.
ARROW_ROWS, _ARROW = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Parquet reader holds at once.
_READ = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, read: bool = False) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside, and with read (for rows of some 100 kB) batches of Parquet's reader
    too; the session's own settings come back after it."""
    before = {key: spark.conf.get(key) for key in (_ARROW, _READ)[: 1 + read]}
    for key, value in before.items():
        spark.conf.set(key, str(min(int(value), rows) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back.

    The files outlive any executor, so a lost one costs the running stage only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a few short columns that may be broadcast (some 40 MB).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count finds at most so many rows; any larger df is left to a shuffled join."""
    return df if df.limit(most + 1).count() > most else F.broadcast(df)
