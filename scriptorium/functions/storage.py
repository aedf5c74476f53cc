"""Files of any store that Hadoop names, opened from tasks by pyarrow (local and mounted folders, HDFS, S3, GCS)."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of its store, by the cluster's settings; for the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path within it; for any process."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if ":" not in uri.split("/", 1)[0]:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_new(store: fs.FileSystem, path: str, text: str) -> bool:
    """Writes a small file whole, unless it is there: false then. For any process."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(text.encode())
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(draft, path)  # unlike a rename, never over another
        elif store.get_file_info(path).type != fs.FileType.NotFound:
            return False
        else:
            store.move(draft, path)  # HDFS refuses to rename over another
            return True
    except FileExistsError:
        return False
    finally:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all in it, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder; fails if the target is there."""
    jvm = spark._jvm
    before, after = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = after.getFileSystem(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(before), files.makeQualified(after), options)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
