"""The entries of one large JSON map, read in byte ranges: {"version": 1, ..., "docs": {key: value, ...}}.

Whether a byte stands in a string, and how deep, depends on all before it. So ranges are gone through twice: first each one tells how many
quotes it has, and how its brackets change the depth if it begins outside of a string and if it begins inside; the driver adds up these
few numbers. Then every range knows where it begins, and gives the entries whose first byte is in it, the last one whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import storage
from scriptorium.functions.cuts import cut

#: Bytes of a range, and of what is read on for its last entry at once.
SPLIT, MORE = 32 << 20, 1 << 20
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]], _DEPTH[[ord("}"), ord("]")]] = 1, -1
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


def _read(uri: str, begin: int, end: int) -> bytes:
    store, path = storage.opened(uri)
    with store.open_input_file(path) as f:
        f.seek(begin)
        return f.read(max(0, end - begin))


def _escaped(uri: str, begin: int) -> bool:
    """Whether an odd number of backslashes stands before a byte."""
    n = 0
    while begin > 0:
        part = _read(uri, max(0, begin - 4096), begin)
        own = len(part) - len(part.rstrip(b"\\"))
        n, begin = n + own, begin - len(part)
        if own < len(part):
            break
    return n % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes that begin or end a string."""
    slash = data == ord("\\")
    if escaped:  # the first byte is spoken for
        slash = slash.copy()
        slash[:1] = False
    found = data == ord('"')
    at = np.flatnonzero(slash)
    if len(at):
        # a backslash counts if the number of those before it in its run is even
        begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        spoken = at[place % 2 == 0] + 1
        found[spoken[spoken < len(data)]] = False
    if escaped and len(found):
        found[0] = False
    return found


def _depths(data: np.ndarray, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it stands outside of strings, and the depth after it."""
    mark = quotes(data, escaped)
    outside = ((np.cumsum(mark) + inside) % 2 == 0) & ~mark
    return outside, depth + np.cumsum(np.where(outside, _DEPTH[data], 0), dtype=np.int64)


def read_entries(spark: SparkSession, path: str, name: str, split: int = SPLIT) -> DataFrame:
    """(text) of each entry, key and value, of the object that is the value of name in the file's top object. A file without that name, and one
    that is empty, has none. Of a text that is no JSON come what its brackets say."""
    uri = storage.qualified(spark, path)
    store, where = storage.opened(uri)
    size = store.get_file_info(where).size or 0
    n = max(1, -(-size // split))
    ranges = spark.range(n).repartition(min(n, spark.sparkContext.defaultParallelism * 8))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                data = np.frombuffer(_read(uri, k * split, min(size, (k + 1) * split)), np.uint8)
                mark = quotes(data, _escaped(uri, k * split))
                odd = np.cumsum(mark) % 2 == 1
                change = np.where(mark, 0, _DEPTH[data]).astype(np.int64)
                rows.append((k, int(mark.sum()) % 2, int(change[~odd].sum()), int(change[odd].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["k", "flip", "outside", "inside"])

    starts, inside, depth = [], 0, 0
    for _, flip, outside_first, inside_first in sorted(map(tuple, ranges.mapInArrow(summed, "k long, flip long, outside long, inside long").collect())):
        starts.append((inside, depth))
        depth += inside_first if inside else outside_first
        inside ^= flip

    def rest(k: int) -> bytes:
        """What is left, beyond range k, of the entry that it ends in."""
        out, at = b"", (k + 1) * split
        inside, depth = starts[k + 1] if k + 1 < len(starts) else (0, 0)
        while at < size:
            raw = _read(uri, at, min(size, at + MORE))
            part, escaped = np.frombuffer(raw, np.uint8), _escaped(uri, at)
            outside, deep = _depths(part, escaped, inside, depth)
            end = np.flatnonzero(_ends(part, outside, deep))
            if len(end):
                return out + raw[: end[0]]
            out, at, depth = out + raw, at + len(raw), int(deep[-1])
            inside = (inside + int(quotes(part, escaped).sum())) % 2
        return out

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k, opened, name, text): the range, how many objects at depth 2 it opened so far, and the name of one or the text of an entry."""
        for batch in batches:
            for k in batch.column(0).to_pylist():
                begin = k * split
                raw = _read(uri, begin, min(size, begin + split))
                data = np.frombuffer(raw, np.uint8)
                outside, deep = _depths(data, _escaped(uri, begin), *starts[k])
                opens = outside & (data == ord("{")) & (deep == 2)
                marks = np.flatnonzero(opens | _ends(data, outside, deep))
                rows: list[tuple] = []
                opened = 0
                # what stands before the first mark ends an entry of an earlier range
                for i, at in enumerate(marks.tolist()):
                    if opens[at]:
                        opened += 1
                        before = _NAME.search(_read(uri, max(0, begin + at - 4096), begin + at))
                        rows.append((k, opened, json.loads(b'"' + before[1] + b'"') if before else "", None))
                    elif data[at] == ord("}"):
                        continue
                    text = raw[at + 1 : marks[i + 1]] if i + 1 < len(marks) else raw[at + 1 :] + rest(k)
                    if text.strip():
                        rows.append((k, opened, None, text.decode()))
                    if len(rows) >= 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    rows = cut(ranges.mapInArrow(found, "k long, opened int, name string, text string"), "entries")
    opened = rows.filter("name is not null").select(F.struct("k", "opened").alias("at"), "name")
    first = opened.filter(F.col("name") == name).agg(F.min("at")).first()[0]
    if first is None:
        return rows.limit(0).select("text")
    here = F.struct(F.lit(first[0]).cast("long").alias("k"), F.lit(first[1]).cast("int").alias("opened"))
    after = opened.filter(F.col("at") > here).agg(F.min("at")).first()[0]
    own = ((F.col("k") == first[0]) & (F.col("opened") == first[1])) | ((F.col("k") > first[0]) & (F.col("opened") == 0))
    return rows.filter("text is not null").filter(own & (F.lit(True) if after is None else F.col("k") <= after[0])).select("text")


def _ends(data: np.ndarray, outside: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """Where entries at depth 2 end."""
    return outside & (((data == ord(",")) & (deep == 2)) | ((data == ord("}")) & (deep == 1)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["k", "opened", "name", "text"])
