"""Bloom filters of ids, so that a scan of texts passes on no more than the rows a join needs, however many those are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.hashing import mix, signed

#: Bits for each id, hashes of an id, and the logarithms of the least and most bits (8 KB and 32 MB whatever the input).
SPARE, HASHES, LEAST, MOST = 16, 4, 16, 28


def _places(ids: np.ndarray, log_bits: int) -> np.ndarray:
    """HASHES places for each id, one row an id."""
    own = ids.view(np.uint64)[:, None]
    return np.concatenate([mix(own, 40 + k) for k in range(HASHES)], axis=1) >> np.uint64(64 - log_bits)


class Bloom:
    """Says of an id that it may be in the set, or that it is not."""

    def __init__(self, words: np.ndarray):
        self.words, self.log_bits = words, int(len(words) * 64).bit_length() - 1

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = _places(np.ascontiguousarray(ids, np.int64), self.log_bits)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def bloom(ids: DataFrame, column: str | Column) -> Bloom:
    """The filter of a column of longs; nulls are no ids. Its words are merged by groups; only they reach the driver."""
    ids = ids.select(F.col(column).alias("id") if isinstance(column, str) else column.alias("id")).filter("id is not null")
    log_bits = min(MOST, max(LEAST, (SPARE * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), log_bits).ravel()
            word, first = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, first, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), signed(bits)], ["word", "bits"])

    got = ids.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << log_bits) // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Bloom(words)
