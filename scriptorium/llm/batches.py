"""Arrow batches cut into slices of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a slice holds together; a larger single text is a slice of its own.
SLICE = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, in slices of whole rows whose texts hold at most so many bytes, or of one row."""
    for batch in batches:
        n = len(batch)
        lengths = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at, before = 0, 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at, before = end, int(ends[end - 1])
