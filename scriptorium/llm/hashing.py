"""Word and shingle hashes of whole Arrow string columns, in numpy.

A column's bytes are read in place. A word is hashed in pieces of eight bytes, A-Z as a-z: each piece goes through a 64-bit
mixer of its own place, the sum and the length through another. So no rule that sums of powers follow (such as words of a few
letters whose polynomials cancel) makes two words equal. A second hash, where asked for, is made from the bytes with other
mixers, not from the first one. Words are split by a set of separator bytes. All separators are below 0x80, so the words equal those of
the regular expressions over code points.

Memory is bounded by the slices: a slice holds whole texts of ``SLICE`` bytes together, or one
larger text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: All bytes below 0x80 but digits and letters.
NOT_ALNUM = bytes(x for x in range(0x80) if not chr(x).isalnum())

_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first row, bytes, offsets into them) of each slice; a null is an empty text."""
    done = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        if not n:
            continue
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield done + at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
        done += n


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return data + ((data - np.uint8(ord("A")) < 26).view(np.uint8) << np.uint8(5))


#: What is left of a piece of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_words(data: np.ndarray, at: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits for each word data[at:end] (not empty), as its bytes are."""
    if not len(at):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = end - at
    total = mix(eight[at] & _MASKS[np.minimum(length, 8)], salt)
    long = np.flatnonzero(length > 8)
    if len(long):
        pieces = (length[long] - 1) // 8  # those after the first
        of = np.repeat(np.arange(len(long)), pieces)
        begin = np.cumsum(pieces) - pieces
        place = np.arange(len(of)) - begin[of] + 1
        from_ = at[long][of] + 8 * place
        value = eight[from_] & _MASKS[np.minimum(end[long][of] - from_, 8)]
        total[long] += np.add.reduceat(mix(mix(value, salt + 1) ^ mix(place.astype(np.uint64), salt + 2), salt + 3), begin)
    return mix(total + length.astype(np.uint64) * np.uint64(_ODD[4]), salt + 4)


class Words:
    """Splits bytes at separators and hashes the words."""

    def __init__(self, separators: bytes = SPACES):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.spaces = set(separators) == set(SPACES)

    def words(self, data: np.ndarray) -> np.ndarray:
        """Which bytes are of words."""
        if self.spaces:  # as the table says, without looking up
            return (data - np.uint8(0x09) > 4) & (data != 0x20)
        return self.is_word[data]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start; a text's start also ends a word."""
        return self.spans(data, offsets)[0]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = self.words(data)
        turns = np.empty(n + 1, bool)
        turns[0], turns[n] = word[0], word[n - 1]
        np.not_equal(word[1:], word[:-1], out=turns[1:n])
        found = np.flatnonzero(turns)
        first, last = found[0::2], found[1::2]
        at = offsets[(offsets > 0) & (offsets < n)]
        at = at[word[at] & word[at - 1]]  # texts that meet within a run
        if len(at):
            at = np.unique(at)
            first, last = (np.sort(np.concatenate([x, at]), kind="stable") for x in (first, last))
        return first, last

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and where each text's words begin among them (one more than texts)."""
        at, end = self.spans(data, offsets)
        return hash_words(lowered(data), at, end), np.searchsorted(at, offsets)

    def twice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As a call, and between its two results the words' second hashes."""
        at, end = self.spans(data, offsets)
        lower = lowered(data)
        return hash_words(lower, at, end), hash_words(lower, at, end, 50), np.searchsorted(at, offsets)


def _rolled(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of so many words."""
    n, odd = len(words), [np.uint64(x) for x in _ODD]
    out = words[: n - size + 1] * odd[0]
    for j in range(1, size):
        out = out + mix(words[j : n - size + 1 + j], salt + j) * odd[j % 5]
    return mix(out, salt)


def _whole(words: np.ndarray, salt: int = 0) -> np.uint64:
    """A hash of a sequence of few words."""
    parts = mix(words ^ mix(np.arange(len(words), dtype=np.uint64), salt + 11), salt + 12)
    return mix(parts.sum(keepdims=True), salt + 100 + len(words))[0]


def shingle_sets(words: np.ndarray, begin: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, and where each text's begin.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    out, _, begin = shingle_pairs(words, None, begin, size)
    return out, begin


def shingle_pairs(words: np.ndarray, second: np.ndarray | None, begin: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with the hashes of the same shingles that the words' second hashes give, if those are given."""
    counts = np.diff(begin)
    own = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    own[short] = 1
    first = np.concatenate([[0], np.cumsum(own)])
    out, more = np.empty(first[-1], np.uint64), np.empty(first[-1] if second is not None else 0, np.uint64)
    rolled = _rolled(words, size) if len(words) >= size else words[:0]
    again = _rolled(second, size, 60) if second is not None and len(words) >= size else words[:0]
    for i in short:
        out[first[i]] = _whole(words[begin[i] : begin[i + 1]])
        if second is not None:
            more[first[i]] = _whole(second[begin[i] : begin[i + 1]], 60)
    keep = np.ones(len(out), bool)
    for i in np.flatnonzero(counts >= size):
        a, b = first[i], first[i + 1]
        part = rolled[begin[i] : begin[i] + b - a]
        if second is None:
            part = np.sort(part)
        else:
            order = np.argsort(part)
            part, more[a:b] = part[order], again[begin[i] : begin[i] + b - a][order]
        out[a:b] = part
        keep[a + 1 : b] = part[1:] != part[:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], more[keep] if second is not None else more, kept[first]


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of each run of values, 0 for an empty one."""
    out = np.zeros(len(begin) - 1, values.dtype)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.add.reduceat(values, begin[:-1][full])
    return out
