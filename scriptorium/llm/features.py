"""Feature tables of whole Arrow text columns, in numpy, for the models trained here."""

from __future__ import annotations

import numpy as np

from scriptorium.llm.hashing import mix, sums

#: Bytes that separate words for subwords: all below 0x80 but letters.
_LETTER = np.array([chr(x).isalpha() or x >= 0x80 for x in range(256)])


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int, orders: tuple[int, ...] = (1, 2, 3, 4)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed subwords of all texts, for each order: bucket of each, and where each text's begin.

    A subword is a run of so many bytes inside a word, which may take in the boundary before and after it. data is
    lower case UTF-8. Bytes that are not letters are boundaries, so digits and signs tell nothing.
    """
    n = len(data)
    if not n:
        return []
    letter = _LETTER[data]
    codes = np.where(letter, data, 0).astype(np.uint64)
    found = []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for k in orders:
        m = n - k + 1
        if m < 1:
            continue
        value = np.full(m, k, np.uint64)
        for j in range(k):
            value = value * np.uint64(257) + codes[j : j + m]
        inner = letter[:m] | letter[k - 1 :]
        for j in range(1, k - 1):
            inner &= letter[j : j + m]
        at = np.flatnonzero(inner & (np.arange(k, n + 1) <= ends[:m]))  # none reaches into the next text
        found.append(((mix(value[at]) & np.uint64(buckets - 1)).astype(np.int64), np.searchsorted(at, offsets)))
    return found


def byte_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's shares of: every sign of ASCII, digits, capitals, small letters, bytes over 0x7F, spaces, newlines."""
    signs = [x for x in range(0x21, 0x7F) if not chr(x).isalnum()]
    kind = np.full(256, len(signs) + 5, np.int64)
    kind[signs] = np.arange(len(signs))
    for k, of in enumerate(("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")):
        kind[[ord(c) for c in of]] = len(signs) + k
    kind[128:], kind[0x20] = len(signs) + 3, len(signs) + 4
    width, n = len(signs) + 6, np.diff(offsets)
    cell = np.repeat(np.arange(len(n)) * width, n) + kind[data]
    return np.bincount(cell, minlength=len(n) * width).reshape(len(n), width) / np.maximum(n, 1)[:, None]


def repeats(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each text's share of words equal to the one before, of words that occurred before, and of three-word runs that did."""
    n = np.diff(begin)
    of = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), 3))
    if not len(words):
        return out
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    runs = words + mix(np.roll(words, -1), 21) + mix(np.roll(words, -2), 22)
    has = np.zeros(len(words), bool)
    has[:-2] = of[2:] == of[:-2]
    for j, (values, which) in enumerate(((words, np.ones(len(words), bool)), (runs, has))):
        total = np.bincount(of[which], minlength=len(n))
        key = np.unique(mix(values[which], 23) + mix(of[which].astype(np.uint64), 24), return_index=True)[1]
        distinct = np.bincount(of[which][key], minlength=len(n))
        out[:, j + 1] = (total - distinct) / np.maximum(total, 1)
    out[:, 0] = sums(same.astype(np.float64), begin) / np.maximum(n, 1)
    return out
