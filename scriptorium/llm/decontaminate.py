"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are reduced to words of letters and digits in lower case, one space apart. An item of n characters may
be found with k = n // 12 edits, but one of few words and few characters only exactly and as whole words. An item is cut into k + 1 pieces; k edits leave one of them whole, so every place of the item
has an exact hit of a piece (found for all pieces at once by an Aho-Corasick automaton), at a place that is off by k
at most. The windows around an item's hits, merged where they meet, are verified by Myers' bit-parallel edit distance ("A Fast Bit-Vector Algorithm for
Approximate String Matching Based on Dynamic Programming", 1999).
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, keep, scratch
from scriptorium.llm.batches import text_slices
from scriptorium.llm.hashing import NOT_ALNUM, slices

#: Characters of an item for each edit that it may have, and the words an item needs to take part.
PER_EDIT, LEAST_WORDS = 12, 5
#: Items of fewer words than FEW_WORDS are short if they have fewer characters than this; they are found without edits, as whole words.
FEW_WORDS, SHORT = 5, 24
#: Characters of items that are searched for in one pass over the documents; more items make more passes.
PASS_CHARS = 4 << 20
#: Stretches whose places a task remembers.
REMEMBERED = 1 << 14

#: Blocks of scripts that are written without spaces: Thai to Tibetan, Myanmar, Khmer, kana and Han with their extensions.
_UNSPACED = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]

_SPACE = np.isin(np.arange(256), list(NOT_ALNUM))


def normalized(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Words of letters and digits, one space apart. data is lower case already."""
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = np.where(space, 0x20, data)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return [out[a:b].tobytes().decode().strip() for a, b in zip(at[:-1], at[1:], strict=True)]


def edits(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of m characters (as a bit set for each character) to a part of text, and where the first such part ends."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = pattern.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        more = down | ~(horizontal | up)
        less = up & horizontal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        more, less = more << 1, less << 1
        up = (less | ~(vertical | more)) & mask
        down = more & vertical & mask
    return best, end


def bit_sets(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def joined(a: str, b: str) -> bool:
    """Whether two neighbours are of one word: letters, digits and marks are, but for those of scripts without spaces (whose marks still belong to the letter before)."""
    x, y = unicodedata.category(a)[0], unicodedata.category(b)[0]
    if x not in "LNM" or y not in "LNM":
        return False
    return y == "M" or not any(low <= ord(c) <= high for c in (a, b) for low, high in _UNSPACED)


class Finder:
    """Finds items in normalized texts."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int):
        self.short = [len(text) < SHORT and text.count(" ") < FEW_WORDS - 1 for _, text in items]
        self.items = [(key, text, 0 if short else len(text) // per_edit, bit_sets(text), bit_sets(text[::-1])) for (key, text), short in zip(items, self.short, strict=True)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k, _, _) in enumerate(self.items):
            edges = [j * len(text) // (k + 1) for j in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int, int]] = {}

    def __call__(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found: (edits, characters before the place, its length), the first of those with fewest edits.

        The windows around an item's hits are merged where they meet, and each stretch is gone through once, so time is that
        of the text, however often a piece repeats.
        """
        found: dict[int, tuple[int, int, int]] = {}
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for i, offset in where:
                _, item, k, _, _ = self.items[i]
                begin = end + 1 - length - offset
                if self.short[i]:  # hits come in order of their ends, so the first place is the first hit
                    if i not in found and not (begin and joined(text[begin - 1], item[0])) and not (end + 1 < len(text) and joined(item[-1], text[end + 1])):
                        found[i] = (0, begin, len(item))
                    continue
                a, b = max(0, begin - k), min(len(text), begin + len(item) + k)
                own = stretches.setdefault(i, [])
                if own and a <= own[-1][1] and own[-1][0] <= b:
                    own[-1][0], own[-1][1] = min(a, own[-1][0]), max(b, own[-1][1])
                else:
                    own.append([a, b])
        for i, own in stretches.items():
            merged: list[list[int]] = []
            for a, b in sorted(own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            k, best = self.items[i][2], None
            for a, b in merged:
                if b - a >= len(self.items[i][1]) - k:
                    distance, start, size = self._place(i, text[a:b])
                    if distance <= k and (best is None or distance < best[0]):
                        best = (distance, a + start, size)
            if best:
                found[i] = best
        return {self.items[i][0]: x for i, x in found.items()}

    def _place(self, i: int, stretch: str) -> tuple[int, int, int]:
        """The fewest edits of an item in a stretch, and the start and length of the first place that has them."""
        _, item, k, bits, back = self.items[i]
        short = len(stretch) <= 4 * len(item)
        if short and (i, stretch) in self.seen:
            return self.seen[i, stretch]
        distance, stop = edits(bits, len(item), stretch)
        size = edits(back, len(item), stretch[max(0, stop - len(item) - k) : stop][::-1])[1] if distance <= k else 0
        if short:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[i, stretch] = (distance, stop - size, size)
        return distance, stop - size, size


def _passes(benchmark: DataFrame, least_words: int, chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; one at a time is with the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            for first, data, offsets in slices(part.column("text")):
                texts = normalized(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("item_id").slice(first, len(texts)), pa.array(texts, pa.string())], ["item_id", "text"])

    usable = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    items = usable.mapInArrow(run, "item_id long, text string").filter(F.size(F.split("text", " ")) >= least_words)
    block, size = [], 0
    for row in cut(items.distinct(), "items").toLocalIterator():
        if block and size + len(row[1]) > chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT, least_words: int = LEAST_WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, edits, first_word and n_words of the best place.

    docs has doc_id (integer) and text, benchmark has item_id (integer) and text; other columns are ignored, and so are
    rows with a null among these. Items of fewer than ``least_words`` words take no part; with 1, all that have a letter or digit
    do. Of those of fewer than FEW_WORDS words, the ones of fewer than SHORT characters must stand exactly and as whole words. Words are runs of letters and
    digits, counted from 0. Items with equal texts are all found; rows with equal doc_id and item_id count as one
    document and one item, with the fewest edits. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        return keep(_leaks(docs, benchmark, per_edit, least_words, pass_chars), "leaks")


def _leaks(docs: DataFrame, benchmark: DataFrame, per_edit: int, least_words: int, pass_chars: int) -> DataFrame:
    usable = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    names = ["doc_id", "item_id", "edits", "first_word", "n_words"]

    def one_pass(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, per_edit)
            for part in text_slices(batches):
                rows = []
                for first, data, offsets in slices(part.column("text")):
                    for i, text in enumerate(normalized(data, offsets)):
                        for item, (n, at, size) in finder(text).items():
                            rows.append((first + i, item, n, text.count(" ", 0, at), len(text[at : at + size].split())))
                if rows:
                    row, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(c, pa.int64()) for c in rest)], names)

        return usable.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, n_words long")

    found = None
    for items in _passes(benchmark, least_words, pass_chars):
        now = cut(one_pass(items), "leaks")
        found = now if found is None else found.unionByName(now)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, first_word long, n_words long")
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "first_word", "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits: int) -> DataFrame:
    """docs' rows, all columns kept, without the documents in which ``leaks`` finds an item. Rows with a null text or doc_id stay."""
    mark = "__" + uuid.uuid4().hex  # no column of docs has that name
    bad = leaks(docs, benchmark, **limits).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(bad, docs.doc_id.cast("long") == F.col(mark), "left_anti")
