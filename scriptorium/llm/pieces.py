"""SentencePiece encoding and decoding by a table of distinct chunks.

White space is marked: a text is prefixed by one marker and its spaces become markers. Where no piece of
the vocabulary holds a marker after another character, no piece crosses from one marked word (its markers,
then its characters) to the next, and merges in one word do not depend on another. So each distinct marked
word is segmented once, with what it decodes to, and a text's ids are the table's rows joined by the places
of its words. Most words decode to themselves, so the table holds what a word decodes to only where it is
another. A task keeps one table for its texts; it is emptied at a bounded size, which costs time only.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.cuts import keep
from scriptorium.llm.batches import text_slices

MARKER = "▁"
#: Characters of chunks in a task's table before it is emptied.
TABLE_CHARS = 4 << 20
#: Chunks given to the library at a time.
CHUNKS = 4096
_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")


class ChunkTable:
    """Distinct marked words with their ids (as bytes of int32), and what they decode to where that is not the word with spaces for markers."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(re.search(f"[^{MARKER}]{MARKER}", x) for x in pieces):
            raise ValueError("pieces of this model cross white space: a word's segmentation depends on its neighbours")
        if self.library.normalize(" ﬁ  x ") != f"{MARKER * 2}ﬁ{MARKER * 2}x{MARKER}":
            raise ValueError("this model rewrites texts or white space before it segments them")
        self.anchor = self.library.piece_to_id("a")
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.chars = 0

    def add(self, chunks: set[str]) -> None:
        """Segments the chunks that the table lacks."""
        new = sorted(x for x in chunks if x not in self.ids)
        for at in range(0, len(new), CHUNKS):
            part = new[at : at + CHUNKS]
            # the library puts a marker before each text
            found = self.library.encode([x[1:] if len(x) > 1 else x for x in part], num_threads=1)
            for k, x in enumerate(part):
                if len(x) == 1:  # one marker; by itself the library would take it for two
                    found[k] = [self.library.piece_to_id(MARKER)]
            back = self.library.decode([[self.anchor, *x] for x in found], num_threads=1)
            for x, ids, text in zip(part, found, back, strict=True):
                self.ids[x] = array("i", ids).tobytes()
                if text[1:] != x.replace(MARKER, " "):
                    self.decoded[x] = text[1:]
                self.chars += len(x)

    def __call__(self, text: str) -> tuple[bytes, str]:
        """A whole text's ids and what they decode to."""
        if not text:
            return b"", ""
        chunks = _CHUNK.findall(MARKER + text.replace(" ", MARKER))
        if self.chars > TABLE_CHARS:
            self.ids.clear()
            self.decoded.clear()
            self.chars = 0
        self.add(set(chunks))
        ids = b"".join(map(self.ids.__getitem__, chunks))
        if not self.decoded or self.decoded.keys().isdisjoint(chunks):
            return ids, text.replace(MARKER, " ")
        return ids, "".join(self.decoded.get(x, x.replace(MARKER, " ")) for x in chunks)[1:]


def encode_and_decode(docs: DataFrame, model: str, text: str = "text", end: bool = True) -> DataFrame:
    """docs' columns but a former ``ids`` or ``decoded``, and two more: ids (array<int>) of the whole text, and
    decoded, the text that the ids decode to.

    model is the path of a sentencepiece model, the same on every machine. ids equal the library's ``encode`` with,
    if end, the end id last; decoded equals its ``decode`` of them. A null text is taken as empty: the end id alone,
    decoded to the empty text. Repeated rows are encoded like any others; other columns pass through as they are.
    """
    kept = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        last = array("i", [table.library.eos_id()]).tobytes() if end else b""
        for part in text_slices(batches, text):
            ids, decoded = [], []
            for x in part.column(text).to_pylist():
                found, back = table(x or "")
                ids.append(found + last)
                decoded.append(back)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())], [*part.schema.names, "ids", "decoded"])

    return kept.mapInArrow(run, f"{_ddl(kept)}, ids array<int>, decoded string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs, as a table; so few texts at a time go to a Python worker."""
    found = encode_and_decode(docs.select("doc_id", "text"), model)
    rows = found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return keep(rows, "digests")
