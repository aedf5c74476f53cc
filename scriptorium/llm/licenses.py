"""License scans: exact set-similarity search for blocks of text that contain most of a license template.

Words are runs of letters and digits, A-Z as a-z; a template and a block are sets of words. A block in which a template
finds the share CONTAINMENT of its own words or more gets the template's label. The templates' words are ordered by
their frequency in all documents, rarest first; a block's other words are of no use to any template and are passed over. Of a
template of n words that needs o of them, a block must hold one of the first n - o + 1 (prefix filter), and hold o words
of templates at all (length filter); and if the first of them that it holds is number p of the template and number q of the
block's own, both must have o words from there on (positional filter). What is left is counted out.

A block is a line. With ``wrapped`` it is also every run of as many consecutive words as the template has, wherever lines
end, so notices and whole license texts of many lines are found; words are looked at around those of the prefix only.

Phrases are found besides: places where their words stand consecutively.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.batches import text_slices
from scriptorium.llm.hashing import NOT_ALNUM, Words, slices

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Whole texts of short licenses, and notices of long ones.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details.""",
}
#: Templates, (label, words of a notice), and the texts. Parameters of the scan; their number is what bounds its tables.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
    *((label, " ".join(re.findall("[a-z0-9]+", text.lower()))) for label, text in TEXTS.items()),
]
CONTAINMENT = 0.8
#: Places of words that are held at once while runs of words are counted.
PLACES = 1 << 20


def word_hashes(words: Words, phrase: str) -> np.ndarray:
    data = np.frombuffer(phrase.encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def frequencies(docs: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """How often each of the hashed tokens occurs in all texts; one row a task for each token that it has."""
    tokens = np.unique(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(NOT_ALNUM), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                hashes, _ = words(data, offsets)
                at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                total += np.bincount(at[tokens[at] == hashes], minlength=len(tokens))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {int(tokens[t]): n for t, n in counted.collect()}


class Scan:
    """Finds phrases and contained templates in slices of texts."""

    def __init__(self, counts: dict[int, int], phrases: dict[str, str], templates: list[tuple[str, str]], containment: float, wrapped: bool = False):
        self.wrapped = wrapped
        self.words, self.newline = Words(NOT_ALNUM), 10
        self.phrases = [(label, word_hashes(self.words, p)) for p, label in phrases.items()]
        hashed = [word_hashes(self.words, text) for _, text in templates]
        everything = sorted({int(h) for x in hashed for h in x}, key=lambda h: (counts.get(h, 0), h))
        #: The templates' words by hash, and their numbers in the common order.
        self.vocabulary = np.array(sorted(everything), np.uint64)
        self.rank = np.empty(len(everything), np.int64)
        self.rank[np.searchsorted(self.vocabulary, np.array(everything, np.uint64))] = np.arange(len(everything))
        self.templates = []  # label, numbers of its words in order, words that it needs, words of the text
        for (label, _), words in zip(templates, hashed, strict=True):
            own = np.unique(self.ranks(words))
            self.templates.append((label, own, max(1, math.ceil(containment * len(own) - 1e-9)), len(words)))
        self.is_first = np.zeros(len(everything) + 1, bool)
        for _, own, need, _ in self.templates:
            self.is_first[own[: len(own) - need + 1]] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers in the common order, -1 for words of no template."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.rank[at], -1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """For each text: (words, places, first place, last place, labels of phrases, all labels, score)."""
        hashes, begin = self.words(data, offsets)
        n = np.diff(begin)
        places: list[list[int]] = [[] for _ in n]
        base: list[set[str]] = [set() for _ in n]
        for label, phrase in self.phrases:
            last = len(hashes) - len(phrase) + 1
            if last < 1:
                continue
            hit = np.ones(last, bool)
            for j, h in enumerate(phrase):
                hit &= hashes[j : j + last] == h
            at = np.flatnonzero(hit)
            row = np.searchsorted(begin, at, side="right") - 1
            for a, i in zip(at, row, strict=True):
                if a + len(phrase) <= begin[i + 1]:
                    places[i].append(int(a - begin[i]))
                    base[i].add(label)
        found: list[dict[str, float]] = [dict.fromkeys(x, 1.0) for x in base]
        for i, label, score in self.contained(data, offsets, hashes, begin):
            found[i][label] = max(score, found[i].get(label, 0))
        return [
            (int(k), len(p), min(p, default=None), max(p, default=None), ",".join(sorted(b)), ",".join(sorted(f)), max(f.values(), default=0.0))
            for k, p, b, f in zip(n, places, base, found, strict=True)
        ]

    def contained(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, str, float]]:
        ranks = self.ranks(hashes)
        hit = np.flatnonzero(self.is_first[ranks])  # the last entry, for -1, is false
        if not len(hit):
            return
        starts = self.words.starts(data, offsets)
        newlines = np.flatnonzero(data == self.newline)
        blocks = np.unique(np.concatenate([offsets, newlines + 1]))
        edge = np.searchsorted(starts, blocks)  # the word with which each block begins
        for block in np.unique(np.searchsorted(edge, hit, side="right") - 1):
            own = np.unique(ranks[edge[block] : edge[block + 1] if block + 1 < len(edge) else len(hashes)])
            own = own[own >= 0]
            row = int(np.searchsorted(begin, edge[block], side="right")) - 1
            for label, template, need, _ in self.templates:
                if len(own) < need:
                    continue
                first = np.isin(own, template[: len(template) - need + 1])
                q = int(first.argmax())
                if not first[q] or min(len(own) - q, len(template) - int(np.searchsorted(template, own[q]))) < need:
                    continue
                shared = int(np.isin(template, own[q:]).sum())
                if shared >= need:
                    yield row, label, shared / len(template)
        if self.wrapped:
            yield from self.runs(ranks, begin, hit)

    def runs(self, ranks: np.ndarray, begin: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """The texts in which a run of as many words as a template has contains it. hit are the places of all templates' first words."""
        for label, template, need, size in self.templates:
            own = hit[np.isin(ranks[hit], template[: len(template) - need + 1])]
            around = np.arange(1 - size, size)
            step = max(1, PLACES // len(around)) if size else 1
            for at in (own[k : k + step] for k in range(0, len(own), step)):
                row = np.searchsorted(begin, at, side="right") - 1
                place = at[:, None] + around
                inside = (place >= begin[row][:, None]) & (place < begin[row + 1][:, None])
                word = ranks[np.clip(place, 0, len(ranks) - 1)]
                number = np.minimum(np.searchsorted(template, word), len(template) - 1)
                inside &= template[number] == word
                # around too few words of the template, no run has enough
                some = inside.sum(axis=1) >= need
                row, inside, number = row[some], inside[some], number[some]
                shared = np.zeros((len(row), size), np.int64)
                for first in range(0, len(template), 64):  # a bit for each word of the template, 64 at a time
                    lane = inside & (number >= first) & (number < first + 64)
                    bits = np.where(lane, np.uint64(1) << ((number - first) & 63).astype(np.uint64), np.uint64(0))
                    done = 1
                    while done < size:  # bits of runs of ``done`` words
                        more = min(done, size - done)
                        bits = bits[:, : bits.shape[1] - more] | bits[:, more:]
                        done += more
                    shared += np.bitwise_count(bits)
                most = shared.max(axis=1, initial=0)
                for i in np.flatnonzero(most >= need):
                    yield int(row[i]), label, int(most[i]) / len(template)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, wrapped: bool = False
) -> DataFrame:
    """docs' columns, and (which replace any of those names) n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are their least and largest start (words from 0;
    null without a place). base_labels are the phrases' labels, labels those and the templates', distinct, sorted and
    joined by commas (empty if none); score is the largest containment found, 1 for a phrase, 0 for none. A null text
    is an empty one. Whole texts are scanned; repeated rows get equal results.
    A block is a line; with ``wrapped`` notices that go over line ends are found too.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = docs.drop(*new)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    tool = Words(NOT_ALNUM)
    counts = frequencies(docs, np.concatenate([word_hashes(tool, t) for _, t in templates])) if templates else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(counts, phrases, templates, containment, wrapped)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for part in text_slices(batches):
            rows = [x for _, data, offsets in slices(part.column("text")) for x in scan(data, offsets)]
            if rows:
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*part.schema.names, *new])

    return kept.mapInArrow(run, f"{schema}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
