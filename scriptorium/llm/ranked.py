"""Ranked lexical search over a clustered index in an order made by recursive graph bisection (Dhulipala et al., "Compressing Graphs and
Indexes with Recursive Graph Bisection", 2016; Mackenzie, Petri and Moffat, "Anytime Ranking on Document-Ordered Indexes", 2022).

Documents are reordered so that those with common terms are neighbours. Bisection halves a set of documents, then swaps documents
between the halves as long as the logarithmic cost of the terms' gaps falls, and does the same with each half. The upper levels are
fitted on a sample of bounded size; every document goes down that tree to the half where its terms cost less. The documents of a leaf
are dealt to blocks of BLOCK_BYTES, and each block is bisected in full, down to clusters of at most CLUSTER documents.

A cluster is a row of the index: its documents, its terms with the largest impact of each, and the postings. For a query, the sum
of the largest impacts by weight bounds the scores in a cluster. The clusters with the highest bounds are visited first, and their kth best score
is the threshold for all others: a cluster is passed over only if its bound is under the threshold, or equal to it with no document that
ties would prefer. Tasks raise the thresholds as they go through their clusters, those with high bounds first. So results are
exact. Positions are mapped back to doc_id, which decides ties.

Scores are integers, as is the impact of a term that stands tf times in a document of n terms: 10^9 tf / (1000 tf + 8 m), where m is
25 + 75 n / mean n, all rounded down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, keep, scratch, small_batches
from scriptorium.llm.batches import text_slices
from scriptorium.llm.graphs import small
from scriptorium.llm.hashing import NOT_ALNUM, Words, lowered, slices

#: Documents and bytes of the sample on which the upper levels are fitted, and the number of those levels.
SAMPLE, SAMPLE_BYTES, LEVELS = 2048, 8 << 20, 5
#: Bytes of texts of a block, most documents of a cluster, rounds of swaps at a level.
BLOCK_BYTES, CLUSTER, ROUNDS = 4 << 20, 64, 4
#: Clusters that a query visits first, characters of items in a pass, and shares of the lists that are merged at the end.
WAVE, PASS_CHARS, SHARES = 4, 4 << 20, 64
#: Terms of queries that are scored together, and clusters (some 200 kB each) that are read and go to a Python worker at once.
TERMS_AT_ONCE, CLUSTERS_AT_ONCE = 1 << 15, 16


def split_terms(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The terms of texts in lower case, and the number of each term's text."""
    at, end = words.spans(data, offsets)
    before = np.concatenate([[0], np.cumsum(end - at)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(before), pa.py_buffer(lowered(data[words.is_word[data]]))])
    return found, np.searchsorted(offsets, at, side="right") - 1


def postings(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs, sorted, and how often each occurs."""
    key, count = np.unique(text.astype(np.int64) << 32 | term, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def _cost(degree: np.ndarray, n: np.ndarray) -> np.ndarray:
    return degree * np.log2(n / (degree + 1.0))


def bisected(doc: np.ndarray, term: np.ndarray, n: int, levels: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The group of each of n documents after so many levels, and for each level the terms' degrees (group, half, term), the halves' sizes, and the terms.

    doc and term are the distinct pairs. Terms of one document, and of all, tell nothing and are left out.
    """
    degree = np.bincount(term, minlength=int(term.max(initial=-1)) + 1)
    telling = (degree > 1) & (degree < n)
    number = np.cumsum(telling) - 1
    used = telling[term]
    doc, term, terms = doc[used], number[term[used]], np.flatnonzero(telling)
    size = len(terms)
    group, fitted = np.zeros(n, np.int64), []
    for level in range(levels):
        groups = 1 << level
        order = np.argsort(group, kind="stable")
        counts = np.bincount(group, minlength=groups)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        half = (place >= (counts[group] + 1) // 2).astype(np.int64)
        sizes = np.maximum(np.bincount(group * 2 + half, minlength=2 * groups).reshape(-1, 2), 1)
        for _ in range(rounds):
            degrees = np.bincount((group[doc] * 2 + half[doc]) * size + term, minlength=2 * groups * size).reshape(groups, 2, size).astype(float)
            here, there = degrees, degrees[:, ::-1]
            n_here, n_there = sizes[:, :, None].astype(float), sizes[:, ::-1, None].astype(float)
            less = _cost(here, n_here) + _cost(there, n_there) - _cost(np.maximum(here - 1, 0), n_here) - _cost(there + 1, n_there)
            gain = np.bincount(doc, less[group[doc], half[doc], term], minlength=n) if len(doc) else np.zeros(n)
            ranked = np.lexsort((-gain, half, group))
            begin = np.concatenate([[0], np.cumsum(np.bincount(group * 2 + half, minlength=2 * groups))])
            moved = 0
            for g in range(groups):
                left, right = ranked[begin[2 * g] : begin[2 * g + 1]], ranked[begin[2 * g + 1] : begin[2 * g + 2]]
                pairs = min(len(left), len(right))
                swap = gain[left[:pairs]] + gain[right[:pairs]] > 1e-9
                half[left[:pairs][swap]], half[right[:pairs][swap]] = 1, 0
                moved += int(swap.sum())
            if not moved:
                break
        degrees = np.bincount((group[doc] * 2 + half[doc]) * size + term, minlength=2 * groups * size).reshape(groups, 2, size)
        fitted.append((degrees, sizes, terms))
        group = group * 2 + half
    return group, fitted


@dataclass(frozen=True)
class Tree:
    """The upper levels: for each node (level by level) what a term says for its left half."""

    terms: pa.Array
    weights: np.ndarray
    levels: int

    def leaves(self, terms: pa.Array, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n texts; text and term are the distinct pairs, term a number in terms."""
        node = np.zeros(n, np.int64)
        if not self.levels or not len(terms):
            return node
        known = pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy()[term]
        text, known = text[known >= 0], known[known >= 0]
        for level in range(self.levels):
            first = (1 << level) - 1
            score = np.bincount(text, self.weights[first + node[text], known], minlength=n) if len(text) else np.zeros(n)
            node = node * 2 + (score < 0)
        return node


def fit_tree(texts: pa.Array, levels: int = LEVELS) -> Tree:
    (_, data, offsets), *_ = slices(texts, 1 << 62) if len(texts) else [(0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    terms, text = split_terms(Words(NOT_ALNUM), data, offsets)
    coded = terms.dictionary_encode()
    doc, term, _ = postings(text, coded.indices.to_numpy())
    levels = min(levels, max(0, len(texts).bit_length() - 5))
    _, fitted = bisected(doc, term, max(1, len(texts)), levels)
    if not fitted:
        return Tree(coded.dictionary[:0], np.zeros((0, 0), np.float32), 0)
    weights = [np.log2((d[:, 0] + 1) / s[:, :1]) - np.log2((d[:, 1] + 1) / s[:, 1:]) for d, s, _ in fitted]
    return Tree(coded.dictionary.take(pa.array(fitted[0][2])), np.concatenate(weights).astype(np.float32), levels)


@dataclass(frozen=True)
class Index:
    """Clusters (INDEX), the documents with terms, and the terms of all."""

    clusters: DataFrame
    documents: int
    terms: int


INDEX = "cluster long, least_doc long, docs binary, term_ends binary, term_bytes binary, best binary, begin binary, of binary, impact binary"


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The impact of each posting: tf times in a document of n terms."""
    if 75 * int(n.max(initial=0)) * documents < 1 << 63:
        m = 25 + 75 * n.astype(np.int64) * documents // terms
    else:
        m = np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, sample: int = SAMPLE, levels: int = LEVELS, block_bytes: int = BLOCK_BYTES, most: int = CLUSTER) -> Index:
    """Indexes the rows of docs (doc_id, text); other columns are ignored. Rows without doc_id or terms have no part; repeated rows count each.

    sample: documents on which the upper levels are fitted (about so many, and SAMPLE_BYTES at most on average, chosen by the hash of a row).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text <> ''")
    hashed = F.xxhash64("doc_id", "text")
    size, distinct = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.approx_count_distinct(hashed)).first()
    share = min(1.0, sample / max(1, distinct), SAMPLE_BYTES / max(1, size))
    chosen = rows.withColumn("h", hashed).filter(F.shiftrightunsigned("h", 11) <= F.lit(int(share * (1 << 53)))).groupBy("h").agg(F.min("text").alias("text"))
    tree = fit_tree(chosen.select("h", "text").toArrow().sort_by("h").column("text").combine_chunks(), levels)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Slices of rows with their terms, distinct pairs and counts, and leaves."""
        words = Words(NOT_ALNUM)
        for part in text_slices(batches):
            for first, data, offsets in slices(part.column("text"), 1 << 20):
                terms, text = split_terms(words, data, offsets)
                coded = terms.dictionary_encode()
                doc, term, _ = postings(text, coded.indices.to_numpy())
                yield part, first, data, offsets, np.bincount(text, minlength=len(offsets) - 1), tree.leaves(coded.dictionary, doc, term, len(offsets) - 1)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << tree.levels), np.int64)
        for _, _, _, offsets, n, leaf in parts(batches):
            for k, x in enumerate((np.diff(offsets), n, n > 0)):
                total[k] += np.bincount(leaf, x, minlength=total.shape[1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], ["leaf", "bytes", "terms", "docs"])

    with small_batches(docs.sparkSession):
        leaves = rows.mapInArrow(measured, "leaf long, bytes long, terms long, docs long").groupBy("leaf").agg(F.sum("bytes"), F.sum("terms"), F.sum("docs")).collect()
    documents, terms = sum(x[3] for x in leaves), sum(x[2] for x in leaves)
    blocks = np.ones(1 << tree.levels, np.int64)
    for leaf, in_bytes, *_ in leaves:
        blocks[leaf] = max(1, -(-in_bytes // block_bytes))
    offset = np.cumsum(blocks) - blocks

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first, _, offsets, n, leaf in parts(batches):
            at = part.slice(first, len(offsets) - 1)
            block = offset[leaf] + at.column("row").to_numpy().view(np.uint64) % blocks[leaf].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), at.column("doc_id"), at.column("text")], ["block", "doc_id", "text"]).filter(pa.array(n > 0))

    def indexed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (block,) = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("doc_id").combine_chunks().to_batches()
        yield from _clusters(key[0].as_py(), block.column("doc_id").to_numpy(), block.column("text"), documents, terms, most)

    numbered = rows.withColumn("row", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()))
    by_block = numbered.mapInArrow(dealt, "block long, doc_id long, text string").groupBy("block")
    return Index(cut(by_block.applyInArrow(indexed, INDEX), "index"), documents, terms)


def _clusters(block: int, ids: np.ndarray, texts: pa.Array, documents: int, terms: int, most: int) -> Iterator[pa.RecordBatch]:
    """The clusters of a block, whose documents are sorted by id."""
    (_, data, offsets), *_ = slices(texts, 1 << 62)
    found, text = split_terms(Words(NOT_ALNUM), data, offsets)
    coded = found.dictionary_encode()
    sorted_terms = pc.array_sort_indices(coded.dictionary)
    number = np.empty(len(sorted_terms), np.int64)
    number[sorted_terms.to_numpy()] = np.arange(len(sorted_terms))
    vocabulary = coded.dictionary.take(sorted_terms)
    doc, term, tf = postings(text, number[coded.indices.to_numpy()])
    impact = impacts(tf, np.bincount(text, minlength=len(ids))[doc], documents, terms)
    levels = max(0, math.ceil(math.log2(max(1, len(ids) / most))))
    group, _ = bisected(doc, term, len(ids), levels)
    order = np.argsort(group[doc], kind="stable")
    edges = np.searchsorted(group[doc][order], np.arange((1 << levels) + 1))
    rows: list[tuple] = []
    for g in range(1 << levels):
        own = order[edges[g] : edges[g + 1]]
        if not len(own):
            continue
        members = np.flatnonzero(group == g)
        own = own[np.argsort(term[own], kind="stable")]
        used, begin = np.unique(term[own], return_index=True)
        names = vocabulary.take(pa.array(used))
        lengths = pc.binary_length(names).to_numpy().astype(np.int64)
        rows.append((
            block << 20 | g, int(ids[members[0]]), ids[members].astype(np.int64).tobytes(), np.cumsum(lengths).astype(np.int32).tobytes(), b"".join(names.to_pylist()),
            np.maximum.reduceat(impact[own], begin).astype(np.int32).tobytes(), np.append(begin, len(own)).astype(np.int32).tobytes(),
            np.searchsorted(members, doc[own]).astype(np.uint16).tobytes(), impact[own].astype(np.int32).tobytes(),
        ))
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
    columns = [x.split()[0] for x in INDEX.split(", ")]
    for a in range(0, len(rows), CLUSTERS_AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + CLUSTERS_AT_ONCE], strict=True), kinds, strict=True)], columns)


class Queries:
    """Items by number: the distinct terms of all, and each one's terms with how often they occur."""

    def __init__(self, texts: list[str]):
        (_, data, offsets), *_ = slices(pa.array(texts, pa.string()), 1 << 62)
        terms, text = split_terms(Words(NOT_ALNUM), data, offsets)
        coded = terms.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.of, self.term, self.times = postings(text, coded.indices.to_numpy())
        self.n = len(texts)
        self.weight = np.zeros(len(self.term), np.int64)

    def weigh(self, df: np.ndarray, documents: int) -> None:
        """A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), here times its occurrences in the item."""
        by_df = {x: math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in set(df.tolist())}
        self.weight = self.times * np.array([by_df[x] for x in df.tolist()], np.int64)[self.term]

    def known(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each cluster the places of its terms that items have, and their numbers here."""
        ends = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("term_ends")]
        sizes = np.array([len(x) for x in ends], np.int64)
        lengths = np.concatenate([np.diff(x, prepend=0) for x in ends]) if ends else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = b"".join(x.as_py() for x in batch.column("term_bytes"))
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found = pc.index_in(terms, value_set=self.vocabulary).fill_null(-1).to_numpy()
        begin = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            own = np.flatnonzero(found[a:b] >= 0)
            out.append((own, found[a:b][own].astype(np.int64)))
        return out

    def bounds(self, own: np.ndarray, number: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The most that each item can score in a cluster."""
        most = np.zeros(len(self.vocabulary), np.int64)
        most[number] = best[own]
        out = np.zeros(self.n, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], self.of[1:] != self.of[:-1]]))
        out[self.of[edge]] = np.add.reduceat(most[self.term] * self.weight, edge)
        return out


class Best:
    """The k best (score, doc_id) of each item, the smaller doc_id before a greater one."""

    def __init__(self, n: int, k: int, score: np.ndarray, doc: np.ndarray):
        #: What a document must reach: a score, and with just that score a doc_id. Score 1 takes any that scores.
        self.k, self.score, self.doc = k, score.copy(), doc.copy()
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def may(self, bound: np.ndarray, least_doc: int) -> np.ndarray:
        return np.flatnonzero((bound > self.score) | ((bound == self.score) & (least_doc <= self.doc)))

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (columns) for items (rows)."""
        at, of = np.nonzero((scores > self.score[items][:, None]) | ((scores == self.score[items][:, None]) & (ids[None, :] <= self.doc[items][:, None])))
        if not len(at):
            return
        found = scores[at, of]
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q = int(items[at[a]])
            rows = sorted([*self.held[q], *zip((-found[a:b]).tolist(), ids[of[a:b]].tolist(), strict=True)])[: self.k]
            self.held[q] = rows
            if len(rows) == self.k and (-rows[-1][0], -rows[-1][1]) > (self.score[q], -self.doc[q]):
                self.score[q], self.doc[q] = -rows[-1][0], rows[-1][1]

    def rows(self) -> pa.RecordBatch:
        found = [(q, d, -s) for q, own in enumerate(self.held) for s, d in own]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "doc_id", "score"])


def _visit(queries: Queries, row: dict, own: np.ndarray, number: np.ndarray, items: np.ndarray, best: Best) -> None:
    """Scores the documents of a cluster for some items."""
    ids = np.frombuffer(row["docs"], np.int64)
    begin, of, impact = (np.frombuffer(row[c], t) for c, t in (("begin", np.int32), ("of", np.uint16), ("impact", np.int32)))
    local = np.full(len(queries.vocabulary), -1, np.int64)
    local[number] = np.arange(len(number))
    counts = (begin[own + 1] - begin[own]).astype(np.int64)
    line = np.repeat(np.arange(len(own)), counts)
    at = np.repeat(begin[own].astype(np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    table = np.zeros((len(own), len(ids)), np.int64)
    table[line, of[at]] = impact[at]
    first, last = np.searchsorted(queries.of, items), np.searchsorted(queries.of, items, side="right")
    size, a = last - first, 0
    while a < len(items):
        b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), TERMS_AT_ONCE, side="right")) + a)
        n = size[a:b]
        pick = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        there = local[queries.term[pick]]
        pick, there, item = pick[there >= 0], there[there >= 0], np.repeat(np.arange(b - a), n)[there >= 0]
        if len(pick):
            edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            best.add(items[a:b][item[edge]], np.add.reduceat(queries.weight[pick][:, None] * table[there], edge), ids)
        a = b


def search(index: Index, items: DataFrame, k: int = 10, pass_chars: int = PASS_CHARS, wave: int = WAVE) -> DataFrame:
    """The k highest-scoring documents with score above 0 for each row of items (item_id, text): item_id, rank, doc_id, score.

    Equal scores are by ascending doc_id. Rows of items with a null count as none, equal rows as one; rows with one item_id and different
    texts are ranked each. Items are searched for in passes of bounded size.
    """
    usable = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    spark = usable.sparkSession
    found, block, size = None, [], 0

    def one(block: list[tuple[int, str]]) -> DataFrame:
        # from Arrow, as rows would start Python workers of another kind beside those that search
        keys = spark.createDataFrame(pa.table({"q": pa.array(range(len(block)), pa.int64()), "item_id": pa.array([item for item, _ in block], pa.int64())}))
        with small_batches(spark, CLUSTERS_AT_ONCE, read=True):
            return cut(_search_pass(index, Queries([t for _, t in block]), k, wave).join(F.broadcast(keys), "q").select("item_id", "rank", "doc_id", "score"), "found")

    for row in cut(usable, "items").toLocalIterator():
        if block and size + len(row[1]) > pass_chars:
            found = one(block) if found is None else found.unionByName(one(block))
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        found = one(block) if found is None else found.unionByName(one(block))
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_pass(index: Index, queries: Queries, k: int, wave: int) -> DataFrame:
    """(q, rank, doc_id, score) of the items of one pass."""
    if not len(queries.term):
        return index.clusters.sparkSession.createDataFrame([], "q long, rank int, doc_id long, score long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.vocabulary), np.int64)
        for batch in batches:
            for (own, number), x in zip(queries.known(batch), batch.column("begin"), strict=True):
                df[number] += np.diff(np.frombuffer(x.as_buffer(), np.int32))[own]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    df = np.zeros(len(queries.vocabulary), np.int64)
    for term, n in index.clusters.select("term_ends", "term_bytes", "begin").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    queries.weigh(df, index.documents)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each item the clusters of the task with the highest bounds."""
        bound, cluster = np.zeros((queries.n, wave), np.int64), np.full((queries.n, wave), -1, np.int64)
        for batch in batches:
            for (own, number), x, c in zip(queries.known(batch), batch.column("best"), batch.column("cluster").to_pylist(), strict=True):
                now = queries.bounds(own, number, np.frombuffer(x.as_buffer(), np.int32))
                low = bound.argmin(axis=1)
                better = np.flatnonzero(now > bound[np.arange(queries.n), low])
                bound[better, low[better]], cluster[better, low[better]] = now[better], c
        q, at = np.nonzero(cluster >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cluster[q, at]), pa.array(bound[q, at])], ["q", "cluster", "bound"])

    def top(df: DataFrame, by: list, order: list, n: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)

    high = index.clusters.select("cluster", "term_ends", "term_bytes", "best").mapInArrow(bounded, "q long, cluster long, bound long")
    first = cut(top(high, ["q"], [F.desc("bound"), "cluster"], wave).select("q", "cluster"), "first")
    clusters = index.clusters.join(small(first.groupBy("cluster").agg(F.collect_list("q").alias("items"))), "cluster")

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries.n, k, np.ones(queries.n, np.int64), np.full(queries.n, 2**63 - 1))
        for batch in batches:
            for (own, number), row in zip(queries.known(batch), batch.to_pylist(), strict=True):
                _visit(queries, row, own, number, np.sort(np.array(row["items"], np.int64)), best)
        yield best.rows()

    early = clusters.mapInArrow(visited, "q long, doc_id long, score long")
    score, doc = np.ones(queries.n, np.int64), np.full(queries.n, 2**63 - 1)
    for q, s, d in top(early, ["q"], [F.desc("score"), "doc_id"], k).filter(F.col("rank") == k).select("q", "score", "doc_id").collect():
        score[q], doc[q] = s, d

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries.n, k, score, doc)
        for batch in batches:
            known, rows = queries.known(batch), batch.to_pylist()
            bounds = [queries.bounds(own, number, np.frombuffer(row["best"], np.int32)) for (own, number), row in zip(known, rows, strict=True)]
            for c in sorted(range(len(rows)), key=lambda c: -int(bounds[c].max())):
                items = best.may(bounds[c], rows[c]["least_doc"])
                if len(items):
                    _visit(queries, rows[c], *known[c], items, best)
        yield best.rows()

    late = index.clusters.mapInArrow(rest, "q long, doc_id long, score long").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    order = [F.desc("score"), F.col("doc_id")]
    merged = top(late, ["q", "share"], order, k).drop("rank")
    return top(merged, ["q"], order, k).select("q", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, **sizes: int) -> DataFrame:
    """``search`` for items in an index of docs, which is deleted at the end. sizes as for ``build_index``; they change no result."""
    with scratch(docs.sparkSession):
        return keep(search(build_index(docs, **sizes), items, k), "ranked")
