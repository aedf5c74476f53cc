"""Phrase collocations by generalised suffix automata of bounded depth (Blumer et al., "The Smallest Automaton Recognizing the
Subwords of a Text", 1985), one for each shard of texts.

The strings of an automaton are the phrases of a shard, up to the longest asked for. It is built level by level from the words
of all pieces: a phrase is its prefix and one more word (the transition), and its suffix link leads to the phrase without the
first word. The end positions of a phrase are among those of its suffix, so both are in one state exactly if they have as
many. A state is sent as its longest phrase, the length of its shortest one, and the number of end positions; its phrases
are that one's suffixes. Counts of all shards are added up by phrase.

Nearly all phrases are rare, and words are long. So the shards' counts are first added up by counters: a phrase's hash names one of as
many ranges as the texts have RANGE_BYTES, and a counter in it. A counter is never under the count of a phrase that it counts,
so phrases with a low one are left out when states are sent as words; the rest is counted exactly.

Of the phrases that are frequent enough, suffix links and their mirror (the phrase without the last word) tell what is subsumed: if any longer phrase subsumes another, one that is a word
longer does, as its count is no smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, keep, scratch
from scriptorium.llm.batches import text_slices
from scriptorium.llm.graphs import small
from scriptorium.llm.hashing import hash_words, mix, slices
from scriptorium.llm.prefilter import Bloom, bloom

#: Bytes of text of a shard, unless a single text has more.
SHARD = 2 << 20
#: Bytes of texts for each range of counters and least ranges, the logarithm of a range's counters, and phrases that a task adds up first.
RANGE_BYTES, LEAST_RANGES, LOG_COUNTERS, HELD = 32 << 20, 32, 26, 1 << 20
#: Bytes of phrases that may be broadcast, besides the bound on their number.
BROADCAST_BYTES = 64 << 20
#: What parts words within a piece, and what parts pieces.
BETWEEN, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BETWEEN)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The words of texts in lower case, the number of each word's text, and how many words stand before it in its piece."""
    kind = _KIND[data]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = word[edges]
    at = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(word)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(before[at], before[-1]).astype(np.int64)), pa.py_buffer(_LOWER[data[word]])])
    text = np.searchsorted(offsets, at, side="right") - 1
    breaks = np.cumsum(kind == 2)[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    return words, text, np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key its number among the distinct ones; for each distinct one a place, and how often it occurs."""
    order = np.argsort(keys)
    ranked = keys[order]
    edge = np.ones(len(keys), bool)
    edge[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(edge) - 1
    begin = np.flatnonzero(edge)
    return number, order[begin], np.diff(np.append(begin, len(keys)))


class Automaton:
    """The suffix automaton of words (their numbers, the group of each, and the words before each in its piece), to a depth.

    ends[k], before[k], links[k], counts[k], shortest[k] are of the distinct phrases of k + 1 words: a place where it ends, its prefix, its
    suffix link, its end positions, and the length of the shortest phrase of its state.
    """

    def __init__(self, words: np.ndarray, groups: np.ndarray, run: np.ndarray, depth: int):
        own, end, count = _numbered(groups.astype(np.int64) << 32 | words)
        none = np.zeros(0, np.int64)
        self.ends, self.counts, self.before, self.links, self.shortest = [end], [count], [none], [none], [np.ones(len(end), np.int8)]
        at, before = np.arange(len(words)), own  # places where phrases of this depth end, and the phrase of each place
        for level in range(2, depth + 1):
            at = at[run[at] >= level - 1]
            number, pick, count = _numbered(before[at - 1] << 32 | words[at])
            end = at[pick]
            link = before[end]
            same = count == self.counts[-1][link]
            self.shortest.append(np.where(same, self.shortest[-1][link], np.int8(level)))
            self.ends.append(end)
            self.counts.append(count)
            self.before.append(before[end - 1])
            self.links.append(link)
            before = np.full(len(words), -1, np.int64)
            before[at] = number


class Shard:
    """The automaton of texts, and the words and langs that its numbers mean."""

    def __init__(self, langs: pa.Array, texts: pa.Array, depth: int):
        (_, data, offsets), *_ = slices(texts, 1 << 62)
        words, text, run = split_words(data, offsets)
        coded, lang = words.dictionary_encode(), langs.dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary())
        self.groups, self.langs = lang.indices.to_numpy()[text], lang.dictionary
        self.automaton = Automaton(self.ids, self.groups, run, depth) if len(words) else None

    def hashes(self) -> list[np.ndarray]:
        """For each depth a hash of each phrase with its lang."""
        own, lang = _hashes_of(self.vocabulary), mix(_hashes_of(self.langs), 70)
        found: list[np.ndarray] = []
        for level, end in enumerate(self.automaton.ends):
            before = found[-1][self.automaton.before[level]] if level else lang[self.groups[end]]
            found.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + own[self.ids[end]], 71 + level))
        return found

    def states(self, wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows (lang, phrase, shortest, longest, n) of states, as far as their phrases are wanted, and one with an empty phrase for
        the words of each lang."""
        names = ["lang", "phrase", "shortest", "longest", "n"]
        a = self.automaton
        send = [x.copy() for x in wanted]
        for level in range(len(a.ends) - 1, 0, -1):  # of a state the longest phrase that is wanted, for all its suffixes
            inner = a.shortest[level] <= level
            link = a.links[level][inner]
            taken = wanted[level][inner]
            wanted[level - 1][link] |= taken
            send[level - 1][link[taken]] = False
        for level, end in enumerate(a.ends):
            pick = np.flatnonzero(send[level])
            at = end[pick]
            parts = [self.vocabulary.take(pa.array(self.ids[at - back])) for back in range(level, -1, -1)]
            phrase = parts[0] if level == 0 else pc.binary_join_element_wise(*parts, pa.scalar(b" "))
            columns = [self.langs.take(pa.array(self.groups[at])), phrase.cast(pa.string()), pa.array(a.shortest[level][pick].astype(np.int32)), pa.array(np.full(len(at), level + 1, np.int32)), pa.array(a.counts[level][pick])]
            yield pa.RecordBatch.from_arrays(columns, names)
        total = np.bincount(self.groups)
        zero = pa.array(np.zeros(len(total), np.int32))
        yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(np.arange(len(total)))), pa.array([""] * len(total)), zero, zero, pa.array(total.astype(np.int64))], names)


def _hashes_of(values: pa.Array) -> np.ndarray:
    _, offsets, data = values.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(values), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out[full] = hash_words(data, offsets[:-1][full], offsets[1:][full])
    return out


def _shards(batches: Iterator[pa.RecordBatch], depth: int, most: int) -> Iterator[Shard]:
    """Shards of rows (lang, text), those without words left out."""
    held: list[pa.RecordBatch] = []
    size = 0

    def shard() -> Iterator[Shard]:
        (rows,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        if (found := Shard(rows.column(0), rows.column(1), depth)).automaton:
            yield found

    for part in text_slices(batches):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
        if size >= most:
            yield from shard()
            held, size = [], 0
    if held:
        yield from shard()


def _counter_of(hashes: np.ndarray, ranges: int, log: int) -> np.ndarray:
    """Range and counter in one number."""
    return hashes % np.uint64(ranges) << np.uint64(log) | hashes >> np.uint64(64 - log)


def frequent_counters(named: DataFrame, depth: int, least: int, ranges: int, log: int = LOG_COUNTERS, shard_bytes: int = SHARD) -> DataFrame:
    """(id) of the counters that reach least. A task's phrases travel as sorted counters, in one row for each range; a counter needs
    no more than it takes to be enough, so a byte or two hold it."""
    kind = np.uint8 if least < 256 else np.uint32

    def sent(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.minimum(np.add.reduceat(count[order].astype(np.int64), begin), least).astype(kind)
        key = key[begin]
        place, range_ = (key & np.uint64((1 << log) - 1)).astype(np.uint32), (key >> np.uint64(log)).astype(np.int32)
        edges = np.flatnonzero(np.concatenate([[True], range_[1:] != range_[:-1], [True]]))
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(range_[edges[:-1]]), pa.array([place[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([total[a:b].tobytes() for a, b in cuts], pa.binary())], ["range", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for shard in _shards(batches, depth, shard_bytes):
            for hashes, count in zip(shard.hashes(), shard.automaton.counts, strict=True):
                keys.append(_counter_of(hashes, ranges, log))
                counts.append(np.minimum(count, least).astype(kind))
                size += len(hashes)
            if size >= HELD:
                yield sent(keys, counts)
                keys, counts, size = [], [], 0
        if keys:
            yield sent(keys, counts)

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << log, kind)
        for batch in batches:
            for places, counts in zip(batch.column("places"), batch.column("counts"), strict=True):
                at = np.frombuffer(places.as_buffer(), np.uint32)
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counts.as_buffer(), kind), least)
        for a in range(0, len(total), 1 << 20):
            enough = np.flatnonzero(total[a : a + (1 << 20)] >= least) + a
            yield pa.RecordBatch.from_arrays([pa.array(enough | key[0].as_py() << log)], ["id"])

    return named.mapInArrow(run, "range int, places binary, counts binary").groupBy("range").applyInArrow(added, "id long")


def phrase_counts(docs: DataFrame, depth: int = 3, least: int = 1, log: int = LOG_COUNTERS, shard_bytes: int = SHARD) -> DataFrame:
    """(lang, phrase, f): how often phrases of up to depth words occur within the pieces of texts, if least times; for the empty phrase the
    count of all words.

    Lower case for A-Z; pieces end at BREAKS and words at BETWEEN. A null text has no words, a null lang is ``und``.
    """
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text <> ''")
    ranges, known = 1, None
    if least > 1:
        size = named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
        known = bloom(cut(frequent_counters(named, depth, least, ranges, log, shard_bytes), "counters"), "id")

    def run(batches: Iterator[pa.RecordBatch], known: Bloom | None = known) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, depth, shard_bytes):
            yield from shard.states([known(_counter_of(h, ranges, log).view(np.int64)) if known else np.ones(len(h), bool) for h in shard.hashes()])

    states = named.mapInArrow(run, "lang string, phrase string, shortest int, longest int, n long")
    suffixes = F.expr("transform(sequence(shortest, longest), j -> substring_index(phrase, ' ', -j))")
    counts = states.select("lang", "n", F.explode(suffixes).alias("phrase")).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counts.filter((F.col("f") >= least) | (F.col("phrase") == ""))


def _sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of its phrases are few enough."""
    wide = (df.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) > BROADCAST_BYTES
    return df if wide else small(df)


def collocations(docs: DataFrame, least: int = 10, depth: int = 3, percent: int = 50, top: int = 2000, **sizes: int) -> DataFrame:
    """The first phrases of each lang: lang, rank (from 1), phrase, a, l, r, n, score.

    docs has text and lang; other columns are ignored. Phrases of 2 to depth words that occur least times are candidates; a is
    a candidate's count. A cut after k words has the counts l and r of both parts and the score floor(1000000 a a / (l r)); the
    lowest-scoring cut counts, the first of equals. A candidate goes if a longer one that holds it occurs at least percent of
    its times. Ranks are by score and a, falling, then by phrase. n counts the words of the lang. Sums and products are exact
    (decimals of 38 digits, enough for counts under 10^16). sizes: log and shard_bytes of ``frequent_counters``, which change no result. A null text has no words; a null lang is ``und``; repeated rows count each; a
    table without rows gives none.
    """
    with scratch(docs.sparkSession):
        return keep(_collocations(docs, least, depth, percent, top, **sizes))


def _collocations(docs: DataFrame, least: int, depth: int, percent: int, top: int, **sizes: int) -> DataFrame:
    # single words and phrases that occur often enough; parts of a candidate always do
    frequent = cut(phrase_counts(docs, depth, least, **sizes), "phrases")
    known = _sized(frequent.filter("phrase <> ''").select("lang", "phrase", "f"))
    size = F.size(F.split("phrase", " "))
    candidates = frequent.withColumn("size", size).filter("phrase <> '' and size > 1").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    parted = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    parted = parted.withColumn("aa", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("lr", wide("l") * wide("r")).withColumn("score", F.expr("aa div lr"))
    scored = parted.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("size").alias("size"), F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # what a suffix link and its mirror lead to
    link, mirror = F.expr("substring_index(phrase, ' ', 1 - size)"), F.expr("substring_index(phrase, ' ', size - 1)")
    inside = candidates.filter("size > 2").select("lang", F.explode(F.array(link, mirror)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    totals = frequent.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
