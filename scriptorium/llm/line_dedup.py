"""Line dedup by an exact set-similarity join (Bayardo et al., "Scaling Up All Pairs Similarity Search", 2007;
Xiao et al., "Efficient Similarity Joins for Near Duplicate Detection", 2008).

A line is the set of its words. Words are ordered by rarity: by the logarithm of a count over all lines,
kept in a sketch of fixed size, then by hash; any common order gives exact results, a good one short lists.
Lines with equal sets are one class. A class's prefix holds its n - ceil(0.8 n) + 1 rarest words. Classes that share a
prefix word are candidates if their sizes (length filter) and the places of the word (positional filter) allow a Jaccard
similarity of 0.8, and if the bitmaps of their words, 128 bits of parity, differ in no more places than the sets may. The
Jaccard similarity of every candidate is then computed from the lines' words.

A class goes if any earlier one is similar, so not all pairs of a crowd of copies are needed. Each class first meets
the earliest FIRST candidates of each of its prefix words. Only classes with more candidates, of which none was similar,
meet the rest.
"""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, keep, scratch
from scriptorium.llm.graphs import small
from scriptorium.llm.hashing import Words, mix, signed, slices, sums
from scriptorium.llm.prefilter import Bloom, bloom

#: Counters of the sketch of word counts, the pieces in which it is added up, and the groups that add up a piece first.
COUNTERS, PIECES, GROUPS = 1 << 20, 16, 64
#: Bits of a word's rank, and bytes of a slice.
RANK_BITS, BYTES = 5, 1 << 18
#: Candidates of a word that a class meets at first; rows handled together; lines of a word that a task takes at once.
FIRST, ROWS, HOT_LOG = 8, 1 << 18, 17
#: Pairs whose bitmaps are compared at a time.
PAIRS = 1 << 19
#: Rows of which a task makes blocks, those it sends together, and most rows in a block.
HELD, SENT, BLOCK = 1 << 17, 1 << 14, 1 << 11
#: Rows of a bucket, and buckets, while the rows are few.
BUCKET_ROWS, BUCKETS = 1 << 12, (1 << 11) - 1
NEWLINE = 10


def line_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of lines, row of each line from the first, number of each line in its text).

    Lines end at newlines. A slice ends with a text or, within a larger text, with a line.
    """
    for first, data, offsets in slices(column, BYTES):
        ends = np.flatnonzero(data == NEWLINE)
        row_of_end = np.searchsorted(offsets, ends, side="right") - 1
        begins = np.sort(np.concatenate([offsets[:-1], ends + 1]), kind="stable")
        # a line that starts at a text's end (after its last newline) belongs to that text, before the next text's first line
        rows = np.sort(np.concatenate([np.arange(len(offsets) - 1), row_of_end]), kind="stable")
        number = np.arange(len(rows)) - np.searchsorted(rows, rows)
        begins = np.concatenate([begins, [len(data)]])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + BYTES, side="right")) - 1)
            end = min(end, len(rows))
            yield first, data[begins[at] : begins[end]], begins[at : end + 1] - begins[at], rows[at:end], number[at:end]
            at = end


def word_sets(words: Words, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray | None, twice: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's distinct words as their hashes, rarest first where ranks are given and else by hash; with twice, the same words'
    second hashes; where each line's begin."""
    hashes, second, begin = words.twice(data, offsets) if twice else (*(found := words(data, offsets))[:1], None, found[1])
    if not len(hashes):
        return hashes, hashes, np.zeros(len(offsets), np.int64)
    counts = np.diff(begin)
    full = np.flatnonzero(counts)
    # one key to sort by: line, rank, as many bits of the hash as there is room for, and which word it is
    of_line, of_word = np.uint64(len(full).bit_length()), np.uint64(len(hashes).bit_length())
    of_hash = np.uint64(64 - RANK_BITS) - of_line - of_word
    key = (hashes >> (np.uint64(64) - of_hash)) << of_word | np.arange(len(hashes), dtype=np.uint64)
    if rank is not None:
        key |= rank[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << (of_hash + of_word)
    key |= np.repeat(np.arange(len(full), dtype=np.uint64) << (of_hash + of_word + np.uint64(RANK_BITS)), counts[full])
    key.sort()
    at = (key & ((np.uint64(1) << of_word) - np.uint64(1))).astype(np.int64)
    key >>= of_word
    ids, same = hashes[at], key[1:] == key[:-1]
    if (odd := np.flatnonzero(same & (ids[1:] != ids[:-1]))).size:  # different words that those bits do not tell apart, few if any
        edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        for g in np.unique(np.searchsorted(edges, odd, side="right") - 1):
            own = slice(edges[g], edges[g + 1])
            at[own] = at[own][np.argsort(ids[own], kind="stable")]
        ids = hashes[at]
    keep = np.ones(len(ids), bool)
    keep[1:] = ~(same & (ids[1:] == ids[:-1]))
    count = np.zeros(len(offsets) - 1, np.int64)
    count[full] = np.bincount((key[keep] >> (of_hash + np.uint64(RANK_BITS))).astype(np.int64), minlength=len(full))
    return ids[keep], second[at[keep]] if twice else ids[:0], np.concatenate([[0], np.cumsum(count)])


def line_classes(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each line's set of words; of use for lines with words only."""
    return mix(sums(mix(ids, 1), begin) + np.diff(begin).astype(np.uint64), 2)


def line_names(second: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 more bits for each line's set, from its words' second hashes."""
    return mix(sums(mix(second, 7), begin) ^ mix(np.diff(begin).astype(np.uint64), 8), 9)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, line, class in 128 bits) of lines with words, and at the end the counts of hashed words in pieces."""
    words, counts = Words(), np.zeros(COUNTERS, np.int64)
    names = ["doc_id", "line", "cls", "cls2", "piece", "counts"]
    for batch in batches:
        for first, data, offsets, rows, number in line_slices(batch.column(1)):
            ids, second, begin = word_sets(words, data, offsets, None, twice=True)
            np.add.at(counts, (ids & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            full = np.flatnonzero(np.diff(begin))
            if not len(full):
                continue
            classes = line_classes(ids, begin)
            more, classes = line_names(second, begin)[full], classes[full]
            docs = batch.column(0).take(pa.array(first + rows[full]))
            yield pa.RecordBatch.from_arrays([docs, pa.array(number[full].astype(np.int32)), signed(classes), signed(more), pa.nulls(len(full), pa.int32()), pa.nulls(len(full), pa.binary())], names)
    if counts.any():
        parts = pa.array([x.astype(np.uint32).tobytes() for x in np.split(np.minimum(counts, 2**32 - 1), PIECES)])
        none = pa.nulls(PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(PIECES, pa.int32()), none, none, pa.array(range(PIECES), pa.int32()), parts], names)


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS // PIECES, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)  # over any rank
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["piece", "counts"])


def word_ranks(pieces: DataFrame) -> np.ndarray:
    """For each counter the logarithm of its count, 0 to 31. 4 MB reach the driver whatever the input; a task's counts are
    added up in groups first, so no task meets those of all tasks."""
    groups = pieces.groupBy("piece", F.pmod(F.xxhash64("counts"), F.lit(GROUPS)).alias("own")).applyInArrow(_added, "piece int, counts binary")
    rank = np.zeros((PIECES, COUNTERS // PIECES), np.uint8)
    for piece, x in groups.groupBy("piece").applyInArrow(_added, "piece int, counts binary").collect():
        rank[piece] = np.minimum(np.ceil(np.log2(np.maximum(np.frombuffer(x, np.uint32), 1))), 31)
    return rank.ravel()


PREFIX = "key long, cls long, n int, place int, b0 long, b1 long, doc long, line int"


def _prefixes(rank_bytes: bytes, of_lines: Bloom | None = None, of_classes: Bloom | None = None, of_keys: Bloom | None = None) -> Callable:
    """Rows for the prefix words of a slice's classes, each with the class's first line in the slice; with filters, of the lines' places,
    classes or keys that may be wanted only. Words of lines that are not wanted are not looked at.

    The key is the word, or the word and two of its shares: the lines of a word that more than 2 ** HOT_LOG lines hold are
    dealt to shares, and every two shares meet under a key of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = Words(), np.frombuffer(rank_bytes, np.uint8)
        for batch in batches:
            ids_of_docs = batch.column(0).to_numpy()
            for first, data, offsets, rows, number in line_slices(batch.column(1)):
                if of_lines:
                    wanted = np.flatnonzero(of_lines(_places(ids_of_docs[first + rows], number)))
                    if not len(wanted):
                        continue
                    data, offsets = _only(data, offsets, wanted)
                    rows, number = rows[wanted], number[wanted]
                ids, _, begin = word_sets(words, data, offsets, rank)
                n = np.diff(begin)
                classes, docs = line_classes(ids, begin), ids_of_docs[first + rows]
                # a set of three words has no partner but its equals; a slice's copies are sent once
                order = np.lexsort((number, docs))
                once = order[np.unique(classes[order], return_index=True)[1]]
                used = once[n[once] >= 4]
                if of_classes:
                    used = used[of_classes(classes[used].view(np.int64))]
                if not len(used):
                    continue
                bits, full, where = np.zeros((2, len(n)), np.uint64), np.flatnonzero(n), mix(ids, 3) >> np.uint64(57)
                for k in (0, 1):
                    own = np.where(where >> np.uint64(6) == k, np.uint64(1) << (where & np.uint64(63)), np.uint64(0))
                    bits[k, full] = np.bitwise_xor.reduceat(own, begin[:-1][full])
                size = n[used]
                prefix = size - (4 * size + 4) // 5 + 1
                of = np.repeat(np.arange(len(used)), prefix)
                place = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                word = ids[begin[:-1][used][of] + place]
                shares = 1 << np.maximum(rank[(word & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64) - HOT_LOG, 0)
                again = np.repeat(np.arange(len(of)), shares)
                other = (np.arange(len(again)) - np.repeat(np.cumsum(shares) - shares, shares)).astype(np.uint64)
                of, place, word, shares = of[again], place[again], word[again], shares[again].astype(np.uint64)
                own = classes[used][of] % shares
                low, high = np.minimum(own, other), np.maximum(own, other)
                key = np.where(shares > 1, mix(word + (low << np.uint64(44)) + mix(high, 5), 4), mix(word, 4))
                if of_keys:
                    wanted = of_keys(key.view(np.int64))
                    key, of, place = key[wanted], of[wanted], place[wanted]
                yield pa.RecordBatch.from_arrays(
                    [signed(key), signed(classes[used][of]), pa.array(size[of].astype(np.int32)), pa.array(place.astype(np.int32)), signed(bits[0, used][of]), signed(bits[1, used][of]), pa.array(docs[used][of]), pa.array(number[used][of].astype(np.int32))],
                    ["key", "cls", "n", "place", "b0", "b1", "doc", "line"],
                )

    return run


#: Columns of a block, and the bytes of each.
_COLUMNS = {"key": "<i8", "cls": "<i8", "n": "<i4", "place": "<i4", "b0": "<i8", "b1": "<i8", "doc": "<i8", "line": "<i4"}
_WIDTHS = np.array([np.dtype(t).itemsize for t in _COLUMNS.values()])


def bucket_bits(rank: np.ndarray) -> int:
    """The logarithm of the number of buckets by key, so that one holds some ROWS rows at most. The rows are estimated from the
    words' ranks: a quarter of a line's words, and a line more words, are in its prefix."""
    rows = int((np.int64(1) << rank.astype(np.int64)).sum()) // 4
    return max(rows // ROWS, min(rows // BUCKET_ROWS, BUCKETS), 1).bit_length()


def _blocks(prefixes: Callable, bits: int) -> Callable:
    """The rows of ``_prefixes`` as (bucket, rows): a block holds up to BLOCK rows of one bucket, the first bits of the key. So Spark deals
    and sorts far fewer rows. A block's bytes lie place by place: first bytes of all keys, second ones and so on."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([b.column("key").to_numpy() for b in held]).view(np.uint64)
        order = np.argsort(key)
        planes = np.empty((_WIDTHS.sum(), len(key)), np.uint8)
        for c, end, width in zip(_COLUMNS, np.cumsum(_WIDTHS), _WIDTHS, strict=True):
            planes[end - width : end] = np.concatenate([b.column(c).to_numpy() for b in held])[order].view(np.uint8).reshape(-1, width).T
        bucket = (key[order] >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.unique(np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, np.arange(0, len(key), BLOCK)]))
        ends, at = np.append(edges[1:], len(key)), 0
        while at < len(edges):  # few rows at once, so neither this worker nor Spark holds all blocks again
            end = max(at + 1, int(np.searchsorted(ends, edges[at] + SENT, side="right")))
            found = [planes[:, i:j].tobytes() for i, j in zip(edges[at:end], ends[at:end], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[at:end]]), pa.array(found, pa.binary())], ["bucket", "rows"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in prefixes(batches):
            held.append(batch)
            count += len(batch)
            if count >= HELD:
                yield from out(held)
                held, count = [], 0
        if count:
            yield from out(held)

    return run


def _opened(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of whole buckets, sorted by key and line, without doc and line."""
    ends = dict(zip(_COLUMNS, np.cumsum(_WIDTHS), strict=True))

    def column(name: str) -> np.ndarray:
        own = slice(ends[name] - np.dtype(_COLUMNS[name]).itemsize, ends[name])
        return np.ascontiguousarray(np.concatenate([b[own] for b in blocks], axis=1).T).view(_COLUMNS[name]).ravel()

    order = np.lexsort((column("line"), column("doc"), column("key")))
    return [column(name)[order] for name in list(_COLUMNS)[:6]]


def _earliest(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (earlier class, class) for whole groups of rows sorted by key and line: of each class's candidates in a
    group the first ones; and the classes that have more.

    In a group, the positional filter says of the smaller line of a pair that the word is in its first ninth, and of
    the larger one of n words that the smaller has no more than 9 / 4 (n - place) - n. With the length filter, a line's
    smaller partners are a range of the group's lines by size.
    """
    key, cls = rows[0], rows[1]
    # a class's first line in a group stands for it
    first = np.sort(np.unique(mix(key.view(np.uint64), 6) + cls.view(np.uint64), return_index=True)[1])
    key, cls, n, place, b0, b1 = (c[first] for c in rows)
    n, place, b0, b1 = n.astype(np.int64), place.astype(np.int64), b0.view(np.uint64), b1.view(np.uint64)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 32
    small = np.flatnonzero(9 * place <= n)
    small = small[np.argsort(group[small] + n[small], kind="stable")]
    at = group[small] + n[small]
    low = np.searchsorted(at, group + (4 * n + 4) // 5)
    high = np.searchsorted(at, group + np.minimum(n, (9 * (n - place)) // 4 - n), side="right")
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    xs, ys, begin = [], [], 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        own = count[begin:end]
        large = np.repeat(np.arange(begin, end), own)
        other = small[np.repeat(low[begin:end], own) + np.arange(len(large)) - np.repeat(np.cumsum(own) - own, own)]
        total = n[large] + n[other]
        apart = np.bitwise_count(b0[large] ^ b0[other]).astype(np.int64) + np.bitwise_count(b1[large] ^ b1[other])
        hit = (9 * apart <= total) & (9 * (n[other] - place[other]) >= 4 * total)
        hit &= (n[other] < n[large]) | (other < large)  # of two lines of one size, once
        x, y = np.minimum(large[hit], other[hit]), np.maximum(large[hit], other[hit])
        x, y, rank = _ranked(x, y)
        xs.append(x[rank <= FIRST])
        ys.append(y[rank <= FIRST])
        begin = end
    x, y, rank = _ranked(np.concatenate(xs), np.concatenate(ys))
    return cls[x[rank < FIRST]], cls[y[rank < FIRST]], cls[y[rank == FIRST]]


def _ranked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in the order of y, then x, with each one's number among those of its y."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    edge = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else np.zeros(0, np.int64)
    return x, y, np.arange(len(y)) - np.repeat(edge, np.diff(np.concatenate([edge, [len(y)]])))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y), x earlier, from blocks sorted by bucket; (null, y) where y has more candidates in a group.

    Buckets are handled whole, many at a time; memory is that of ROWS rows or of the largest bucket.
    """

    def out(blocks: list[np.ndarray]) -> pa.RecordBatch:
        x, y, more = _earliest(_opened(blocks))
        more = np.unique(more)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), pa.nulls(len(more), pa.int64())]), pa.array(np.concatenate([y, more]))], ["x", "y"])

    held: list[np.ndarray] = []
    count, last = 0, None
    for batch in batches:
        for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != last and count >= ROWS:
                yield out(held)
                held, count = [], 0
            # copied, so that no block keeps its batch
            held.append(np.frombuffer(rows.as_buffer(), np.uint8).reshape(_WIDTHS.sum(), -1).copy())
            count, last = count + held[-1].shape[1], bucket
    if count:
        yield out(held)


def _places(docs: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64 bits for each line's place, as ``_place`` makes them."""
    return docs << 20 ^ number


def _place() -> Column:
    return F.shiftleft("doc_id", 20).bitwiseXOR(F.col("line").cast("long"))


def _only(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the wanted lines, and their offsets."""
    return np.concatenate([data[offsets[i] : offsets[i + 1]] for i in wanted]), np.concatenate([[0], np.cumsum(np.diff(offsets)[wanted])])


def _chosen_lines(of_lines: Bloom, of_classes: Bloom):
    """Sorted word sets of lines whose place and class may be wanted: rows (cls, cls2, words). Other lines' words are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids_of_docs = batch.column(0).to_numpy()
            for first, data, offsets, rows, number in line_slices(batch.column(1)):
                wanted = np.flatnonzero(of_lines(_places(ids_of_docs[first + rows], number)))
                if not len(wanted):
                    continue
                ids, second, begin = word_sets(words, *_only(data, offsets, wanted), None, twice=True)
                classes, more = line_classes(ids, begin), line_names(second, begin)
                keep = np.flatnonzero(of_classes(classes.view(np.int64)) & (np.diff(begin) > 0))
                keep = keep[np.unique(classes[keep], return_index=True)[1]]
                if len(keep):
                    found = pa.array([ids[begin[i] : begin[i + 1]].tobytes() for i in keep], pa.binary())
                    yield pa.RecordBatch.from_arrays([signed(classes[keep]), signed(more[keep]), found], ["cls", "cls2", "words"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["x", "x2", "y", "y2"]
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("wx"), batch.column("wy"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * shared >= 80 * (len(x) + len(y) - shared):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in names], names)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of every line that has an earlier similar line.

    docs has doc_id (integer) and text. Lines are split at newlines, words at white space, with A-Z taken as
    a-z; lines are similar when the Jaccard similarity of their word sets is 0.8 or more. Earlier is by doc_id,
    then by line number (from 0); rows of one doc_id count as one document's lines with equal numbers. Lines
    without words, and rows without text or doc_id, have no part.
    """
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_lines, "doc_id long, line int, cls long, cls2 long, piece int, counts binary"), "lines")
    lines = rows.filter("piece is null").select("doc_id", "line", "cls", "cls2")
    ranks = word_ranks(rows.filter("piece is not null").select("piece", "counts"))
    earliest = cut(lines.groupBy("cls", "cls2").agg(F.min(F.struct("doc_id", "line")).alias("at")).select("cls", "cls2", "at.doc_id", "at.line"), "earliest")
    near = cut(_later(docs, earliest, ranks), "later")
    # all lines of a class but the first, and the first too where an earlier class is similar
    mine = lines.join(
        earliest.join(small(near), ["cls", "cls2"], "left").select("cls", "cls2", F.col("doc_id").alias("d"), F.col("line").alias("l"), F.coalesce("gone", F.lit(False)).alias("gone")), ["cls", "cls2"]
    )
    return mine.filter("gone or doc_id <> d or line <> l").select("doc_id", "line")


def _later(docs: DataFrame, earliest: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(cls, cls2, gone=true) of classes similar to a class that begins earlier."""
    texts = docs.select("doc_id", "text")
    sent = texts.mapInArrow(_blocks(_prefixes(ranks.tobytes()), bucket_bits(ranks)), "bucket long, rows binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    met = cut(dealt.mapInArrow(_candidates, "x long, y long").distinct(), "met")
    pairs = met.filter("x is not null")
    gone = cut(_similar_later(docs, earliest, pairs), "gone")
    # classes with more candidates than they met, none of them similar
    left = cut(met.filter("x is null").select(F.col("y").alias("cls")).join(gone.select("cls"), "cls", "left_anti"), "left")
    if left.isEmpty():
        return gone
    # a class's first line has its words
    of_left = _prefixes(ranks.tobytes(), of_lines=bloom(earliest.join(small(left), "cls"), _place()), of_classes=bloom(left, "cls"))
    y = cut(texts.mapInArrow(of_left, PREFIX).join(small(left), "cls").select("key", *(F.col(c).alias(f"{c}_y") for c in ("cls", "n", "place", "b0", "b1"))).distinct(), "left-rows")
    x = texts.mapInArrow(_prefixes(ranks.tobytes(), of_keys=bloom(y.select("key").distinct(), "key")), PREFIX).join(small(y.select("key").distinct()), "key").select("key", *(F.col(c).alias(f"{c}_x") for c in ("cls", "n", "place", "b0", "b1"))).distinct()
    may = (
        "cls_x <> cls_y and 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y) and 9 * least(n_x - place_x, n_y - place_y) >= 4 * (n_x + n_y)"
        " and 9 * (bit_count(b0_x ^ b0_y) + bit_count(b1_x ^ b1_y)) <= n_x + n_y"
    )
    rest = x.join(y, "key").filter(F.expr(may)).select(F.col("cls_x").alias("x"), F.col("cls_y").alias("y")).distinct()
    rest = cut(rest.join(pairs, ["x", "y"], "left_anti"), "rest")
    return gone.unionByName(_similar_later(docs, earliest, rest)).distinct()


def _similar_later(docs: DataFrame, earliest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, cls2, gone=true) of the later class of each pair (x, y) that is similar.

    Texts are read again, but only the word sets of lines that may be in pairs are shuffled.
    """
    needed = cut(pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))).distinct(), "needed")
    first = cut(earliest.join(small(needed), "cls"), "first")
    chosen = _chosen_lines(bloom(first, _place()), bloom(first, "cls"))
    sets = cut(docs.select("doc_id", "text").mapInArrow(chosen, "cls long, cls2 long, words binary").join(small(first), ["cls", "cls2"]).dropDuplicates(["cls", "cls2"]), "words")
    full = (
        pairs.join(sets.select(F.col("cls").alias("x"), F.col("cls2").alias("x2"), F.col("words").alias("wx")), "x")
        .join(sets.select(F.col("cls").alias("y"), F.col("cls2").alias("y2"), F.col("words").alias("wy")), "y")
        .select("x", "x2", "y", "y2", "wx", "wy")
        .mapInArrow(_similar, "x long, x2 long, y long, y2 long")
    )
    begin = first.select("cls", "cls2", F.struct("doc_id", "line").alias("at"))
    both = full.join(small(begin).toDF("x", "x2", "ax"), ["x", "x2"]).join(small(begin).toDF("y", "y2", "ay"), ["y", "y2"])
    later = F.when(F.col("ax") < F.col("ay"), F.struct(F.col("y").alias("cls"), F.col("y2").alias("cls2"))).otherwise(F.struct(F.col("x").alias("cls"), F.col("x2").alias("cls2")))
    return both.select(later.alias("c")).select("c.cls", "c.cls2").distinct().withColumn("gone", F.lit(True))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that ``repeated_lines`` finds, all columns kept, and two more (which replace columns of these
    names): n_lines (lines of the text) and removed_lines (numbers of the lines taken out, in order).

    Rows with a null text or doc_id keep their text; a null text has null n_lines. A text all of whose lines go becomes
    empty. Of repeated rows each loses the lines that one of them loses. A table without rows gives none.
    """
    mark = "__" + uuid.uuid4().hex  # no column of docs has that name
    with scratch(docs.sparkSession):
        gone = repeated_lines(docs).groupBy(F.col("doc_id").alias(f"{mark}_id")).agg(F.array_sort(F.collect_set("line")).alias(f"{mark}_lines"))
        gone = keep(gone, "gone")
    lines = F.split("text", "\n", -1)
    # bound by a lambda, so that a text is split once; what stays is found by hashing, so time is that of the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{mark}_lines"))
    whole = F.transform(F.array(F.struct(lines.alias("l"), stay.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"))
    return (
        docs.drop("removed_lines", "n_lines")
        .join(small(gone, items=f"{mark}_lines"), docs.doc_id.cast("long") == F.col(f"{mark}_id"), "left")
        .withColumn("removed_lines", F.when(F.col("text").isNotNull(), F.col(f"{mark}_lines")))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.expr("cast(array() as array<int>)")))
        .withColumn("n_lines", F.size(lines))
        .withColumn("text", F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(F.get(whole, F.lit(0))))
        .drop(f"{mark}_id", f"{mark}_lines")
    )
