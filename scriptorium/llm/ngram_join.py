"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, "Efficient Exact Set-Similarity Joins", 2006).

Sets of shingles are grouped into size bands, of which a set takes part in its own and, if it may have partners there, in
the band below. Within such an instance, sets of a and b shingles that link differ in at most (a + b) / 9 of them; K is
the most that occurs.

The shingle domain is hashed into n1 = 0.6 (K + 1) parts, and each of them into three. A signature is a subset of
two of a part's three, with the hash of the set's shingles in both. One shingle in which two sets differ spoils two of a
part's three signatures, a second one the last. So sets that differ in H places spoil no more than
2 min(H, n1) + min(max(H - n1, 0), n1) of their 3 n1 signatures, and share one among as many and one more of each,
taken in an order common to all sets (the prefix argument, on signatures). That order puts signatures of very common
shingles alone last and empty ones at the end, so a passage that a third of the texts share makes few crowded signatures.
Where that many signatures of two sets are all empty, the argument fails; such sets (short ones, mostly) also enumerate
their first H + 1 single shingles.

Equal sets are one class, found by 128 bits of two hashes of their words' bytes; classes with many copies sign once. The classes of a signature are
compared with its hub, the class with most common shingles (the middle of a group of copies, if there is one). Classes that
stay apart from a hub meet the others that have this hub, block by block; of those pairs, ones in one component, ones that
the triangle inequality of the Jaccard distance to the hub excludes, and ones whose bitmaps differ in more places than the
sets may, are left out. A bitmap has the parities of a set's shingles in at least two bits for each shingle. What is left is
decided by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, keep, scratch
from scriptorium.llm.graphs import components, small
from scriptorium.llm.hashing import Words, mix, shingle_pairs, shingle_sets, signed, slices, sums
from scriptorium.llm.prefilter import Bloom, bloom

#: Counters of the sketch of shingle counts, the pieces in which it is added up, and the groups that add up a piece first.
COUNTERS, PIECES, GROUPS = 1 << 18, 16, 64
#: Shares of a signature of common shingles, members of a hub in a block, and classes with copies that the filter names.
SHARES, BLOCK, COPIED = 64, 4096, 1 << 22


def bands(top: int) -> np.ndarray:
    """The last size of each band, until top is inside one. Each is 5/4 of the one before at least."""
    ends = [1]
    while ends[-1] < top:
        ends.append((ends[-1] + 1) * 25 // 16)
    return np.array(ends)


def bitmaps(sets: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """For each set the parities of its shingles in 2 to 4 times as many bits, 64 at least."""
    place, out = mix(sets, 10), []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        bits = max(64, 1 << max(0, 2 * (b - a) - 1).bit_length())
        odd = np.bincount((place[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they are in so many words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _names(second: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 more bits for each class, from the second hashes of its shingles."""
    return mix(sums(mix(second, 12), begin) ^ mix(np.diff(begin).astype(np.uint64), 13), 14)


def _hashes(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return mix(sums(mix(sets, 1), begin) + np.diff(begin).astype(np.uint64), 2)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, size, class, bitmap), and at the end the counts of hashed shingles in pieces."""
    words, counts = Words(), np.zeros(COUNTERS, np.int64)
    names = ["doc_id", "n", "cls", "cls2", "bits", "piece", "counts"]
    for batch in batches:
        ids = batch.column(0)
        for first, data, offsets in slices(batch.column(1)):
            sets, second, begin = shingle_pairs(*words.twice(data, offsets))
            sizes = np.diff(begin)
            counts += np.bincount((sets & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            classes = _hashes(sets, begin)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(sizes)), pa.array(sizes), signed(classes), signed(_names(second, begin)), pa.array(bitmaps(sets, begin), pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())],
                names,
            )
    if counts.any():
        parts, none = [x.tobytes() for x in np.split(counts, PIECES)], pa.nulls(PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int32()), pa.array(parts)], names)


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS // PIECES, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["piece", "counts"])


def common_shingles(pieces: DataFrame) -> np.ndarray:
    """A bit for each counter: whether it holds over four times the mean and 100 more. 1 MB whatever the input; a task's
    counts are added up in groups first, so no task meets those of all tasks."""
    groups = pieces.groupBy("piece", F.pmod(F.xxhash64("counts"), F.lit(GROUPS)).alias("own")).applyInArrow(_added, "piece int, counts binary")
    counts = np.zeros((PIECES, COUNTERS // PIECES), np.int64)
    for piece, x in groups.groupBy("piece").applyInArrow(_added, "piece int, counts binary").collect():
        counts[piece] = np.frombuffer(x, np.int64)
    return counts.ravel() > 4 * counts.mean() + 100


def spoilt(differ: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Most of the 3 * parts signatures that sets which differ in so many shingles can have apart."""
    return 2 * np.minimum(differ, parts) + np.minimum(np.maximum(differ - parts, 0), parts)


def _ranks(of: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number within its group (of is sorted), and the groups' sizes."""
    held = np.bincount(of, minlength=groups)
    return np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held), held


def signatures(sets: np.ndarray, begin: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the set, whether all its shingles are common) of every set in its instances."""
    sizes = np.diff(begin)
    ends = bands(int(sizes.max(initial=1)))
    band = np.searchsorted(ends, sizes)
    is_common = common[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for down in (0, 1):
        inst = band - down
        top = ends[np.maximum(inst, 0)]
        most = (top + top * 5 // 4) // 9
        own = np.where(down == 0, (sizes + sizes * 5 // 4) // 9, (sizes + np.minimum(sizes, top)) // 9)
        used = np.flatnonzero((sizes > 0) & (inst >= 0) & (own > 0) & ((sizes * 4 + 4) // 5 <= top))
        if not len(used):
            continue
        n = sizes[used]
        at = np.repeat(begin[:-1][used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        elements, of, common_here = sets[at], np.repeat(np.arange(len(used)), n), is_common[at]
        parts = (3 * (most[used] + 1) + 4) // 5
        base = np.concatenate([[0], np.cumsum(parts)])
        slot = 3 * base[of] + (mix(elements, 3) % (3 * parts[of]).astype(np.uint64)).astype(np.int64)
        # the hashed contents, sizes and rare shingles of thirds of parts; then of all but one third
        total, count, rare = np.zeros(3 * base[-1], np.uint64), np.bincount(slot, minlength=3 * base[-1]), np.bincount(slot[~common_here], minlength=3 * base[-1])
        np.add.at(total, slot, mix(elements, 4))
        total, count, rare = ((x.reshape(-1, 3).sum(axis=1, dtype=x.dtype)[:, None] - x.reshape(-1, 3)).ravel() for x in (total, count, rare))
        full = np.flatnonzero(count)
        of_part = np.searchsorted(base, full // 3, side="right") - 1
        tag = (inst[used][of_part] * 2).astype(np.uint64)
        sig = mix(mix(total[full], 5) + mix((full - 3 * base[of_part]).astype(np.uint64), 6) + tag, 7)
        # one key to sort by: set, then common-only last, then fewer shingles later, then the hash itself, then the place
        last = rare[full] == 0
        key = (of_part.astype(np.uint64) << np.uint64(40)) | (last.astype(np.uint64) << np.uint64(39)) | ((127 - np.minimum(count[full], 127)).astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        sig, of_part, last = sig[order], of_part[order], last[order]
        rank, held = _ranks(of_part, len(used))
        most_apart = spoilt(own[used], parts)
        keep = rank <= most_apart[of_part]
        found.append((sig[keep], used[of_part[keep]], last[keep]))
        few = held <= most_apart
        if few.any():
            mine = few[of]
            e, o, c = elements[mine], of[mine], common_here[mine]
            order = np.lexsort((e, c, o))
            e, o, c = e[order], o[order], c[order]
            keep = _ranks(o, len(used))[0] <= own[used][o]
            found.append((mix(mix(e[keep], 8) + (inst[used][o[keep]] * 2 + 1).astype(np.uint64), 9), used[o[keep]], c[keep]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _signer(common: np.ndarray, copied: Bloom, first: Bloom):
    """Rows (key, class, common shingles, signature) of texts that stand for their class. A signature of common shingles alone
    is dealt to shares by class: key names one of them, and the signature stands beside it; for others it is null."""
    packed = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = Words(), np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in slices(batch.column(1)):
                sets, begin = shingle_sets(*words(data, offsets))
                classes, own = _hashes(sets, begin), ids[at : at + len(begin) - 1]
                _, once = np.unique(classes, return_index=True)
                once = once[~copied(classes[once].view(np.int64)) | _first(first, own[once], classes[once])] if len(once) else once
                # the first of a slice's copies may not be the class's own first row, which may stand later in the slice
                once = np.union1d(once, np.flatnonzero(copied(classes.view(np.int64)) & _first(first, own, classes)))
                sizes = np.diff(begin)[once]
                pick = np.repeat(begin[:-1][once] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                sets, begin, classes = sets[pick], np.concatenate([[0], np.cumsum(sizes)]), classes[once]
                sig, of, hot = signatures(sets, begin, bits)
                held = sums(bits[(sets & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int32), begin)
                key = np.where(hot, mix(sig + (classes[of] & np.uint64(SHARES - 1)), 11), sig)
                yield pa.RecordBatch.from_arrays([signed(key), signed(classes[of]), pa.array(held[of]), pa.array(sig.view(np.int64), mask=~hot)], ["key", "cls", "common", "sig"])

    return run


def _first(first: Bloom, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return first((mix(ids.astype(np.int64).view(np.uint64), 15) ^ classes).view(np.int64))


def _first_keys(copied: Bloom):
    """Keys of the first rows of all classes that the filter takes for copied ones, those that it takes wrongly included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(copied(batch.column("cls").to_numpy())))
            ids, classes = (batch.column(c).to_numpy().view(np.uint64) for c in ("rep", "cls"))
            yield pa.RecordBatch.from_arrays([signed(mix(ids, 15) ^ classes)], ["id"])

    return run


def near_classes(docs: DataFrame, classes: DataFrame, common: np.ndarray) -> DataFrame:
    """(cls, hub): each class that shares a signature with others, and the signature's hub."""
    # classes with most copies, as many as the filters can name; of others, every copy signs
    levels = sorted(classes.filter("copies > 1").groupBy(F.floor(F.log2("copies")).alias("level")).count().collect(), reverse=True)
    least, total = 62, 0
    for level, count in levels:
        if (total := total + count) > COPIED:
            break
        least = level
    copied = bloom(classes.filter(F.col("copies") >= F.lit(1 << max(1, least))), "cls")
    signer = _signer(common, copied, bloom(classes.select("rep", "cls").mapInArrow(_first_keys(copied), "id long"), "id"))
    rows = docs.filter("doc_id is not null").mapInArrow(signer, "key long, cls long, common int, sig long")
    by = Window.partitionBy("key").orderBy(F.desc("common"), "cls")
    met = rows.select("sig", "cls", F.lag("cls").over(by).alias("before"), F.first("cls").over(by).alias("hub"), F.first("common").over(by).alias("common"))
    met = cut(met.filter("(before is null or cls <> before) and (cls <> hub or sig is not null)").select("sig", "cls", "hub", "common"), "shared")
    hubs = met.filter("sig is not null").groupBy("sig").agg(F.max(F.struct("common", "hub")).getField("hub").alias("hub"))
    split = met.filter("sig is not null").select("sig", "cls").join(hubs, "sig").select("cls", "hub").filter("cls <> hub")
    return cut(met.filter("sig is null").select("cls", "hub").unionByName(split).distinct(), "near")


def _maps(column: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """Bitmaps of one length as rows of words."""
    values = column if rows is None else column.take(pa.array(rows))
    return np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in values])


def _apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits the bitmaps of each row differ, in the length of the shorter one."""
    out = np.zeros(len(x), np.int64)
    size = np.array([[len(v.as_buffer()) // 8 for v in c] for c in (x, y)]).reshape(2, -1)
    for a, b in {*zip(*size.tolist(), strict=True)}:
        rows = np.flatnonzero((size[0] == a) & (size[1] == b))
        both = folded(_maps(x, rows), min(a, b)) ^ folded(_maps(y, rows), min(a, b))
        out[rows] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and bitmaps: whether they may link, and the least Jaccard distance."""
    for batch in batches:
        n, m = batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy()
        apart = np.maximum(_apart(batch.column("bits_x"), batch.column("bits_y")), np.abs(n - m))
        may = (9 * apart <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(may), pa.array(2 * apart / (n + m + apart))], ["x", "y", "may", "least"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) that may link, of rows sorted by block; a block has those of one hub that are in one or two shares."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("hub", "low", "high")])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = batch.slice(a, b - a)
            if held and any(held[0].column(c)[0] != own.column(c)[0] for c in ("hub", "low", "high")):
                yield from _block(pa.Table.from_batches(held).combine_chunks().to_batches())
                held = []
            if len(own):
                held.append(own)
    if held:
        yield from _block(pa.Table.from_batches(held).combine_chunks().to_batches())


def _block(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    (rows,) = batches
    n, share, low, high = (rows.column(c).to_numpy() for c in ("n", "share", "low", "high"))
    is_open, least, most = rows.column("is_open").to_numpy(zero_copy_only=False), rows.column("least").to_numpy(), rows.column("most").to_numpy()
    root, node = rows.column("root").to_numpy(), rows.column("node").to_numpy()
    words = np.array([len(x.as_buffer()) // 8 for x in rows.column("bits")])
    maps = {w: (np.flatnonzero(words == w), _maps(rows.column("bits"), np.flatnonzero(words == w))) for w in set(words.tolist())}
    short = {(w, v): folded(m, v) for w, (_, m) in maps.items() for v in maps if v <= w}
    xs, ys = [], []
    for i in np.flatnonzero(is_open):
        may = (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i])) & (root != root[i])
        may &= (least[i] - most <= 0.2 + 1e-9) & (least - most[i] <= 0.2 + 1e-9)
        may &= (share != share[i]) | (low[i] == high[i])
        may &= ~is_open | (node > node[i])
        for w, (at, _) in maps.items():
            hit = may[at]
            if hit.any():
                v = min(w, int(words[i]))
                mine = folded(np.frombuffer(rows.column("bits")[i].as_buffer(), np.uint64)[None], v)
                apart = np.bitwise_count(short[w, v][hit] ^ mine).sum(axis=1, dtype=np.int64)
                found = at[hit][9 * apart <= n[at[hit]] + n[i]]
                xs.append(np.full(len(found), i))
                ys.append(found)
    x, y = (node[np.concatenate(v)] if v else np.zeros(0, np.int64) for v in (xs, ys))
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])


def _sets(wanted: Bloom):
    """The classes and sets of texts whose doc_id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch.column(0).to_numpy())))
            for first, data, offsets in slices(batch.column(1)):
                sets, begin = shingle_sets(*words(data, offsets))
                found = pa.array([sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), signed(_hashes(sets, begin)), found], ["rep", "cls", "shingles"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) with the sizes of their sets' intersection and union."""
    for batch in batches:
        both, union = [], []
        for x, y in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
            union.append(len(x) + len(y) - both[-1])
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["x", "y", "shared", "union_size"])


def measured(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes with shared and union_size. Texts are read again, but only sets in pairs are shuffled."""
    ids = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    needed = cut(nodes.join(ids, "node").select("node", "rep", "cls"), "needed")
    found = docs.filter("doc_id is not null").mapInArrow(_sets(bloom(needed, "rep")), "rep long, cls long, shingles binary")
    sets = cut(found.join(small(needed), ["rep", "cls"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")
    both = pairs.join(sets.toDF("x", "set_x"), "x").join(sets.toDF("y", "set_y"), "y")
    return cut(both.select("x", "y", "set_x", "set_y").mapInArrow(_compare, "x long, y long, shared long, union_size long"), "measured")


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.filter("100 * shared >= 80 * union_size").select(F.col("x").alias("u"), F.col("y").alias("v"))


def class_nodes(sized: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """(node, cls, cls2, rep, n, bits) of the classes in near, numbered."""
    ids = near.select("cls").unionByName(near.select(F.col("hub").alias("cls"))).distinct()
    firsts = classes.join(ids, "cls").select("cls", "cls2", F.col("rep").alias("doc_id"))
    nodes = sized.join(small(firsts), ["cls", "cls2", "doc_id"]).dropDuplicates(["cls", "cls2"])
    return cut(nodes.select(F.monotonically_increasing_id().alias("node"), "cls", "cls2", F.col("doc_id").alias("rep"), "n", "bits"), "nodes")


def links(docs: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Links (u, v) between nodes, enough of them for the components."""

    def side(key: str, name: str) -> DataFrame:
        return nodes.select(F.col("cls").alias(key), F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    star = near.join(side("hub", "x"), "hub").join(side("cls", "y"), "cls").select("x", "y", "n_x", "n_y", "bits_x", "bits_y")
    star = cut(star.mapInArrow(_sketched, "x long, y long, may boolean, least double"), "star")
    first = measured(docs, nodes, star.filter("may").select("x", "y"))
    rooted = cut(components(linked(first)), "rooted")
    # members of hubs, with what is known of their distance from the hub
    known = star.join(first, ["x", "y"], "left").join(rooted.toDF("x", "root_x"), "x", "left").join(rooted.toDF("y", "root_y"), "y", "left")
    exact, root_x, root_y = 1 - F.col("shared") / F.col("union_size"), F.coalesce("root_x", "x"), F.coalesce("root_y", "y")
    known = cut(known.select("x", "y", root_y.alias("root"), (root_x != root_y).alias("is_open"), F.coalesce(exact, "least").alias("least"), F.coalesce(exact, F.lit(1.0)).alias("most")), "members")
    hubs = known.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"), F.max("is_open").alias("any")).filter("any").drop("any")
    dealt = known.join(hubs, "x").join(nodes.select(F.col("node").alias("y"), "n", "bits"), "y").withColumn("share", F.pmod(F.xxhash64("y"), F.col("shares")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    block = dealt.select(
        F.col("x").alias("hub"), F.least("share", "other").alias("low"), F.greatest("share", "other").alias("high"), "share", F.col("y").alias("node"), "n", "bits", "root", "is_open", "least", "most"
    )
    by = ["hub", "low", "high"]
    rest = cut(block.repartition(*by).sortWithinPartitions(*by).mapInArrow(_members, "x long, y long").distinct(), "rest")
    return linked(first).unionByName(linked(measured(docs, nodes, rest)))


def ngram_components(docs: DataFrame) -> DataFrame:
    """Components of near-duplicate documents: (doc_id, n_shingles, component_id) for every row of docs.

    docs has doc_id (integer) and text. Two documents link when the Jaccard similarity of their sets of
    five-word shingles is 0.8 or more. component_id is the least doc_id reachable by links.
    A null or blank text has no shingles and is its own component; a row without doc_id gets its size and no
    component. Repeated rows get equal results; rows with one doc_id and different texts each have the component of
    their own text. Other columns are ignored, whatever their names. A table without rows gives none.
    """
    with scratch(docs.sparkSession):
        return keep(_components_of(docs))


def _components_of(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_classes, "doc_id long, n long, cls long, cls2 long, bits binary, piece int, counts binary"), "classes")
    sized = rows.filter("piece is null").drop("piece", "counts")
    common = common_shingles(rows.filter("piece is not null").select("piece", "counts"))
    classes = cut(sized.filter("n > 0 and doc_id is not null").groupBy("cls", "cls2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    near = near_classes(docs, classes, common)
    nodes = class_nodes(sized, classes, near)
    roots = cut(components(links(docs, nodes, near)).join(nodes.select("node", "rep", "cls", "cls2"), "node").select("root", "rep", "cls", "cls2"), "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    found = roots.join(least, "root").select(F.col("cls").alias("of"), F.col("cls2").alias("of2"), "least")
    found = small(found.unionByName(classes.filter("copies > 1").join(roots, ["cls", "cls2"], "left_anti").select("cls", "cls2", "rep").toDF("of", "of2", "least")))
    same = (F.col("n") > 0) & F.col("doc_id").isNotNull() & (F.col("cls") == F.col("of")) & (F.col("cls2") == F.col("of2"))
    return sized.join(found, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
