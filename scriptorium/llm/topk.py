"""Exact top-k search by inner product with dual cover trees (Beygelzimer, Kakade and Langford, "Cover Trees for Nearest
Neighbor", 2006; Curtin and Ram, "Dual-Tree Fast Exact Max-Kernel Search", 2014).

Queries and candidates are indexed alike. A node's children are a net of its vectors: each next centre is the vector farthest
from those before, until the net covers the node at 1/1.3 of its radius or has as many children as a node may have; so
centres are apart by the radius that the net covers, and each vector goes to its nearest one. The two upper levels, pivots
and cells, are nets of a bounded sample, by which all vectors are dealt to blocks (a table); below a block, the trees are
built where the block lies, down to leaves of a few vectors.

Of a pair of nodes with centres q and c and covering radii Q and C, no product exceeds <q, c> + Q |c| + C |q| + Q C. Each query
block first meets the blocks with the best centres below the best pivot; that gives every query a worst kth score. Then pairs of
pivots, of blocks below surviving pivots, and of nodes below surviving blocks are pruned whose bound is under the
least worst score of the pair's queries. Leaves that are left are multiplied as matrices.

Of equal vectors, only as many as can be results are kept, those with the least ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, keep, scratch

#: Vectors in a block of candidates and of queries, about.
CANDIDATES, QUERIES = 8192, 1024
#: Pivots at most, cells of a pivot at most, sampled vectors for each cell, and the components of all sampled vectors.
PIVOTS, CELLS, SAMPLED, COMPONENTS = 64, 64, 8, 1 << 21
#: Vectors of a leaf that is not split further, children of a node at most, and how much their radius is smaller.
LEAF, CHILDREN, RATIO = 128, 48, 1.3
#: Products held at a time, and candidates that a leaf of queries meets before it looks at its bounds again.
TILE, TOGETHER = 1 << 20, 256
_EXACT = 2.0**52


def _quantized(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append((v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return run


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are followed by zeros."""
    rows = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def net(x: np.ndarray, most: int, start: int = 0, limit: float = 0.0) -> tuple[list[int], np.ndarray]:
    """Rows of x that are centres, each farthest from those before, and for each row the nearest centre's number.

    There are at most so many centres; after the second, none is added once all rows are within limit of one.
    """
    centres, near, part = [start], ((x - x[start]) ** 2).sum(axis=1), np.zeros(len(x), np.int64)
    while len(centres) < most and near.max() > (limit**2 if len(centres) > 1 else 0.0):
        centres.append(int(near.argmax()))
        d = ((x - x[centres[-1]]) ** 2).sum(axis=1)
        part[d < near] = len(centres) - 1
        near = np.minimum(near, d)
    return centres, part


def upper_levels(vectors: DataFrame, cells: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pivot, its cells' centres): two levels of nets of a sample, of cells * SAMPLED vectors and COMPONENTS components at most."""
    ordered = vectors.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v")
    width = max(1, (vectors.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8)
    got = ordered.limit(max(1, min(cells * SAMPLED, COMPONENTS // width))).select("v").collect()
    x = _matrix(pa.array([bytes(r[0]) for r in got], pa.binary()), width)
    centres, _ = net(x, min(cells, PIVOTS * CELLS))
    # the farthest come first, so the pivots are a coarser net of the same centres
    pivots, below = x[centres[: min(PIVOTS, math.ceil(math.sqrt(len(centres))))]], x[centres]
    part = np.array([((pivots - c) ** 2).sum(axis=1).argmin() for c in below])
    return [(p, below[part == k]) for k, p in enumerate(pivots)]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """vectors (vec_id, v) with pivot and block, of about so many vectors at most. Blocks are numbered over all pivots."""
    n = vectors.count()
    if n <= size:
        return vectors.select("vec_id", "v", F.lit(0).alias("pivot"), F.lit(0).alias("block"))
    levels = upper_levels(vectors, 2 * -(-n // size))
    first = np.cumsum([0, *(len(below) for _, below in levels)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), levels[0][0].shape[0])
            pad = lambda c: np.pad(c, ((0, 0), (0, x.shape[1] - c.shape[1])))
            nearest = lambda rows, c: ((c**2).sum(axis=1)[None] - 2 * rows @ c.T).argmin(axis=1)
            pivot, cell = nearest(x, pad(np.stack([p for p, _ in levels]))), np.zeros(len(x), np.int64)
            for k, (_, below) in enumerate(levels):
                own = np.flatnonzero(pivot == k)
                if len(own):
                    cell[own] = nearest(x[own], pad(below))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array((first[pivot] + cell).astype(np.int32))], ["vec_id", "v", "pivot", "cell"])

    placed = cut(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary, pivot int, cell int"), "placed")
    rows, total = [], 0
    for cell, count in sorted(placed.groupBy("cell").count().collect()):  # PIVOTS * CELLS rows at most
        rows.append((cell, total, -(-count // size)))
        total += rows[-1][2]
    sizes = vectors.sparkSession.createDataFrame(rows, "cell int, start int, parts int")
    placed = placed.join(F.broadcast(sizes), "cell")
    return placed.select("vec_id", "v", "pivot", (F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"))


def _cover(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's centre and covering radius."""
    x = _matrix(pa.chunked_array([b.column("v") for b in batches]))
    centre = x.mean(axis=0)
    radius = math.sqrt(float(((x - centre) ** 2).sum(axis=1).max()))
    keys = [pa.array([k.as_py()], pa.int32()) for k in key]
    yield pa.RecordBatch.from_arrays([*keys, pa.array([centre.tobytes()]), pa.array([radius]), pa.array([len(x)])], ["pivot", "block", "centre", "radius", "n"])


def _cover_all(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pivot's centre and covering radius, from those of its blocks."""
    whole = pa.Table.from_batches(list(batches))
    x, radius = _matrix(whole.column("centre")), whole.column("radius").to_numpy()
    centre = x.mean(axis=0)
    most = float((np.sqrt(((x - centre) ** 2).sum(axis=1)) + radius).max())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([centre.tobytes()]), pa.array([most])], ["pivot", "centre", "radius"])


def bound(q: np.ndarray, c: np.ndarray, radius_q: float, radius_c: float) -> float:
    """No less than any product of a vector in one ball and one in the other."""
    a, b = math.sqrt(float(q @ q)), math.sqrt(float(c @ c))
    return float(q @ c) + radius_q * b + radius_c * a + radius_q * radius_c + 1 + 1e-9 * (a + radius_q) * (b + radius_c)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes (one, other) with their bound and the product of their centres."""
    for batch in batches:
        q, c = _matrix(batch.column("centre_q")), _matrix(batch.column("centre"))
        width = max(q.shape[1], c.shape[1])
        q, c = np.pad(q, ((0, 0), (0, width - q.shape[1]))), np.pad(c, ((0, 0), (0, width - c.shape[1])))
        radii = zip(batch.column("radius_q").to_pylist(), batch.column("radius").to_pylist(), strict=True)
        found = [bound(x, y, *r) for x, y, r in zip(q, c, radii, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("one"), batch.column("other"), pa.array(found, pa.float64()), pa.array((q * c).sum(axis=1))], ["one", "other", "bound", "product"])


def bounded(pairs: DataFrame) -> DataFrame:
    return pairs.select("one", "other", "centre_q", "radius_q", "centre", "radius").mapInArrow(_bounded, "one int, other int, bound double, product double")


class Tree:
    """A node of a cover tree: rows, centre and covering radius; children unless it is a leaf."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        own = x[rows]
        self.rows, self.centre, self.children = rows, own.mean(axis=0), []
        away = ((own - self.centre) ** 2).sum(axis=1)
        self.radius = math.sqrt(float(away.max()))
        if len(rows) > LEAF and self.radius > 0:
            centres, part = net(own, CHILDREN, int(away.argmin()), self.radius / RATIO)
            if len(centres) > 1:
                self.children = [Tree(x, rows[part == k]) for k in range(len(centres))]


class Nodes:
    """A tree's nodes in arrays, parents first and siblings side by side."""

    def __init__(self, tree: Tree):
        nodes, at = [tree], 0
        begin, end = [], []
        while at < len(nodes):
            begin.append(len(nodes))
            nodes += nodes[at].children
            end.append(len(nodes))
            at += 1
        self.begin, self.end, self.rows = np.array(begin), np.array(end), [n.rows for n in nodes]
        self.centre, self.radius = np.stack([n.centre for n in nodes]), np.array([n.radius for n in nodes])
        self.norm, self.leaf = np.sqrt((self.centre**2).sum(axis=1)), self.begin == self.end

    def below(self, at: np.ndarray, split: np.ndarray) -> np.ndarray:
        """The nodes at, those to be split replaced by their children."""
        n = self.end[at[split]] - self.begin[at[split]]
        children = np.repeat(self.begin[at[split]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.concatenate([at[~split], children])

    def bounds(self, at: np.ndarray, other: Tree) -> np.ndarray:
        """``bound`` of each node with another tree's node."""
        a, b, r = self.norm[at], math.sqrt(float(other.centre @ other.centre)), self.radius[at]
        return self.centre[at] @ other.centre + r * b + other.radius * a + r * other.radius + 1 + 1e-9 * (a + r) * (b + other.radius)


class Search:
    """The k best candidates of each query, over one pair of blocks."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, least: np.ndarray):
        order = np.argsort(c_ids, kind="stable")
        self.q, self.q_ids, self.c, self.c_ids, self.k = q, q_ids, c[order], c_ids[order], k
        #: Products at or over the worst kth score are of use.
        self.worst = least.astype(np.float64)
        self.scores = [[] for _ in q_ids]
        #: Products computed; what is pruned lacks to len(q) * len(c).
        self.products = 0
        largest = math.sqrt(float((q**2).sum(axis=1).max())) * math.sqrt(float((c**2).sum(axis=1).max()))
        self.exact = largest < _EXACT
        self._visit(Tree(self.q, np.arange(len(q))), Tree(self.c, np.arange(len(c))))

    def _visit(self, query: Tree, candidate: Tree) -> None:
        """Goes down both trees: a node of queries with the candidates' nodes that may be of use for it."""
        nodes, stack = Nodes(candidate), [(query, np.zeros(1, np.int64))]
        while stack:
            a, at = stack.pop()
            while True:
                bounds = nodes.bounds(at, a)
                keep = bounds >= self.worst[a.rows].min()
                at, bounds = at[keep], bounds[keep]
                # nodes wider than the queries' give way to their children; at a leaf of queries, all do
                split = ~nodes.leaf[at] & ((nodes.radius[at] > a.radius) | (not a.children))
                if not split.any():
                    break
                at = nodes.below(at, split)
            if a.children:
                stack += [(c, at) for c in a.children] if len(at) else []
                continue
            order = np.argsort(-bounds, kind="stable")
            at, bounds, begin = at[order], bounds[order], 0
            while begin < len(at) and bounds[begin] >= self.worst[a.rows].min():
                found = [nodes.rows[at[begin]]]
                count = len(found[0])
                begin += 1
                while begin < len(at) and count < TOGETHER:
                    found.append(nodes.rows[at[begin]])
                    count += len(found[-1])
                    begin += 1
                self._multiply(a.rows, np.concatenate(found))

    def _multiply(self, queries: np.ndarray, candidates: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(candidates)))
        for at in range(0, len(queries), step):
            rows = queries[at : at + step]
            for to in range(0, len(candidates), TILE):
                columns = np.sort(candidates[to : to + TILE])
                self.products += len(rows) * len(columns)
                self._keep(rows, columns, self._products(rows, columns))

    def _products(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if self.exact:
            return self.q[rows] @ self.c[columns].T
        whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object)
        return whole(self.q[rows]) @ whole(self.c[columns]).T

    def _keep(self, rows: np.ndarray, columns: np.ndarray, product: np.ndarray) -> None:
        for i in np.flatnonzero((product >= self.worst[rows][:, None]).any(axis=1)):
            row = rows[i]
            # columns are in the order of ids, so a stable sort leaves ties to the least id
            hit = np.flatnonzero(product[i] >= self.worst[row])
            if len(hit) > 4 * self.k and self.exact:
                edge = np.partition(product[i, hit], len(hit) - self.k - 1)[len(hit) - self.k - 1]  # one more: the query itself may be among them
                hit = hit[product[i, hit] >= edge]
            found = self.scores[row]
            found.extend((-int(product[i, h]), int(self.c_ids[columns[h]])) for h in hit if self.c_ids[columns[h]] != self.q_ids[row])
            found.sort()
            del found[self.k :]
            if len(found) == self.k:
                self.worst[row] = max(self.worst[row], -found[-1][0])


def _searcher(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return empty
        q, c = _matrix(left.column("v")), _matrix(right.column("v"))
        width = max(q.shape[1], c.shape[1])
        q, c = np.pad(q, ((0, 0), (0, width - q.shape[1]))), np.pad(c, ((0, 0), (0, width - c.shape[1])))
        q_ids, least = left.column("vec_id").to_numpy(), np.array([-np.inf if x is None else float(x) for x in left.column("worst").to_pylist()])
        found = Search(q, q_ids, c, right.column("vec_id").to_numpy(), k, least).scores
        limit = (1 << 63) - 1
        rows = [(int(i), v, max(-limit - 1, min(limit, -s))) for i, own in zip(q_ids, found, strict=True) for s, v in own]
        if not rows:
            return empty
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), zip(*rows, strict=True), strict=True)})

    return run


def top_k(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, scale: float = 1024.0, candidates: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """The k best rows for each query by integer inner product: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    vectors has vec_id (integer) and embedding (array of numbers), of which each component x is taken as floor(scale * x).
    queries says which rows are queries; every row but those of the query's own vec_id is a candidate. Rows whose id or
    vector is null, or whose vector holds a null or a component that is not finite, take no part; a shorter vector counts
    as followed by zeros. Rows equal in id and vector count once. A query has fewer than k rows if there are fewer
    candidates. Scores outside the range of a long are set to its ends.
    """
    with scratch(vectors.sparkSession):
        return keep(_best(vectors, queries, k, scale, candidates, query_block))


def _best(vectors: DataFrame, queries: str, k: int, scale: float, candidates: int, query_block: int) -> DataFrame:
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_quantized(scale), "vec_id long, v binary")
    clean = cut(clean.distinct(), "vectors")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = cut(clean.withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy"), "distinct")
    of_queries = cut(clean.filter(queries), "queries")
    if kept.isEmpty() or of_queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    c = cut(blocks(kept, candidates), "candidates")
    q = cut(blocks(of_queries, query_block).withColumnsRenamed({"block": "qblock", "pivot": "qpivot"}), "queries")
    covers = "pivot int, block int, centre binary, radius double, n long"
    of_c = cut(c.groupBy("pivot", "block").applyInArrow(_cover, covers), "covers")
    of_q = cut(q.groupBy("qpivot", "qblock").applyInArrow(_cover, covers), "covers").drop("n").toDF("qpivot", "qblock", "centre_q", "radius_q")
    # pivots are PIVOTS at most on either side, so their pairs are few whatever the input
    upper = "pivot int, centre binary, radius double"
    up_c = of_c.groupBy("pivot").applyInArrow(_cover_all, upper)
    up_q = of_q.select(F.col("qpivot").alias("pivot"), F.col("centre_q").alias("centre"), F.col("radius_q").alias("radius")).groupBy("pivot").applyInArrow(_cover_all, upper).toDF("one", "centre_q", "radius_q")
    upper_pairs = up_q.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(PIVOTS - 1)))).join(up_c.withColumnRenamed("pivot", "other"), "other")
    upper_pairs = cut(bounded(upper_pairs), "pivots").withColumnsRenamed({"one": "qpivot", "other": "pivot"})

    def below(chosen: DataFrame) -> DataFrame:
        """Pairs of blocks below pairs of pivots."""
        both = of_q.join(chosen.select("qpivot", "pivot"), "qpivot").join(of_c, "pivot")
        return bounded(both.withColumnsRenamed({"qblock": "one", "block": "other"})).withColumnsRenamed({"one": "qblock", "other": "block"})

    def search(chosen: DataFrame, q: DataFrame) -> DataFrame:
        left = q.join(chosen.select("qblock", "block"), "qblock").select("qblock", "block", "vec_id", "v", "worst")
        right = c.join(chosen.select("qblock", "block"), "block").select("qblock", "block", "vec_id", "v")
        by = ["qblock", "block"]
        return cut(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searcher(k), "query_id long, vec_id long, score long"), "found")

    near = Window.partitionBy("qpivot").orderBy(F.desc("product"), "pivot")
    start = below(upper_pairs.withColumn("order", F.row_number().over(near)).filter("order = 1"))
    # the best blocks that have k vectors besides a query together
    ahead = Window.partitionBy("qblock").orderBy(F.desc("product"), "block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = start.join(of_c.select("block", "n"), "block").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    seeds = cut(seeds.filter(F.col("before") <= k).select("qblock", "block"), "seeds")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = search(seeds, q.withColumn("worst", F.lit(None).cast("long")))
    worst = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    q = cut(q.join(worst, "vec_id", "left"), "worst")
    # a query without k scores keeps all pairs of its block and pivot
    least = F.when(F.count("worst") == F.count("*"), F.min("worst")).alias("least")
    alive = upper_pairs.join(q.groupBy("qpivot").agg(least), "qpivot").filter("least is null or bound >= least")
    open_pairs = below(alive).join(q.groupBy("qblock").agg(least), "qblock").filter("least is null or bound >= least")
    rest = search(cut(open_pairs.join(seeds, ["qblock", "block"], "left_anti").select("qblock", "block"), "pairs"), q)
    ranks = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
