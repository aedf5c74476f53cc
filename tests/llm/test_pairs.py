"""Near-duplicate joins, line dedup, top-k search and decontamination against brute force."""

import contextlib
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut, shared_dir
from scriptorium.llm import decontaminate, hashing, line_dedup, ngram_join, prefilter, topk
from scriptorium.llm.graphs import components
from scriptorium.llm.ngram_join import ngram_components

DOCS = "doc_id long, text string"


def _lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", _lower(t))


def _shingles(t):
    w = _words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def _roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _mutated(r, words, n):
    out = list(words)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i] = r.choice(["w%d" % r.randrange(5000), out[i] + "x"])
    return out


def _near_corpus(seed):
    r = random.Random(seed)
    texts = ["", None, "   ", "one", "One  ONE", "a b c d", "a b c d e", "A b\tc d e"]
    passage = [f"p{i}" for i in range(50)]
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([4, 8, 15, 40, 120, 400]))]
        texts += [" ".join(_mutated(r, base, r.choice([0, 1, 1, 2, 3, len(base) // 60, len(base) // 30]))) for _ in range(14)]
    for _ in range(60):  # a passage with little besides, and near copies around one text
        texts.append(" ".join([*passage, *(f"q{r.randrange(9000)}" for _ in range(r.choice([0, 3, 8, 14, 60])))]))
        texts.append(" ".join(_mutated(r, [f"hub{i}" for i in range(150)], r.randrange(6))))
    texts += [t for t in texts[20:40]]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components(spark, seed):
    texts = _near_corpus(seed)
    rows = [(i * 3 + 1, t, "extra", i) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, f"{DOCS}, cls string, n int").repartition(3)).collect()}
    sets = {i: _shingles(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    assert got == {i: (len(s), roots[i]) for i, s in sets.items()}


def test_ngram_components_of_odd_tables(spark):
    empty = ngram_components(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0
    long = " ".join(f"v{i % 20011}" for i in range(120_000))
    rows = [(5, long), (9, long + " end"), (None, "a b c d e f"), (7, None), (3, "x"), (3, "y z"), (4, "x")]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_components(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(0, 2, 0), (3, 1, 3), (3, 1, 3), (4, 1, 3), (5, 20011, 5), (7, 0, 7), (9, 20012, 5)]


def test_operators_leave_one_table(spark):
    """What an operator cuts on its way is deleted at its end, but for the table that its result reads."""
    folder = shared_dir(spark).removeprefix("file:")
    docs = spark.createDataFrame([(1, "a b c d e f g\nh i j k l"), (2, "a b c d e f g\nh i j k l m")], DOCS)
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 1.0])], "vec_id long, embedding array<double>")
    for f in (lambda: ngram_components(docs), lambda: line_dedup.dedup_lines(docs), lambda: topk.top_k(vectors)):
        before = set(os.listdir(folder))
        found = f()
        assert len(set(os.listdir(folder)) - before) == 1 and found.count() == 2


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(0)
    common = np.zeros(ngram_join.COUNTERS, bool)
    common[::3] = True
    for t in range(1500):
        n = int(r.integers(4, 700 if t % 2 else 40))
        m = int(r.integers((4 * n + 4) // 5, n * 5 // 4 + 1))
        both = -(-4 * (n + m) // 9)
        x = r.integers(1, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[:both], r.integers(1, 2**63, m - both, dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        assert 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
        sig, of, _ = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), common)
        assert len(np.intersect1d(sig[of == 0], sig[of == 1]))


def _brute_components(rows):
    """By row number: rows with equal ids are apart unless their texts link."""
    sets = [_shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[roots[k]] = min(i, least.get(roots[k], i))
    return sorted((i, len(s), least[roots[k]]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_ngram_components_of_repeated_ids(spark):
    r = random.Random(4)
    u, b = ([f"{p}{i}" for i in range(60)] for p in "ub")
    rows = [(1, " ".join(u)), (3, " ".join([*u, "x"])), (3, " ".join(b)), (8, " ".join(b)), (8, " ".join(b)), (9, " ".join(u))]
    rows += [(r.randrange(6), " ".join(_mutated(r, u if k % 2 else b, r.randrange(4)))) for k in range(40)]
    got = ngram_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(tuple(x) for x in got) == _brute_components(rows)


def test_ngram_components_with_filters_that_err(spark, monkeypatch):
    """Filters that take most classes for copied ones, and most ids for wanted ones, lose no link."""
    for name, value in (("SPARE", 1), ("HASHES", 1), ("LEAST", 6)):
        monkeypatch.setattr(prefilter, name, value)
    texts = [t for t in _near_corpus(3) if t]
    rows = list(enumerate(texts + texts[::3]))
    got = sorted(tuple(x) for x in ngram_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert got == _brute_components(rows)


def test_ngram_components_of_crowds(spark, monkeypatch):
    """A thousand near copies around several centres, in blocks of few; many of them are apart from their hub."""
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    r = random.Random(9)
    centres = [[f"c{k}w{i}" for i in range(150)] for k in range(3)]
    centres.append(_mutated(r, centres[0], 5))
    rows = [(i, " ".join(_mutated(r, r.choice(centres), r.randrange(9)))) for i in range(1000)]
    got = sorted(tuple(x) for x in ngram_components(spark.createDataFrame(rows, DOCS).repartition(4)).collect())
    assert got == _brute_components(rows) and len({x[2] for x in got}) > 20


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = _roots({x for e in real for x in e}, real)
    assert got == want


def test_words_of_any_text():
    r = random.Random(5)
    marks = [" ", "\n", "\t", "\x0b", "a", "B", "é", "\xa0", "ｗ", "0", "-"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(500)]
    words = hashing.Words()
    counts = [n for _, data, offsets in hashing.slices(pa.array(texts), 64) for n in np.diff(words(data, offsets)[1])]
    assert counts == [len(_words(t)) for t in texts]


def _alternating(n, a="a", b="b"):
    """Two words of n letters that have equal sums of powers (Thue and Morse)."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    """Texts of long words of two letters, and one-word lines whose names share many bits in some hashes, are all different."""
    texts = [x for n in (8, 64, 1024, 2048, 4096) for p in ("ab", ("a" * 8, "b" * 8), ("ab" * 8, "ba" * 8)) for x in _alternating(n, *p)]
    texts += ["id01900555", "id04218146", "id01900555 x", "x id04218146"]
    rows = list(enumerate(dict.fromkeys(texts)))
    docs = spark.createDataFrame(rows, DOCS)
    assert {(x.doc_id, x.component_id) for x in ngram_components(docs).collect()} == {(i, i) for i, _ in rows}
    assert {(x.doc_id, x.text) for x in line_dedup.dedup_lines(docs).collect()} == set(rows)
    words = hashing.Words()
    ((_, data, offsets),) = hashing.slices(pa.array([t for _, t in rows]), 1 << 30)
    one, two, _ = words.twice(data, offsets)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len({w for _, t in rows for w in t.split()}) and not set(one.tolist()) & set(two.tolist())


def test_hashes_of_many_words():
    """Six million names of one form, and random words in upper and lower case, have hashes of their own."""
    words = hashing.Words()
    seen = [words(data, offsets)[0] for k in range(0, 6_000_000, 500_000) for _, data, offsets in hashing.slices(pa.array([" ".join(f"id{i:08d}" for i in range(k, k + 500_000))]))]
    assert len(np.unique(np.concatenate(seen))) == 6_000_000
    r = random.Random(1)
    texts = ["".join(r.choice("abAB\0 é") for _ in range(r.randint(0, 30))) for _ in range(5000)]
    got = [h for _, data, offsets in hashing.slices(pa.array(texts), 300) for h in words(data, offsets)[0].tolist()]
    known = {}
    for w, h in zip((w for t in texts for w in _words(t)), got, strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def _line_corpus(seed):
    r = random.Random(seed)
    pool = [[f"t{r.randrange(80)}" for _ in range(r.choice([1, 2, 4, 5, 6, 9, 12, 25, 60]))] for _ in range(30)]
    docs = []
    for _ in range(50):
        lines = []
        for _ in range(r.randrange(7)):
            base = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                base[r.randrange(len(base))] = f"t{r.randrange(4000)}"
            lines.append(" ".join(base).upper() if r.random() < 0.1 else " ".join(base))
            if r.random() < 0.1:
                lines.append("  ")
        docs.append("\n".join(lines))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    docs = list(enumerate(_line_corpus(seed))) + [(1000, None), (1001, ""), (1002, "end\n"), (1003, "\n\nend")]
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t, "x") for i, t in docs], f"{DOCS}, line string").repartition(3)).collect()}
    seen, want = [], {}
    for i, t in docs:
        gone = []
        lines = (t or "").split("\n")
        for k, line in enumerate(lines):
            own = set(_words(line))
            if own:
                if any(100 * len(own & s) >= 80 * len(own | s) for s in seen):
                    gone.append(k)
                seen.append(own)
        want[i] = (gone, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert got == want


def test_line_dedup_of_odd_columns(spark):
    """Columns of internal names, those that are replaced, repeated rows, and an id in a text column's type."""
    rows = [(i, t, "u", [9], 7, "cls", i) for i, t in [(1, "a b c d e\nx"), (2, "A b c  d e\ny"), (2, "A b c  d e\ny"), (3, None), (None, "a b c d e")]]
    docs = spark.createDataFrame(rows, f"{DOCS}, gone_lines string, removed_lines array<int>, n_lines int, cls string, gone_id int")
    got = [(x.doc_id, x.text, x.removed_lines, x.gone_lines, x.cls, x.gone_id) for x in line_dedup.dedup_lines(docs).collect()]
    want = [(1, "a b c d e\nx", [], "u", "cls", 1), (2, "y", [0], "u", "cls", 2), (2, "y", [0], "u", "cls", 2), (3, None, [], "u", "cls", 3), (None, "a b c d e", [], "u", "cls", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_of_long_texts(spark):
    """A text of 20 MB, all of whose lines but the first are repeated, and one of a single line."""
    base = [f"line {k} of {k * 7} has {k % 13} words {k + 5}" for k in range(300_000)]
    one = " ".join(f"w{k}" for k in range(400_000))
    docs = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(["first of all words here", *base])), (3, one), (4, one + " more")], DOCS)
    began = time.time()
    got = {x.doc_id: (x.n, x.text) for x in line_dedup.dedup_lines(docs).select("doc_id", F.size("removed_lines").alias("n"), "text").collect()}
    assert got[2] == (300_000, "first of all words here") and got[3] == (0, one) and got[4] == (1, "")
    assert time.time() - began < 240


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def _brute_top(rows, k, scale=1024):
    usable = {(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, q in usable:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in usable if j != i)
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 1024), (70, 3)])
def test_top_k(spark, blocks):
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 5]] if i % 3 else [r.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    rows += [(2000 + i, rows[1][1]) for i in range(40)] + [(100, rows[5][1]), (5000, None), (5001, [1.0, None]), (5002, [float("nan")]), (5100, [float("inf"), 1.0]), (5200, []), (5300, [0.5]), (None, [1.0] * 6)]
    rows = [x for x in rows if x[0] != 100] + [(100, rows[100][1])] * 2
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, block int").repartition(4)
    got = topk.top_k(df, candidates=blocks[0], query_block=blocks[1])
    assert {tuple(x) for x in got.collect()} == _brute_top(rows, 10)
    assert got.count() == len(_brute_top(rows, 10))


@pytest.mark.parametrize("spread, most", [(0.05, 0.2), (0.3, 0.7)])
def test_trees_prune_products(spread, most):
    """Vectors in clusters of 64 dimensions: most products are never computed, and no result is lost."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 64))
    x = np.floor(1024 * (centres[r.integers(0, 40, 9000)] + spread * r.normal(size=(9000, 64))))
    q, ids = x[:400], np.arange(9000)
    tree = topk.Tree(x, ids)
    stack, seen, depth = [(tree, 1)], [], 0
    while stack:
        node, level = stack.pop()
        depth = max(depth, level)
        assert np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        assert sorted(i for c in node.children for i in c.rows) == sorted(node.rows) or not node.children
        stack += [(c, level + 1) for c in node.children]
        seen += [] if node.children else node.rows.tolist()
    assert sorted(seen) == ids.tolist() and depth > 2
    found = topk.Search(q, ids[:400], x, ids, 10, np.full(400, -np.inf))
    want = [sorted((-int(s), int(j)) for j, s in enumerate(x @ v) if j != i)[:10] for i, v in enumerate(q)]
    assert found.scores == want and found.products <= most * 400 * 9000


def test_pivots_prune_blocks(spark, monkeypatch):
    """Clusters far apart: few pairs of blocks are searched, and all results are those of brute force."""
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.02) for x in centres[i // 100]]) for i in range(1200)]
    met = []
    monkeypatch.setattr(topk, "scratch", lambda session: contextlib.nullcontext())
    monkeypatch.setattr(topk, "cut", lambda df, name: met.append((name, cut(df, name))) or met[-1][1])
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), candidates=100, query_block=1).collect()
    assert {tuple(x) for x in got} == _brute_top(rows, 10)
    blocks = dict(met)["candidates"].select("block").distinct().count()
    assert blocks >= 12 and dict(met)["pairs"].count() <= 0.4 * 12 * blocks


def test_top_k_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one).count() == 0 and topk.top_k(one.limit(0)).count() == 0
    large = [(0, [3e12, 1.0]), (1, [2e12, 5.0]), (2, [2e12, 5.0]), (3, [-1.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), k=2).collect()
    assert [(g.rank, g.vec_id) for g in sorted(got, key=lambda g: g.rank)] == [(1, 1), (2, 2)]


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance():
    r = random.Random(3)
    for _ in range(400):
        p, t = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(1, 12), r.randint(0, 30)))
        assert decontaminate.edits(decontaminate.bit_sets(p), len(p), t)[0] == _distance(p, t)


def test_leaks(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 12, 30, 30)] + [None, ""]
    docs = []
    for _ in range(60):
        body = [word() for _ in range(r.randint(0, 60))]
        text = list(r.choice([i for i in items if i]))
        for _ in range(r.randrange(1 + len(text) // 8)):
            text[r.randrange(len(text))] = r.choice(["", "z", "qq"])
        body.insert(r.randint(0, len(body)), "".join(text))
        docs.append(" ".join(body))
    docs += [None, "", items[2].upper().replace(" ", "!! \n"), "É " * 40]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], f"{DOCS}, edits int").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, items[3])], "item_id long, text string")
    norm = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    want = {}
    for i, d in enumerate(docs):
        for k, t in [*enumerate(items), (9, items[3])]:
            t = norm(t)
            if len(t.split()) >= 5 and (n := _distance(t, norm(d))) <= len(t) // 12:
                want[i, k] = n
    for chars in (1 << 20, 100):  # one pass, and several
        got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.leaks(table, bench, pass_chars=chars).collect()}
        assert got == want and len(want) > 30
    clean = {x.doc_id for x in decontaminate.decontaminate(table, bench).collect()}
    assert clean == set(range(len(docs))) - {i for i, _ in want}
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0 and decontaminate.leaks(table.limit(0), bench).count() == 0
    assert table.filter(F.col("doc_id") < 0).count() == 0


def test_crowds_of_similar_lines(spark, monkeypatch):
    """Shares of hot words, groups over many batches, and classes that meet more candidates than the first."""
    for name, value in (("FIRST", 1), ("HOT_LOG", 3), ("ROWS", 64)):
        monkeypatch.setattr(line_dedup, name, value)
    r = random.Random(5)
    base = [f"t{i}" for i in range(40)]
    lines = []
    for _ in range(220):
        own = list(base)
        for _ in range(r.randrange(7)):
            own[r.randrange(len(own))] = r.choice([f"t{r.randrange(40)}", f"u{r.randrange(60)}"])
        lines.append(" ".join(own))
    docs = [(i, "\n".join(lines[2 * i : 2 * i + 2])) for i in range(110)]
    r.shuffle(docs)
    got = {x.doc_id: x.removed_lines for x in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS).repartition(4)).collect()}
    sets = [set(x.split()) for x in lines]
    gone = [any(100 * len(a & b) >= 80 * len(a | b) for a in sets[:k]) for k, b in enumerate(sets)]
    assert got == {i: [k for k in (0, 1) if gone[2 * i + k]] for i in range(110)} and 20 < sum(gone) < 218


def test_leaks_in_long_texts_and_odd_tables(spark):
    """A text of 6 MB with an item at its end, repeated rows, a row without doc_id, and columns of any name."""
    item = "what is the boiling point of water at the top of a high mountain in degrees"
    long = "many words of no item at all " * 200_000 + item.replace("high", "hihg")
    rows = [(1, long, 0, "x"), (2, item, 0, "x"), (2, item, 0, "x"), (None, item, 0, "x"), (3, None, 0, "x"), (4, "clean", 0, "x")]
    docs = spark.createDataFrame(rows, f"{DOCS}, edits int, __leaked string")
    bench = spark.createDataFrame([(7, item, "en"), (8, None, None), (7, item, "en")], "item_id long, text string, doc_id string")
    got = sorted((x.doc_id, x.item_id, x.edits, x.first_word) for x in decontaminate.leaks(docs, bench, least_words=1).collect())
    assert got == [(1, 7, 2, 1_400_000), (2, 7, 0, 0)]
    left = decontaminate.decontaminate(docs, bench, least_words=1)
    assert left.columns == docs.columns and sorted((x.doc_id or 0) for x in left.collect()) == [0, 3, 4]


def test_leaks_of_items_of_few_words(spark):
    chinese = "光合作用是绿色植物利用光能把二氧化碳和水合成为有机物并释放氧气的过程" * 4
    items = [chinese, "你好世界", "Who?", "internationalization considerations explained", "cat", "...", "café", "สวัสดี"]
    docs = [f"前言{chinese}结尾", "他说你好世界然后离开", "and WHO, then", "whoever", f"{chinese[:60]}错{chinese[61:]}", "an internationalisation considerations explained here", "concatenate", "the “cat” sat", "", "cafés", "café café", "ไทยสวัสดีครับ", "x"]
    table = spark.createDataFrame(list(enumerate(docs)), DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(0, 0): 0, (1, 1): 0, (2, 2): 0, (4, 0): 1, (5, 3): 1, (7, 4): 0, (10, 6): 0, (11, 7): 0}
    for chars in (1 << 20, 10):
        assert {(x.doc_id, x.item_id): x.edits for x in decontaminate.leaks(table, bench, least_words=1, pass_chars=chars).collect()} == want
    place = decontaminate.leaks(table, bench, least_words=1).filter("doc_id = 2").first()
    assert (place.first_word, place.n_words) == (1, 1)
    assert {x.doc_id for x in decontaminate.decontaminate(table, bench, least_words=1).collect()} == {3, 6, 8, 9, 12}


def test_queries_search_for_short_items(spark, tmp_path):
    import corpus_pipeline
    from scriptorium.llm.registry import QUERIES

    spark.createDataFrame([(1, "他说你好世界然后离开", "zh", "a", 10), (2, "nothing of it", "en", "a", 13)], f"{DOCS}, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "你好世界")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(x.doc_id, x.item_id) for x in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [x.doc_id for x in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()] == [2]


def test_ranked_search_holds_few_clusters_at_once(spark, monkeypatch):
    """A row of the index is large, so readers and Python workers get few at once; the session's settings come back."""
    from scriptorium.llm import ranked

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, seen, plain = [spark.conf.get(x) for x in names], [], ranked._search_pass
    monkeypatch.setattr(ranked, "_search_pass", lambda *a: (seen.append([int(spark.conf.get(x)) for x in names]), plain(*a))[1])
    docs = spark.createDataFrame([(i, f"common w{i % 7} x{i}") for i in range(300)], "doc_id long, text string")
    got = ranked.ranked(docs, spark.createDataFrame([(1, "x9 w2"), (2, "none")], "item_id long, text string"), most=4)
    assert [r.doc_id for r in got.orderBy("item_id", "rank").limit(2).collect()] == [9, 2] and got.filter("item_id = 2").isEmpty()
    assert seen and all(x <= ranked.CLUSTERS_AT_ONCE <= 16 for s in seen for x in s)
    assert [spark.conf.get(x) for x in names] == before


def test_line_dedup_verifies_by_wanted_lines_alone(spark):
    """Sets are made of the lines asked for, by document and number, and not of the document's other lines."""
    rows = [(7, "one two three\nfour five six\n\nseven eight"), (-5, "four five six\nseven eight"), (2**62, "nine\nten")]
    asked = spark.createDataFrame([(7, 1), (-5, 1), (2**62, 0)], "doc_id long, line int")
    every = pa.RecordBatch.from_pydict({"doc_id": [x for x, _ in rows], "text": [x for _, x in rows]})
    words = hashing.Words()
    want = {tuple(np.sort(words(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0])) for x in (b"four five six", b"seven eight", b"nine")}
    any_class = prefilter.Bloom(np.full(1024, 2**64 - 1, np.uint64))
    got = list(line_dedup._chosen_lines(prefilter.bloom(asked, line_dedup._place()), any_class)(iter([every])))
    assert {tuple(np.frombuffer(x.as_py(), np.uint64)) for b in got for x in b.column("words")} == want


def test_line_dedup_deals_blocks(spark, monkeypatch):
    """Rows of prefix words are dealt in blocks of one bucket, far fewer than the rows; opened, they are the same rows in order."""
    r = random.Random(3)
    texts = ["\n".join(" ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([5, 20, 60]))) for _ in range(20)) for _ in range(400)]
    every = pa.RecordBatch.from_pydict({"doc_id": [i * 7919 - 10**12 for i in range(400)], "text": texts})
    rank = np.full(line_dedup.COUNTERS, 3, np.uint8)
    plain = line_dedup._prefixes(rank.tobytes())
    table = pa.Table.from_batches(list(plain(iter([every])))).sort_by([("key", "ascending"), ("doc", "ascending"), ("line", "ascending")])
    blocks = [(b, x.as_py()) for batch in line_dedup._blocks(plain, 6)(iter([every])) for b, x in zip(batch.column(0).to_pylist(), batch.column(1))]
    assert {b for b, _ in blocks} == set(range(64)) and 100 * len(blocks) < table.num_rows
    width = line_dedup._WIDTHS.sum()
    opened = line_dedup._opened([np.frombuffer(x, np.uint8).reshape(width, -1) for _, x in blocks])
    assert all((got == table.column(c).to_numpy()).all() for got, c in zip(opened, line_dedup._COLUMNS, strict=False))
    assert 1 == line_dedup.bucket_bits(np.zeros(1 << 10, np.uint8)) < line_dedup.bucket_bits(np.full(1 << 20, 5, np.uint8)) <= 11
    assert line_dedup.bucket_bits(np.full(1 << 20, 20, np.uint8)) > 15  # 10^11 rows: buckets grow in number, not in size
    monkeypatch.setattr(line_dedup, "BLOCK", 10)
    assert max(len(x) for batch in line_dedup._blocks(plain, 1)(iter([every])) for x in batch.column(1).to_pylist()) <= 10 * width


def test_line_dedup_meets_the_rest_by_wanted_lines_alone(spark):
    """Prefix words of classes that meet all their candidates are taken from those classes' lines; other lines are not looked at."""
    rows = [(7, "one two three four\nfive six seven eight\nnine ten eleven twelve"), (8, "a b c d\nfive six seven eight")]
    every = pa.RecordBatch.from_pydict({"doc_id": [x for x, _ in rows], "text": [x for _, x in rows]})
    rank = np.zeros(line_dedup.COUNTERS, np.uint8).tobytes()
    asked = prefilter.bloom(spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, line int"), line_dedup._place())
    got = [(x["doc"], x["line"], x["n"]) for b in line_dedup._prefixes(rank, of_lines=asked)(iter([every])) for x in b.to_pylist()]
    assert sorted(set(got)) == [(7, 1, 4), (8, 0, 4)]
    want = {x["key"] for b in line_dedup._prefixes(rank)(iter([every])) for x in b.to_pylist() if (x["doc"], x["line"]) in {(7, 1), (8, 0)}}
    assert {x["key"] for b in line_dedup._prefixes(rank, of_lines=asked)(iter([every])) for x in b.to_pylist()} == want
