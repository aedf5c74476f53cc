"""Operators over corpora: collocations, web archives, ranked search; all against plain restatements."""

import base64
import collections
import gzip
import hashlib
import io
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import cuts
from scriptorium.llm import collocations, ranked, warc
from scriptorium.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _brute_phrases(rows, least, depth, percent, top):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(g == lang and len(q) > len(p) and inside(q) and 100 * b >= percent * a for (g, q), b in found.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, x, y) in enumerate(sorted(all_)[:top])}


@pytest.mark.parametrize(("depth", "shard"), [(3, 1 << 20), (3, 300), (5, 2000)])
def test_collocations(spark, depth, shard):
    r = random.Random(depth)
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x00", "  ", "!? ", " a a a a ", " the big ", " New York City ", "é", "ß"]
    texts = ["".join(r.choice(["a", "B", "b", "the", "ße", "x y", "of"]) + r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(150)]
    rows = [(i, t, r.choice(["en", "de", None]), "own") for i, t in enumerate([*texts, None, "", ".", *texts[:20]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string")
    got = {tuple(x) for x in collocations.collocations(docs, 4, depth, 50, 40, shard_bytes=shard, log=26 if depth == 3 else 6).collect()}  # with few counters, many rare phrases pass on
    assert got == _brute_phrases([(x[2], x[1]) for x in rows], 4, depth, 50, 40) and len(got) > 50


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_states_are_those_of_an_automaton():
    r = random.Random(3)
    words = [r.choice("abc") for _ in range(200)]
    text = " ".join(words)
    found = collections.Counter()
    shard = collocations.Shard(pa.array(["x"]), pa.array([text]), 4)
    all_ = [np.ones(len(e), bool) for e in shard.automaton.ends]
    for batch in shard.states(all_):
        for row in batch.to_pylist():
            for k in range(row["shortest"], row["longest"] + 1):
                if k:
                    p = tuple(row["phrase"].split(" ")[-k:])
                    assert p not in found
                    found[p] = row["n"]
    ends = collections.defaultdict(set)
    for k in range(1, 5):
        for i in range(len(words) - k + 1):
            ends[tuple(words[i : i + k])].add(i + k)
    assert found == {p: len(e) for p, e in ends.items()}
    states = {frozenset(e) for e in ends.values()}
    sent = sum(len(b) for b in shard.states(all_)) - 1
    assert sent == len(states) < len(ends)


@tables
@pytest.mark.parametrize("name", ["op11_warc", "op12_ranked_search", "op13_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"create view {table.split('.')[0]} as select * from '{SF}/{table}'")
    found = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    want = sorted(tuple(map(str, r)) for r in con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(map(str, r)) for r in got.select(columns).collect()) == want


PAGES = "page_id long, url string, html string, payload string, shard int"


def _pages(seed):
    r = random.Random(seed)
    bodies = ["", None, "<p>one</p>", "é😀" * 40, "x" * 5000, *("".join(r.choice("ab <>/") for _ in range(r.randint(1, 400))) for _ in range(60))]
    rows = [(r.choice([i, i, i, i - 1, None]), r.choice([None, f"http://a/{i}", "http://b/ c\r\nX: y"]), r.choice(bodies), "own", 7) for i in range(300)]
    return [*rows, *rows[:10]]


def _brute_records(rows, least=0):
    """Counts of (page_id, bytes, digest, type, refers_to)."""
    by = collections.defaultdict(list)
    for page_id, _, html, *_ in rows:
        by[(html or "").encode()].append(page_id)
    out = collections.Counter()
    for data, ids in by.items():
        known = digest = None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min((i for i in ids if i is not None), default=None)
        for i in sorted(ids, key=lambda i: (i is None, i)):
            again = len(data) >= least and first is not None and known is not None
            out[i, len(data), digest, "revisit" if again else "response", first if again else None] += 1
            known = True
    return out


@pytest.mark.parametrize(("least", "shard", "roll"), [(0, 4000, 600), (3, 1 << 20, 1 << 20), (100, 1, 1)])
def test_archives_are_read_back(spark, tmp_path, least, shard, roll):
    rows = _pages(least)
    pages = spark.createDataFrame(rows, PAGES)
    settings = {"least": least, "shard_bytes": shard, "roll_bytes": roll}
    got = warc.archived(pages, str(tmp_path / "a"), **settings)
    assert collections.Counter(map(tuple, got.collect())) == _brute_records(rows, least)
    # the same files from rows in another order and other partitions
    warc.write_archive(pages.orderBy(F.rand(5)).repartition(7), str(tmp_path / "b"), **settings)
    files = {d: {f.name: f.read_bytes() for f in (tmp_path / d).glob("*.warc.gz")} for d in "ab"}
    assert files["a"] == files["b"] and len(files["a"]) == warc.manifest(spark, str(tmp_path / "a")).count()
    for row in warc.manifest(spark, str(tmp_path / "a")).collect():
        assert hashlib.sha256(files["a"][row.name]).hexdigest() == row.sha256 and len(files["a"][row.name]) == row.bytes
    assert not (tmp_path / "a" / "_temporary").exists()
    # pages follow one another in files by name
    read = warc.read_archive(spark, str(tmp_path / "a"), payloads=True).orderBy("file", "number").collect()
    ids = [x.page_id for x in read]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    targets = {x.record_id: x for x in read}
    assert len(targets) == len(read)
    assert sorted((x.payload or b"").decode() for x in read if x.record_type == "response") == sorted(html for html, n in collections.Counter((x[2] or "") for x in rows).items() for _ in range(sum(c for k, c in _brute_records(rows, least).items() if k[3] == "response" and k[2] == warc.digest(html.encode()))))


def test_archives_are_whole_or_not_there(spark, tmp_path):
    pages = spark.createDataFrame(_pages(1), PAGES)
    root = str(tmp_path / "a")
    warc.write_archive(pages, root)
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, root)
    (file,) = (tmp_path / "a").glob("*.warc.gz")
    data = gzip.decompress(file.read_bytes())
    assert data.count(b"WARC/1.1\r\n") == warc.manifest(spark, root).first().records + 1 and b"\r\nX: y" not in data
    for broken in (data.replace(b"<p>one", b"<p>two"), data[:-100]):
        file.write_bytes(gzip.compress(broken))
        with pytest.raises(Exception, match="differs from its digests|cut off"):
            warc.read_archive(spark, root).collect()
    # a stray file that no manifest names is not read
    file.write_bytes(gzip.compress(data))
    (tmp_path / "a" / "pages-99999-00000.warc.gz").write_bytes(b"half")
    assert warc.read_archive(spark, root).count() == len(_pages(1))


def test_archives_of_no_pages(spark, tmp_path):
    assert warc.archived(spark.createDataFrame([], PAGES), str(tmp_path / "a")).collect() == []


def test_records_of_plain_and_folded_streams():
    text = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for data in (text, gzip.compress(text[:95]) + gzip.compress(text[95:])):
        found = list(warc.records(io.BytesIO(data)))
        assert [b for _, b in found] == [b"abc", b""] and found[0][0]["x-long"] == "a b"


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _brute_ranked(docs, items, k=10):
    terms = [(i, re.findall(TERM, _lower(t))) for i, t in docs if i is not None]
    n_docs, total = sum(1 for _, w in terms if w), sum(len(w) for _, w in terms)
    df = collections.Counter(t for _, w in terms for t in set(w))
    out = []
    for item, text in items:
        scored = []
        asked = re.findall(TERM, _lower(text))
        for i, w in terms:
            tf, score = collections.Counter(w), 0
            for t in asked:
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + 75 * len(w) * n_docs // total
                    score += weight * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _ranked_corpus(seed):
    r = random.Random(seed)
    topics = [[f"{c}{i}" for i in range(40)] for c in "abcdefgh"]
    make = lambda: " ".join(r.choice(r.choice(topics[:2]) if r.random() < 0.3 else r.choice(topics)[:1] + own[:20]) for own in [r.choice(topics)] for _ in range(r.choice([1, 3, 20, 60])))
    texts = [make() for _ in range(400)]
    texts += texts[:60] + ["", None, "  ..", "É é É", "same words here"] + ["same words here"] * 40 + ["A1 " * 3000]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3, "b1 b2"), (3, "b1 b2"), (None, "a1 a2")]
    items = [(i, make()) for i in range(25)] + [(100, "same words"), (101, "é"), (102, None), (103, "zzz"), (104, "a1 A1 a1 b2"), (104, "a1 A1 a1 b2"), (105, "..")]
    return docs, items


@pytest.mark.parametrize(("block", "most", "sample"), [(1 << 22, 64, 2048), (3000, 8, 200), (500, 1, 0)])
def test_ranked_search(spark, block, most, sample):
    docs, items = _ranked_corpus(block)
    table = spark.createDataFrame([(*x, "own", 1) for x in docs], "doc_id long, text string, block string, score int").repartition(5)
    asked = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, rank string")
    got = sorted(tuple(x) for x in ranked.ranked(table, asked, block_bytes=block, most=most, sample=sample).collect())
    assert got == _brute_ranked(docs, [x for x in dict.fromkeys(items) if x[1] is not None])


def test_ranked_search_in_passes_and_of_nothing(spark):
    docs, items = _ranked_corpus(9)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    with cuts.scratch(spark):
        index = ranked.build_index(table, block_bytes=2000, most=16)
        for k in (1, 3):
            got = sorted(tuple(x) for x in ranked.search(index, asked, k, pass_chars=900, wave=1).collect())
            assert got == _brute_ranked(docs, [x for x in dict.fromkeys(items) if x[1] is not None], k)
        assert ranked.search(index, asked.limit(0)).collect() == []
    assert ranked.ranked(table.limit(0), asked).collect() == []


def test_clusters_are_passed_over():
    """Of documents of many topics, dealt at random, few clusters are visited; those passed over hold no better one."""
    r = random.Random(4)
    docs = [" ".join(f"{i % 32}w{r.randrange(60)}" for _ in range(30)) for i in range(2000)]
    order = r.sample(range(2000), 2000)
    clusters = list(ranked._clusters(0, np.arange(2000), pa.array([docs[i] for i in order]), 2000, 60000, 64))
    queries = ranked.Queries([f"{i}w1 {i}w2 {i}w3" for i in range(32)])
    df = np.zeros(96, np.int64)
    for batch in clusters:
        for (own, number), x in zip(queries.known(batch), batch.column("begin"), strict=True):
            df[number] += np.diff(np.frombuffer(x.as_buffer(), np.int32))[own]
    queries.weigh(df, 2000)
    best, visits, total = ranked.Best(32, 10, np.ones(32, np.int64), np.full(32, 2**63 - 1)), 0, 0
    for batch in clusters:
        rows, known = batch.to_pylist(), queries.known(batch)
        bounds = [queries.bounds(own, number, np.frombuffer(row["best"], np.int32)) for (own, number), row in zip(known, rows, strict=True)]
        for c in sorted(range(len(rows)), key=lambda c: -int(bounds[c].max())):
            items = best.may(bounds[c], rows[c]["least_doc"])
            ranked._visit(queries, rows[c], *known[c], items, best)
            visits, total = visits + len(items), total + 32
    assert visits < total / 8
    found = [tuple(x.values()) for x in best.rows().to_pylist()]
    assert sorted(found) == sorted((q, d, s) for q, _, d, s in _brute_ranked([(i, docs[order[i]]) for i in range(2000)], [(i, f"{i}w1 {i}w2 {i}w3") for i in range(32)]))
