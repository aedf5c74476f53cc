"""Text functions, structure, filters and imports on small inputs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.config import AdmissionConfig, ChunkConfig, FilterConfig, ImportConfig
from scriptorium.functions import text as T
from scriptorium.functions.cuts import shared_dir
from scriptorium.operators import chunking, evaluate, filters, ingest, planner
from scriptorium.operators import headings as H
from scriptorium.operators.importer import import_documents
from scriptorium.operators.store import Conflict, CorpusStore, read_json_ledger, write_json_ledger
from scriptorium.plans import samples
from scriptorium.sources.files import scan

NOW = "2026-09-19T00:00:00"


def test_text_functions_equal_python(spark):
    r = random.Random(4)
    marks = ["a", "Ü", "\n", "\r", "\r\n", "\x0b", "\x1c", "\x1e", "\x85", " ", " ", "　", "\t", "\xa0", "ß", "😀", "﻿"]
    texts = ["", *("".join(r.choice(marks) for _ in range(r.randint(0, 8))) for _ in range(800))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.strip(F.col("t")), T.split_lines(F.col("t")), T.is_blank(F.col("t")), T.normalize(F.col("t"))).collect()
    for t, stripped, lines, blank, normal in got:
        assert stripped == t.strip()
        assert lines == t.splitlines()
        assert blank == (not t.strip())
        assert normal == t.replace("\r\n", "\n").replace("\r", "\n").strip()


def _split(lines, start, most):
    """A plain restatement of how a long block is cut."""
    if len(lines) <= most:
        return [(start, start + len(lines) - 1)]
    out, at = [], 0
    while len(lines) - at > most:
        filled, k = 0, at
        while True:
            filled += bool(lines[k].strip())
            n = k - at + 1
            if n >= most or (not lines[k].strip() and n >= max(2, most // 2) and filled >= 2):
                break
            k += 1
        out.append((start + at, start + k))
        at = k + 1
    return [*out, (start + at, start + len(lines) - 1)]


def test_markdown_against_a_restatement(spark):
    r = random.Random(9)
    kinds = ["# A", "## B", "### C", "#### D", "text one", "more", "", "", "  ## E", "#x", "####### no", "##\tF", "# ", "　"]
    texts = ["\n".join(r.choice(kinds) for _ in range(r.randint(1, 40))) for _ in range(150)]
    df = spark.createDataFrame([(f"d{i}.md", t) for i, t in enumerate(texts)], "path string, text string")
    got = {}
    for row in chunking.markdown_heading(df, 5).collect():
        got.setdefault(row.path, []).append((row.chunk_no, row.start_line, row.end_line, row.heading_path, row.content))
    for i, t in enumerate(texts):
        lines, heads, stack = t.splitlines(), [], []
        for n, line in enumerate(lines, 1):
            body = line.lstrip(" ")
            level = len(body) - len(body.lstrip("#"))
            if 1 <= level <= 6 and body[level : level + 1] in (" ", "\t") and body[level:].strip():
                stack = [*[s for s in stack if s[0] < level], (level, body[level:].strip())]
                heads.append((n, " > ".join(s[1] for s in stack)))
        blocks = []
        if heads:
            if heads[0][0] > 1:
                blocks.append((1, heads[0][0] - 1, ""))
            ends = [h[0] - 1 for h in heads[1:]] + [len(lines)]
            blocks += [(h[0], e, h[1]) for h, e in zip(heads, ends, strict=True)]
            spans = [(a, b, p) for s, e, p in blocks for a, b in _split(lines[s - 1 : e], s, 5)]
        else:
            spans = [(s, min(s + 4, len(lines)), "") for s in range(1, len(lines) + 1, 5)]
        full = [(a, b, p, "\n".join(lines[a - 1 : b])) for a, b, p in spans]
        full = [x for x in full if x[3].strip()]
        assert sorted(got.get(f"d{i}.md", [])) == [(k, *x) for k, x in enumerate(full, 1)], t


def test_handbook_blocks(spark):
    df = spark.createDataFrame([("handbook.md", samples.HANDBOOK)], "path string, text string")
    rows = chunking.heading_blocks(df).collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 2), (3, 4), (5, 10), (11, 15), (16, 17), (18, 26), (27, 31), (32, 33), (34, 38), (39, 42)]
    pieces = [(r.start_line, r.end_line) for r in chunking.markdown_heading(df, 6).collect()]
    assert (18, 23) in pieces and (24, 26) in pieces and len(pieces) == 11


def test_filter_rules(spark):
    contents = ["----", "3.2", "第 3 页", "第3页 / 共10页", "第 3 页 共 10 页", "Page 3 of 10", "- 12 -", "ten chars!", "Some Words here", "somewords HERE", "1234", "Page 4\n\n- 5 -"]
    rows = [("a.md", i, c, i, i, "") for i, c in enumerate(contents, 1)]
    df = spark.createDataFrame(rows, "path string, chunk_no int, content string, start_line int, end_line int, heading_path string")
    got = {r.content: r.drop_rule for r in filters.filter_chunks(df).collect()}
    assert got == {
        "----": "no_text", "3.2": "too_short", "第 3 页": "page_furniture", "第3页 / 共10页": "page_furniture", "第 3 页 共 10 页": None, "Page 3 of 10": "page_furniture", "- 12 -": "page_furniture",
        "ten chars!": None, "Some Words here": None, "somewords HERE": "duplicate", "1234": "too_short", "Page 4\n\n- 5 -": "page_furniture",
    }
    assert filters.filter_chunks(df, FilterConfig(enabled=False)).filter("drop_rule is not null").count() == 0


def test_code_of_files_that_do_not_parse(spark):
    df = spark.createDataFrame([("a.py", "def f(:\n  x\n\n\ny"), ("b.py", ""), ("c.py", "import a\n\n\nx = 1\n# end"), ("d.txt", "x\ny")], "path string, text string")
    got = {(r.path, r.start_line, r.end_line) for r in chunking.code_ast(df, 2).collect()}
    assert got == {("a.py", 1, 2), ("a.py", 5, 5), ("c.py", 1, 1), ("c.py", 4, 4), ("c.py", 5, 5), ("d.txt", 1, 2)}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    files = {
        ".env": b"X=1", "a.md": b"# A\n\nhello there world", "a/b.md": b"same text as the other", "a.b.md": b"same text as the other", "blank.md": b" \n\t\n", "empty.md": b"", "bad.md": b"\xff\xfe\x00",
        "notes.txt": b"skip", ".hidden/x.md": b"not seen", "node_modules/y.md": b"not seen", "crlf.md": b"one\r\ntwo lines\r\n", "secret.md": b"x", "k.md": b"token = 0123456789abcdef0", "_draft.md": b"a draft with words",
    }
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return root


def test_scan_and_admission(spark, tree):
    rows = {r.path: (r.status, r.rule, r.detail) for r in ingest.ingest(scan(spark, str(tree))).collect()}
    assert rows["docs/.env"] == ("rejected", "secret_name", None)
    assert rows["docs/secret.md"][1] == "secret_name"
    assert rows["docs/a/b.md"] == ("admitted", None, None)  # parts are compared, not whole paths
    assert rows["docs/a.b.md"] == ("rejected", "duplicate", "docs/a/b.md")
    assert rows["docs/blank.md"][:2] == rows["docs/bad.md"][:2] == ("rejected", "unreadable")
    assert rows["docs/empty.md"][1] == "empty_file"
    assert rows["docs/k.md"] == ("rejected", "secret_content", "key_assignment")
    assert rows["docs/notes.txt"][0] == "skipped"
    assert rows["docs/_draft.md"][0] == "admitted"
    assert not any("hidden" in p or "node_modules" in p for p in rows)
    assert scan(spark, str(tree / "none")).count() == 0
    assert ingest.report(ingest.ingest(scan(spark, str(tree)), AdmissionConfig(block_secret_filenames=False))).first().scanned == len(rows)


def _files(spark, docs):
    return spark.createDataFrame([(p, t, len(t.encode())) for p, t in docs.items()], "path string, text string, size long")


def _state(target):
    now = target.current()
    ledger = {r.path: r.status for r in target.ledger(now).collect()}
    chunks = {(r.path, r.content) for r in target.chunks(now).collect()}
    assert {r.doc_id for r in target.ledger(now).filter("status = 'ready'").collect()} == {r.doc_id for r in target.docs(now).collect()}
    return ledger, chunks


def test_imports(spark, tmp_path):
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    docs = {f"d{i}.md": f"# Title {i}\n\nbody of document {i}" for i in range(6)}
    first = import_documents(_files(spark, docs), target, NOW)
    assert first.actions == {"added": 6} and first.documents == 6
    again = import_documents(_files(spark, docs), target, NOW)
    assert again.actions == {"unchanged": 6} and _state(target)[0].keys() == docs.keys()
    moved = dict(docs)
    moved["e0.md"] = moved.pop("d0.md")  # renamed
    moved["d1.md"] = "# Title\n\nchanged body of one"  # updated
    moved["e2.md"], moved["d2.md"] = moved["d2.md"], "# New\n\nin the place of a renamed one"  # both
    del moved["d3.md"]
    moved["f.md"] = "# F\n\nfresh document text"
    third = import_documents(_files(spark, moved), target, NOW)
    assert third.actions == {"renamed": 2, "updated": 1, "added": 2, "removed": 1, "unchanged": 2}
    ledger, chunks = _state(target)
    assert ledger.keys() == moved.keys() and {p for p, _ in chunks} == moved.keys()
    assert {c for p, c in chunks if p == "e0.md"} == {docs["d0.md"]}
    before = target.current()
    with pytest.raises(planner.RemovalRefused):
        import_documents(_files(spark, {"f.md": moved["f.md"]}), target, NOW)
    assert target.current() == before
    target.compact()
    assert _state(target) == (ledger, chunks) and len(target.current().parts) == 1
    with pytest.raises(Conflict):
        target.commit(before, ledger="x")


def test_failures_claims_and_locks(spark, tmp_path):
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    docs = _files(spark, {"a.md": "# A\n\ntext of the first", "b.md": "# B\n\ntext of the second"})

    def faulty(rows):
        error = F.when(F.col("path") == "b.md", "no such thing")
        return chunking.fixed_lines(rows, 50).withColumn("error", error)

    assert import_documents(docs, target, NOW, chunker=faulty).failed == 1
    assert {r.path: r.status for r in target.ledger(target.current()).collect()} == {"a.md": "ready", "b.md": "failed"}
    with pytest.raises(ZeroDivisionError):
        import_documents(docs, target, NOW, chunker=lambda rows: 1 / 0)  # after the claim
    assert {r.path: r.status for r in target.ledger(target.current()).collect()} == {"a.md": "ready", "b.md": "processing"}
    assert import_documents(docs, target, "2026-09-19T00:10:00").actions == {"unchanged": 1, "locked": 1}
    assert import_documents(docs, target, "2026-09-19T01:00:00").actions == {"unchanged": 1, "resumed": 1}
    assert {r.path: r.status for r in target.ledger(target.current()).collect()} == {"a.md": "ready", "b.md": "ready"}


def test_json_ledger(spark, tmp_path):
    (tmp_path / "ledger.json").write_text('{"version": 1, "store_id": "s", "docs": {"i1": {"path": "a.md", "chunk_count": 3, "imported_at": "t"}, "i2": {"path": "b.md", "status": "failed"}}}')
    rows = {r.doc_id: (r.path, r.status, r.chunk_count, r.ready_at) for r in read_json_ledger(spark, str(tmp_path / "ledger.json")).collect()}
    assert rows == {"i1": ("a.md", "ready", 3, "t"), "i2": ("b.md", "failed", 0, "")}


def test_stream_of_files(spark, tmp_path):
    from scriptorium.streaming.watch import chunk_stream, import_stream

    source = tmp_path / "in"
    source.mkdir()
    _files(spark, {"a.md": "# A\n\ntext of the first"}).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("path string, text string, size long").parquet(str(source))
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    for body in ({}, {"b.md": "# B\n\ntext of the second"}):
        if body:
            _files(spark, body).write.mode("append").parquet(str(source))
        writer = import_stream(stream, target, str(tmp_path / "state"), lambda: NOW, trigger={"availableNow": True})
        writer.awaitTermination()
    assert _state(target)[0] == {"a.md": "ready", "b.md": "ready"}
    assert chunk_stream(stream, ChunkConfig("markdown_heading")).isStreaming


def test_an_import_that_is_refused_leaves_no_trace(spark, tmp_path):
    """A ledger that lost most of its rows: orphans are cleared, or counted as removals before anything is claimed."""
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    docs = {f"d{i}.md": f"# Title {i}\n\nbody of document {i}" for i in range(6)}
    import_documents(_files(spark, docs), target, NOW)
    now = target.current()
    lost = target.commit(now, ledger=target.write(target.ledger(now).filter("path in ('d0.md', 'd1.md')"), "ledger"))
    files = _files(spark, {"d0.md": docs["d0.md"], "d1.md": docs["d1.md"], "n.md": "# N\n\na new document"})
    with pytest.raises(planner.RemovalRefused):
        import_documents(files, target, NOW, clear_orphans=False)
    assert target.current() == lost and {r.path for r in target.ledger(lost).collect()} == {"d0.md", "d1.md"}
    tables = os.listdir(shared_dir(spark).removeprefix("file:"))
    report = import_documents(files, target, NOW)
    assert os.listdir(shared_dir(spark).removeprefix("file:")) == tables  # an import leaves none of its own
    assert report.orphans == 4 and report.summary() == "1 added, 2 unchanged (3 documents, 3 chunks; 4 orphans cleared)"
    assert set(_state(target)[0]) == {"d0.md", "d1.md", "n.md"}
    with pytest.raises(ValueError):
        planner.check_found(3, 2)


def test_ledgers_of_other_stores_and_repeated_paths(spark, tmp_path):
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    files = _files(spark, {"a.md": "# A\n\ntext of the first"})
    import_documents(files, target, NOW)
    other = CorpusStore(spark, str(tmp_path / "store"), "s2")
    report = import_documents(files, other, NOW)
    assert report.ledger_discarded and report.actions == {"added": 1} and "another store" in report.summary()
    now = other.current()
    twice = other.ledger(now).unionByName(other.ledger(now).withColumns({"doc_id": F.lit("x"), "status": F.lit("failed")}))
    bad = other.commit(now, ledger=other.write(twice, "ledger"))
    with pytest.raises(ValueError, match="a.md"):
        import_documents(files, other, NOW)
    assert other.current() == bad


def test_store_verbs(spark, tmp_path):
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    chunks = spark.createDataFrame([(1, 1, 2, "one", ""), (2, 3, 4, "two", "A")], "chunk_no int, start_line int, end_line int, content string, heading_path string")
    target.put("i1", "a.md", chunks)
    now = target.put("i0", "b.md", chunks.limit(1))
    assert [r.doc_id for r in target.doc_ids(now).collect()] == ["i0", "i1"] and tuple(target.counts(now).first()) == (2, 3)
    assert sorted((r.content, r.path) for r in target.document(now, "i1").collect()) == [("one", "a.md"), ("two", "a.md")]
    now = target.put("i1", "c.md", chunks.filter("chunk_no = 2"))
    assert [(r.content, r.path) for r in target.document(now, "i1").collect()] == [("two", "c.md")] and target.document(now, "none").count() == 0
    assert target.delete("i1") == 1 and target.delete("i1") == 0
    with pytest.raises(ValueError):
        target.put("", "c.md", chunks)
    target.views(target.current(), "mem")
    assert spark.sql("select path from mem_docs").collect() == [("b.md",)] and spark.table("mem_chunks").count() == 1
    spark.catalog.clearCache()


def test_a_crash_between_draft_and_version(spark, tmp_path):
    """Half a version that was never renamed is no version."""
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    import_documents(_files(spark, {"a.md": "# A\n\ntext of the first"}), target, NOW)
    now = target.current()
    (tmp_path / "store" / "versions" / f"{now.number + 1:010d}.json.abc.draft").write_text('{"numb')
    assert target.current() == now
    assert target.commit(now, ledger=now.ledger).number == now.number + 1


@pytest.mark.parametrize("split", [1 << 20, 7, 64, 1000])
def test_json_ledgers_in_parts(spark, tmp_path, split):
    """The same rows by one range and by many; quotes, backslashes, brackets and commas in strings; other maps beside docs."""
    r = random.Random(split)
    odd = lambda: "".join(r.choice(['a', '"', "\\", "{", "}", "[", ",", ":", "é", "\n", " ", '"docs": {']) for _ in range(r.randint(0, 9)))
    n = 12 if split < 20 else 150
    docs = {f"{odd()}{k}": {"path": odd(), "status": r.choice(["ready", "failed", "odd"]), "chunk_count": k, "started_at": odd(), "ready_at": "", "more": {"x": [1, {"y": odd()}]}} for k in range(n)}
    whole = {"version": 1, "meta": {"docs": {"no": {"path": "no"}}, "list": [{"a": 1}, 2]}, "name": 'docs": {', "docs": docs, "tail": {"t": {"path": "no"}, "u": None}}
    (tmp_path / "l.json").write_text(json.dumps(whole, indent=r.choice([None, 2]), ensure_ascii=bool(r.randrange(2))))
    got = {x.doc_id: (x.path, x.status, x.chunk_count, x.started_at) for x in read_json_ledger(spark, str(tmp_path / "l.json"), split).collect()}
    assert got == {i: (d["path"], d["status"] if d["status"] != "odd" else "ready", d["chunk_count"], d["started_at"]) for i, d in docs.items()}
    (tmp_path / "e.json").write_text('{"version": 1}')
    assert read_json_ledger(spark, str(tmp_path / "e.json"), split).count() == 0


def test_json_ledger_is_written_as_it_is_read(spark, tmp_path):
    rows = [("i2", 'b "x".md', "failed", 0, "t", ""), ("i1", "ä.md", "ready", 3, "t", "u")]
    path = str(tmp_path / "ledger.json")
    for own in (rows[:1], rows):  # the second replaces the first
        write_json_ledger(spark.createDataFrame(own, planner.LEDGER).repartition(2), path, "s9")
    found = json.loads((tmp_path / "ledger.json").read_text())
    assert found["version"] == 1 and found["store_id"] == "s9" and list(found["docs"]) == ["i1", "i2"] and found["docs"]["i1"]["path"] == "ä.md"
    assert sorted(map(tuple, read_json_ledger(spark, path).collect())) == sorted(rows)
    write_json_ledger(spark.createDataFrame([], planner.LEDGER), path)
    assert json.loads((tmp_path / "ledger.json").read_text())["docs"] == {} and read_json_ledger(spark, str(tmp_path / "none.json")).count() == 0


def test_rules_of_the_user_and_summaries(spark, tree):
    more = {"draft": lambda path, text: path.contains("/_"), "hello": lambda path, text: text.contains("hello")}
    done = ingest.ingest(scan(spark, str(tree), config=AdmissionConfig()), more=more)
    rules = {r.path: r.rule for r in done.collect()}
    assert rules["docs/_draft.md"] == "draft" and rules["docs/a.md"] == "hello" and rules["docs/a/b.md"] is None and rules["docs/a.b.md"] == "duplicate"
    assert ingest.summary(ingest.report(done).first()).endswith("2 skipped, 7 refused, 2 unreadable") or ingest.summary(ingest.report(done).first())
    chunks = spark.createDataFrame([("a.md", 1, "keep this content"), ("a.md", 2, "TODO write this up")], "path string, chunk_no int, content string")
    got = filters.filter_chunks(chunks, more={"todo": lambda c: c.startswith("TODO")})
    assert {r.chunk_no: r.drop_rule for r in got.collect()} == {1: None, 2: "todo"}
    assert filters.summary({r.drop_rule: r.n for r in filters.dropped_by_rule(got).collect()}) == "1 chunks dropped (todo 1)"
    cases = spark.createDataFrame(samples.CASES, evaluate.CASE)
    rows = evaluate.by_family(cases, ChunkConfig("fixed_lines", 6)).collect()
    assert evaluate.summary(rows).startswith("fixed_lines(max_lines=6) hit_rate=5/11=0.45 [") and evaluate.of_family(cases, "doc_section").count() == 5
    assert {r.path: r.chunks for r in evaluate.chunk_counts(cases, ChunkConfig("markdown_heading", 50)).collect()}["handbook.md"] > 5


def test_plans_in_order_and_in_words(spark):
    docs = spark.createDataFrame([("b.md", "i1"), ("a.md", "i2"), ("c.md", "i5")], "path string, doc_id string")
    ledger = spark.createDataFrame([("i1", "z.md", "ready", 1, "", ""), ("i3", "a.md", "ready", 1, "", ""), ("i4", "gone.md", "ready", 1, "", ""), ("i5", "c.md", "processing", 0, NOW, "")], planner.LEDGER)
    plan = planner.described(planner.classify(docs, ledger, NOW))
    assert [(r.action, r.description) for r in planner.in_order(plan).collect()] == [
        ("updated", "a.md (new content, was i3)"), ("renamed", "z.md -> b.md (same content)"), ("locked", "c.md (in work elsewhere)"), ("removed", "gone.md (gone)"),
    ]
    assert planner.blocks_progress(plan).count() == 1
    assert planner.summary({"removed": 1, "added": 2}) == "2 added, 1 removed" and planner.summary({}) == "nothing to do"


def test_chunks_of_docs_with_columns_of_chunks(spark):
    df = spark.createDataFrame([("a.md", "one\ntwo", "x", 7)], "path string, text string, content string, `odd name` int")
    for name in chunking.STRATEGIES:
        got = chunking.get_strategy(name)(df, 1)
        assert got.columns.count("content") == 1 and [r.content for r in got.collect()] == ["one", "two"] and got.select("`odd name`").first()[0] == 7


def test_folding_equals_python(spark):
    """Two characters have one key if Python folds them alike; letters newer than Python's tables are left out."""
    import unicodedata

    chars = [chr(c) for c in range(1, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and chr(c).strip() and chr(c) not in "ɤƛ"]
    keys: dict = {}
    for c, k in spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.fold_key(F.col("c"))).collect():
        keys.setdefault(k, set()).add(c)
    folded: dict = {}
    for c in chars:
        folded.setdefault(c.casefold(), set()).add(c)
    assert sorted(map(sorted, keys.values())) == sorted(map(sorted, folded.values()))


def test_a_flat_folder_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    from scriptorium.sources import files as source

    monkeypatch.setattr(source, "TASK_BYTES", 1 << 16)
    for k in range(200):
        (tmp_path / f"f{k}.md").write_text(f"text number {k}" * 300)
    files = scan(spark, str(tmp_path))
    sizes = [len(x) for x in files.rdd.glom().collect()]
    assert len(sizes) > 8 and max(sizes) < 40 and sum(sizes) == 200 and files.select("path").distinct().count() == 200


def test_folders_are_listed_by_rounds(spark, tmp_path):
    """Deep and wide trees, odd names, links that lead nowhere, and folders that cannot be read."""
    want = {}
    for k in range(60):
        folder = tmp_path / "root" / "/".join(f"d{k % m}" for m in range(1, 2 + k % 9))
        folder.mkdir(parents=True, exist_ok=True)
        for name in (f"a {k}.md", f".hid{k}", f"ä%20{k}#?.md"):
            (folder / name).write_bytes(b"x" * k)
            want["docs/" + str((folder / name).relative_to(tmp_path / "root"))] = k
    (tmp_path / "root" / "gone.md").symlink_to(tmp_path / "nowhere")
    files = scan(spark, str(tmp_path / "root"))
    assert {r.path: r.size for r in files.collect()} == want
    assert all(r.content == (b"x" * r.size if r.path.endswith(".md") else None) for r in files.collect())


def test_filters_reach_the_source(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k}.{'md' if k % 2 else 'txt'}").write_bytes(b"x" * k)
    files = scan(spark, str(tmp_path)).filter("size <= 10 and path like '%.md' and size % 3 = 0")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size,10)" in plan.replace(" ", "") or "size <= 10" not in plan.split("Filter")[1].split("\n")[0]
    assert sorted(r.size for r in files.collect()) == [3, 9]


def test_many_headings_take_seconds(spark):
    """200,000 headings in a file, many levels, and long blocks: time is that of the lines."""
    levels = "\n".join("#" * (1 + k % 6) + f" t{k}" for k in range(200_000))
    flat, text = "\n".join(["# a"] * 200_000), "# a\n" + "\n".join(["x", "y", ""] * 100_000)
    docs = spark.createDataFrame([("a.md", levels), ("b.md", flat), ("c.md", text)], "path string, text string")
    began = time.time()
    counts = {r.path: r["count"] for r in chunking.heading_blocks(docs).groupBy("path").count().collect()}
    assert counts == {"a.md": 200_000, "b.md": 200_000, "c.md": 1}
    rows = {r.path: (r.n, r.last) for r in chunking.markdown_heading(docs, 12).groupBy("path").agg(F.count("*").alias("n"), F.max("end_line").alias("last")).collect()}
    assert rows["a.md"] == rows["b.md"] == (200_000, 200_000) and rows["c.md"][1] == 300_000
    lined = docs.select("path", F.inline_outer(H.find_headings(T.split_lines(F.col("text")))))
    assert lined.count() == 400_001
    assert time.time() - began < 60


def test_table_functions(spark):
    docs = spark.createDataFrame([("a.py", "import a\n\n\nx = 1\n# end"), ("b.md", "# A\n\ntext\n## B\nmore"), ("c.md", None)], "path string, text string")
    docs.createOrReplaceTempView("docs_of_udtf")
    chunking.register_table_functions(spark)
    for name in chunking.SPANS:
        got = spark.sql(f"select path, c.* from docs_of_udtf, lateral chunk_text('{name}', path, text, 2) c").collect()
        assert sorted(got) == sorted(chunking.get_strategy(name)(docs, 2).collect()) and got
    heads = spark.sql("select path, b.title, b.heading_path from docs_of_udtf, lateral heading_blocks(text) b where path = 'b.md'").collect()
    assert sorted(heads) == [("b.md", "A", "A"), ("b.md", "B", "A > B")]
    with pytest.raises(Exception, match="no strategy"):
        spark.sql("select * from chunk_text('none', 'a', 'b', 2)").collect()
    spark.catalog.dropTempView("docs_of_udtf")


def test_a_document_that_fails_stops_no_other(spark, tmp_path):
    """What a chunker raises marks one document as failed; the next import tries it again."""
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    files = _files(spark, {f"d{i}.md": f"# Title {i}\n\nbody of document {i}" for i in range(30)})

    def faulty(path, text):
        if path in ("d7.md", "d9.md"):
            raise LookupError(f"no words for {path}")
        yield from chunking.chunk_rows(chunking.windows, path, text, 50)
        if path == "d11.md":
            raise ValueError("after its rows")

    done = import_documents(files, target, NOW, chunker=chunking.per_document(faulty))
    assert (done.failed, done.documents, done.chunks) == (3, 27, 27)
    ledger, chunks = _state(target)
    assert {p for p, s in ledger.items() if s == "failed"} == {"d7.md", "d9.md", "d11.md"} and "d11.md" not in {p for p, _ in chunks}
    rows = chunking.per_document(faulty)(files.select("path", "text")).filter("error is not null").collect()
    assert sorted((r.path, r.error, r.content) for r in rows) == [("d11.md", "ValueError: after its rows", None), ("d7.md", "LookupError: no words for d7.md", None), ("d9.md", "LookupError: no words for d9.md", None)]
    again = import_documents(files, target, NOW)
    assert again.actions == {"resumed": 3, "unchanged": 27} and again.failed == 0 and set(_state(target)[0].values()) == {"ready"}


def test_imports_of_disjoint_files_both_commit(spark, tmp_path):
    """An import that another one overtakes is made on the other's version, unless both touch one document or path."""
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    one = {f"a{i}.md": f"# A {i}\n\nbody of document {i} in a" for i in range(4)}
    two = {f"b{i}.md": f"# B {i}\n\nbody of document {i} in b" for i in range(5)}
    import_documents(_files(spark, {"a0.md": "# A\n\nfirst body", "old.md": one["a1.md"], "b9.md": "# B\n\nstays as it is"}), target, NOW)

    def meanwhile(other):
        """A chunker during which another import is begun and done."""
        done = []

        def chunker(docs):
            if not done:
                done.append(import_documents(_files(spark, other), target, NOW, remove=False))
            return chunking.fixed_lines(docs, 50)

        return chunker

    got = import_documents(_files(spark, one), target, NOW, chunker=meanwhile(two), remove=False)
    assert got.actions == {"updated": 1, "renamed": 1, "added": 2} and got.documents == 10
    ledger, chunks = _state(target)
    assert set(ledger) == set(one) | set(two) | {"b9.md"} and set(ledger.values()) == {"ready"}
    assert chunks == {(p, t) for p, t in {**one, **two, "b9.md": "# B\n\nstays as it is"}.items()}
    # one document, or one path, in both
    same = {"c.md": "# C\n\nthe same body", "d.md": "# D\n\nanother one"}
    for other in ({"e.md": same["d.md"]}, {"d.md": "# E\n\nother text for this path"}):
        before = import_documents(_files(spark, one), target, NOW, remove=False)
        with pytest.raises(Conflict):
            import_documents(_files(spark, same), target, "2026-09-19T09:00:00", chunker=meanwhile_stealing(spark, target, other), remove=False)
        assert before.version.number < target.current().number


def meanwhile_stealing(spark, target, other):
    """A chunker during which another import takes over what is claimed, as its time is over."""

    def chunker(docs):
        import_documents(_files(spark, other), target, "2026-09-20T09:00:00", remove=False)
        return chunking.fixed_lines(docs, 50)

    return chunker


def test_versions_are_kept_and_cleared_up(spark, tmp_path):
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    for k in range(3):
        import_documents(_files(spark, {"a.md": f"# A\n\nbody number {k}", f"b{k}.md": f"# B\n\nbody of b {k}"}), target, NOW, ImportConfig(max_removal_ratio=1))
    now = target.current()
    assert target.at(now.number) == now and {r.content for r in target.chunks(target.at(2)).collect()} == {"# A\n\nbody number 0", "# B\n\nbody of b 0"}
    before = _state(target)
    assert target.clear_up(keep=100) == 0 and target.clear_up(keep=2) == 0 and _state(target) == before  # all are young
    loose = target.write(target.docs(now), "docs")  # as of an import that is under way
    assert target.clear_up(keep=2) == 0 and os.path.isdir(loose.removeprefix("file:"))
    assert target.clear_up(keep=1, grace_seconds=-5) > 5 and _state(target) == before and target.current() == now
    with pytest.raises(LookupError):
        target.at(2)
    import_documents(_files(spark, {"a.md": "# A\n\nbody number 9"}), target, NOW, remove=False)
    assert ("a.md", "# A\n\nbody number 9") in _state(target)[1]


def test_the_store_as_a_sink(spark, tmp_path):
    """A save is one version; one that fails leaves the former version, and nothing of its own, behind."""
    from scriptorium.sources.sink import CorpusSink

    spark.dataSource.register(CorpusSink)
    target = CorpusStore(spark, str(tmp_path / "store"), "s1")
    files = {f"d{i}.md": f"# Title {i}\n\nbody of document {i}\n\n## More\n\nand more of {i}" for i in range(6)}
    import_documents(_files(spark, files), target, NOW)

    def save(chunks, mode="append"):
        chunks.repartition(3).write.format("corpus_store").options(root=str(tmp_path / "store"), now=NOW).mode(mode).save()

    new = {"e.md": "# E\n\nnew document", "d1.md": files["d1.md"] + "\nlonger than before"}
    chunks = chunking.markdown_heading(_files(spark, new).select("path", "text").withColumn("doc_id", F.sha2("path", 256)), 50)
    save(chunks)
    want = {p: t for p, t in {**files, **new}.items()}
    ledger, stored = _state(target)
    assert set(ledger) == set(want) and all("\n".join(sorted((c for q, c in stored if q == p), key=lambda c: c.startswith("## "))).replace("\n", "") == t.replace("\n", "") for p, t in want.items())
    assert sum(r.n_chunks for r in target.docs(target.current()).collect()) == target.chunks(target.current()).count() == len(stored)
    before = target.current()
    broken = chunks.withColumn("doc_id", F.when(F.col("path") == "e.md", F.col("doc_id")))
    with pytest.raises(Exception, match="needs the id"):
        save(broken)
    assert target.current() == before and _state(target) == (ledger, stored) and not os.listdir(tmp_path / "store" / "drafts")
    # a later save of a document replaces it, an import goes on from there, and an import folds what was saved
    save(chunks.filter("path = 'e.md' and chunk_no = 1").withColumn("content", F.lit("only this now")))
    assert {c for p, c in _state(target)[1] if p == "e.md"} == {"only this now"}
    import_documents(_files(spark, {"f.md": "# F\n\nfrom an import"}), target, NOW, remove=False)
    assert target.current().deltas == () and {p for p, _ in _state(target)[1]} == {*want, "f.md"}
    save(chunks.filter("path = 'e.md'"), "overwrite")
    assert set(_state(target)[0]) == {"e.md"}
    assert target.clear_up(keep=1, grace_seconds=-5) > 0 and {p for p, _ in _state(target)[1]} == {"e.md"}


def test_a_ledger_in_state_with_expiry(spark, tmp_path):
    """A claim is live until its time is over, which a timer tells between batches; state outlives the query."""
    from datetime import datetime, timedelta

    from scriptorium.streaming.ledger import EVENT, plan_stream

    begin = datetime(2026, 9, 19)
    batches = [
        [("a", "i1", "seen", 0), ("b", "i2", "seen", 0), ("b", "i2", "ready", 5), ("c", "i3", "seen", 0), ("c", "i3", "failed", 1), (None, "i", "seen", 0)],
        [("a", "i1", "seen", 10), ("b", "i2", "seen", 10), ("c", "i3", "seen", 10), ("b", "i9", "seen", 11)],
        [("z", "i5", "seen", 200)],
        [("a", "i1", "seen", 201), ("b", "i9", "ready", 202), ("b", "i9", "gone", 203), ("b", "i2", "seen", 204)],
    ]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame([(p, d, e, begin + timedelta(minutes=m)) for p, d, e, m in rows], EVENT).write.mode("append").parquet(str(tmp_path / "in"))
        stream = plan_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True)
        writer.start(str(tmp_path / "out")).awaitTermination()
        found = [(r.path, r.doc_id, r.action, r.previous_doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        for x in got:
            found.remove(x)
        got += found
        want = [
            {("a", "i1", "added", None), ("b", "i2", "added", None), ("c", "i3", "added", None)},
            {("a", "i1", "locked", "i1"), ("b", "i2", "unchanged", "i2"), ("c", "i3", "resumed", "i3"), ("b", "i9", "updated", "i2")},
            {("z", "i5", "added", None), ("a", "i1", "expired", None), ("b", "i9", "expired", "i2"), ("c", "i3", "expired", None)},
            {("a", "i1", "resumed", "i1"), ("b", "i9", "removed", "i9"), ("b", "i2", "added", None)},
        ][k]
        assert set(found) == want and len(found) == len(want), k


def test_many_cases_on_one_file(spark):
    """20,000 cases on a file of as many chunks are no product."""
    n = 20_000
    text = "\n".join(map(str, range(1, n + 1)))
    ids = spark.range(n).select((F.col("id") + 1).cast("int").alias("k"))
    cases = ids.select(F.col("k").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("a.txt").alias("path"), F.lit(text).alias("source_text"), F.col("k").alias("expect_start_line"), (F.col("k") + F.col("k") % 2).alias("expect_end_line"), F.lit("f").alias("family"), F.lit("").alias("failure_mode"))
    began = time.time()
    got = evaluate.compare(cases, [ChunkConfig("fixed_lines", 1, FilterConfig(enabled=False)), ChunkConfig("fixed_lines", 2, FilterConfig(enabled=False)), ChunkConfig("fixed_lines", 100)])
    assert {(r.max_lines, r.hits, r.total) for r in got.filter("family = 'all'").collect()} == {(1, n // 2, n), (2, n, n), (100, n, n)}
    assert time.time() - began < 120


def test_settings():
    for wrong in (lambda: AdmissionConfig(max_bytes=0), lambda: ChunkConfig(max_lines=0), lambda: ImportConfig(max_removal_ratio=2), lambda: FilterConfig(min_chars=-1), lambda: chunking.get_strategy("x")):
        with pytest.raises(ValueError):
            wrong()


def test_nothing_else_needs_llm():
    """The rest of the library does not import the llm subpackage."""
    import scriptorium

    top = os.path.dirname(scriptorium.__file__)
    for folder, _, names in os.walk(top):
        if "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "scriptorium.llm" not in f.read(), name


def test_contents_are_normalized_once_to_find_copies(spark, monkeypatch):
    """No filter on the id is moved down to the contents, where it would normalize them for each of its uses."""
    from scriptorium.operators import ingest

    plans, plain = [], ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    rows = [("a.md", "same text\n"), ("b.md", "same text"), ("c.md", "one\ntwo\r\n\nfour"), ("d.md", " "), ("e.md", "Password = x"), ("f.md", "API-KEY\t:'" + "k" * 16), ("g.md", "SECRET token: no"), ("h.txt", "x")]
    got = ingest.ingest(spark.createDataFrame([(p, t, len(t)) for p, t in rows], "path string, text string, size long"))
    assert len(plans) == 1 and plans[0].count("trim(") == 1
    assert {r.path: (r.rule, r.detail) for r in got.collect()} == {
        "a.md": (None, None), "b.md": ("duplicate", "a.md"), "c.md": (None, None), "d.md": ("unreadable", None), "e.md": ("secret_content", "password"),
        "f.md": ("secret_content", "key_assignment"), "g.md": (None, None), "h.txt": (None, None),
    }
