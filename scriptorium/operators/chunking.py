"""Chunks of documents: fixed windows of lines, blocks under Markdown headings, or top-level Python statements.

A strategy takes docs (path, text; other columns are carried, text is not) and gives a row for each chunk: chunk_no (from 1),
start_line, end_line, content and heading_path. The built-in ones are functions from a document's lines to spans, applied in
Arrow batches without a shuffle; SQL has them as table functions.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scriptorium.config import ChunkConfig
from scriptorium.operators import headings as H
from scriptorium.operators.filters import filter_chunks

Strategy = Callable[[DataFrame, int], DataFrame]
#: First line, last line and heading path of a chunk.
Span = tuple[int, int, str]
#: Spans of a document by its path, text, lines and the most lines of a window.
Spans = Callable[[str, str, list[str], int], Iterable[Span]]

MADE = ("chunk_no", "start_line", "end_line", "content", "heading_path")
CHUNK = "chunk_no int, start_line int, end_line int, content string, heading_path string"
CHUNK_TYPE = StructType([StructField(x.split()[0], IntegerType() if x.endswith(" int") else StringType()) for x in CHUNK.split(", ")])
#: Characters of contents that a task passes on at once.
BATCH_CHARS = 1 << 20


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def windows(path: str, text: str, lines: list[str], max_lines: int) -> Iterator[Span]:
    """Windows of max_lines lines."""
    for start in range(1, len(lines) + 1, max_lines):
        yield start, min(start + max_lines - 1, len(lines)), ""


def markdown_spans(path: str, text: str, lines: list[str], max_lines: int) -> Iterator[Span]:
    """Blocks under headings, long ones in pieces that keep the heading's path; other files, and texts without a heading, in windows."""
    any_block = False
    for start, end, _, _, title_path in H.blocks(lines) if H.is_markdown(path) else ():
        any_block = True
        for a, b in H.pieces(lines, start, end, max_lines):
            yield a, b, title_path
    if not any_block:
        yield from windows(path, text, lines, max_lines)


def _statements(text: str) -> list[tuple[int, int]] | None:
    """Line ranges of top-level statements and of what lies between them; None if the text does not parse."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    spans, done, n = [], 0, len(text.splitlines())
    for node in body:
        if node.lineno > done + 1:
            spans.append((done + 1, node.lineno - 1))
        done = node.end_lineno or node.lineno
        spans.append((node.lineno, done))
    return [*spans, (done + 1, n)] if done < n else spans


def code_spans(path: str, text: str, lines: list[str], max_lines: int) -> Iterator[Span]:
    """Top-level statements of Python files, and what lies between them, whole; other files, and texts that do not parse or give
    nothing, in windows."""
    found = (_statements(text) if path.endswith(".py") else None) or []
    if any(line.strip() for a, b in found for line in lines[a - 1 : b]):
        yield from ((a, b, "") for a, b in found)
    else:
        yield from windows(path, text, lines, max_lines)


def chunk_rows(spans: Spans, path: str, text: str, max_lines: int) -> Iterator[tuple[int, int, int, str, str]]:
    """A document's chunks as rows of CHUNK: spans that are not blank, numbered from 1."""
    lines, number = text.splitlines(), 0
    for start, end, title_path in spans(path, text, lines, max_lines):
        content = "\n".join(lines[start - 1 : end])
        if content.strip():
            number += 1
            yield number, start, end, content, title_path


def by_document(docs: DataFrame, rows_of: Callable[[str, str], Iterable[tuple]], schema: str = CHUNK, errors: bool = False) -> DataFrame:
    """The rows (of schema) that rows_of gives for the path and text of each of docs, with the columns of docs, less text and those that schema names.

    A null text gives no rows. With errors, a column ``error`` is added: a document for which rows_of raises has one row with nulls
    and what was raised, and no other document is touched. Otherwise an exception fails the job.
    """
    kinds = StructType.fromDDL(schema)
    carried = [f for f in docs.schema if f.name not in {"text", *kinds.names, *(["error"] if errors else [])}]
    shape = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in carried)
    whole = ", ".join(x for x in (shape, schema, "error string" if errors else "") if x)
    names = [*(f.name for f in carried), *kinds.names, *(["error"] if errors else [])]
    width = len(kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [pa.int32() if f.dataType.simpleString() == "int" else pa.string() for f in kinds] + [pa.string()] * errors
        for batch in batches:
            at: list[int] = []
            made: list[tuple] = []
            size = 0

            def out(batch: pa.RecordBatch, at: list[int], made: list[tuple]) -> pa.RecordBatch:
                own = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow, strict=True)]
                return pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(at)) for f in carried), *own], names)

            paths, texts = batch.column("path"), batch.column("text")
            for i in range(len(batch)):
                path, text = paths[i].as_py(), texts[i].as_py()
                if text is None:
                    continue
                try:
                    found = [(*row, *([None] * errors)) for row in rows_of(path or "", text)]
                except Exception as e:
                    if not errors:
                        raise
                    found = [(*[None] * width, f"{type(e).__name__}: {e}")]
                at.extend([i] * len(found))
                made.extend(found)
                size += sum(len(x) for row in found for x in row if isinstance(x, str))
                if size >= BATCH_CHARS and made:
                    yield out(batch, at, made)
                    at, made, size = [], [], 0
            if made:
                yield out(batch, at, made)

    return docs.mapInArrow(run, whole)


def _chunked(spans: Spans, docs: DataFrame, max_lines: int) -> DataFrame:
    return by_document(docs, lambda path, text: chunk_rows(spans, path, text, max_lines)).select(*(_quoted(c) for c in docs.columns if c not in MADE and c != "text"), *MADE)


def fixed_lines(docs: DataFrame, max_lines: int) -> DataFrame:
    """Windows of max_lines lines; blank ones are left out, line numbers count on."""
    return _chunked(windows, docs, max_lines)


def markdown_heading(docs: DataFrame, max_lines: int) -> DataFrame:
    """Blocks under headings, long ones in pieces that keep the heading's path; other files, and texts without a
    heading, in fixed windows."""
    return _chunked(markdown_spans, docs, max_lines)


def code_ast(docs: DataFrame, max_lines: int) -> DataFrame:
    """Top-level statements of Python files, and what lies between them, whole; other files, and texts that do not parse
    or give nothing, in fixed windows."""
    return _chunked(code_spans, docs, max_lines)


def heading_blocks(docs: DataFrame) -> DataFrame:
    """The blocks that headings begin, with level, title and heading_path."""
    return by_document(docs, lambda _, text: H.blocks(text.splitlines()), "start_line int, end_line int, level int, title string, heading_path string")


def sections(docs: DataFrame, settings: list[tuple[str, int]]) -> DataFrame:
    """The chunks of all settings (a name of SPANS and max_lines) in one pass over docs; ``setting`` is the number of each one's."""

    def rows(path: str, text: str) -> Iterator[tuple]:
        for k, (name, max_lines) in enumerate(settings):
            for row in chunk_rows(SPANS[name], path, text, max_lines):
                yield k, *row

    return by_document(docs, rows, f"setting int, {CHUNK}")


def per_document(rows_of: Callable[[str, str], Iterable[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """A chunker for imports from a function of a document's path and text, which gives rows of CHUNK. What it raises for one
    document becomes that one's ``error``; the others are chunked."""
    return lambda docs: by_document(docs, rows_of, errors=True)


class ChunkText:
    """Table function chunk_text(strategy, path, text, max_lines): the rows of CHUNK, for SQL."""

    @staticmethod
    def analyze(strategy: AnalyzeArgument, path: AnalyzeArgument, text: AnalyzeArgument, max_lines: AnalyzeArgument) -> AnalyzeResult:
        if not strategy.isConstantExpression or strategy.value not in SPANS:
            raise ValueError(f"no strategy {strategy.value!r}; there are {', '.join(sorted(SPANS))}")
        if max_lines.isConstantExpression and (max_lines.value is None or max_lines.value < 1):
            raise ValueError("max_lines must be 1 at least")
        return AnalyzeResult(CHUNK_TYPE)

    def eval(self, strategy: str, path: str | None, text: str | None, max_lines: int) -> Iterator[tuple]:
        if text is not None:
            yield from chunk_rows(SPANS[strategy], path or "", text, max_lines)


class FindHeadings:
    """Table function heading_blocks(text): the blocks that headings begin."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from H.blocks((text or "").splitlines())


def register_table_functions(spark: SparkSession) -> None:
    """Makes chunk_text and heading_blocks known to SQL: FROM docs, LATERAL chunk_text('code_ast', path, text, 50)."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, useArrow=True))
    spark.udtf.register("heading_blocks", F.udtf(FindHeadings, returnType="start_line int, end_line int, level int, title string, heading_path string", useArrow=True))


SPANS: dict[str, Spans] = {"fixed_lines": windows, "code_ast": code_spans, "markdown_heading": markdown_spans}
STRATEGIES: dict[str, Strategy] = {"fixed_lines": fixed_lines, "code_ast": code_ast, "markdown_heading": markdown_heading}


def get_strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def chunk_all(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """All chunks of docs with drop_rule, null for those that stay."""
    config = config or ChunkConfig()
    return filter_chunks(get_strategy(config.strategy)(docs, config.max_lines), config.filter)


def chunk(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """The chunks that stay, with the numbers that they have among all."""
    return chunk_all(docs, config).filter("drop_rule is null").drop("drop_rule", "drop_detail")


def citation(chunks: DataFrame) -> Column:
    return F.concat(chunks["path"], F.lit(":"), chunks["start_line"].cast("string"), F.lit("-"), chunks["end_line"].cast("string"))


def prompt_text(chunks: DataFrame) -> Column:
    """The content under its heading path, as it is shown to a model; never stored."""
    return F.when(chunks["heading_path"] == "", chunks["content"]).otherwise(F.concat(F.lit("【"), chunks["heading_path"], F.lit("】\n\n"), chunks["content"]))
