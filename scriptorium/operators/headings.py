"""Structure of Markdown texts: headings, their ancestors, the blocks they begin, and pieces of long blocks.

Headings of a table come from expressions over its lines. Ancestors and pieces need what went before within a document: one pass
over its lines, with the open headings on a stack, so time is that of the lines whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: One to six signs after spaces, then a space or tab; a title must follow.
HEADING = r"(?s)^ *(#{1,6})[ \t](.*)$"
_HEADING = re.compile(r" *(#{1,6})[ \t](.*)", re.S)
MARKDOWN = (".md", ".markdown")


def is_markdown(path: str | None) -> bool:
    return (path or "").lower().endswith(MARKDOWN)


def find_headings(lines: Column) -> Column:
    """An array of (line, level, title), lines from 1."""

    def one(line: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("line"),
            F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
            T.strip(F.regexp_extract(line, HEADING, 2)).alias("title"),
        )

    may = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^ *#{1,6}[ \t]"), one(x, i))), lambda h: h.isNotNull())
    return F.filter(may, lambda h: h["title"] != "")


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a line that is a heading."""
    found = _HEADING.match(line) if "#" in line else None
    title = found[2].strip() if found else ""
    return (len(found[1]), title) if found and title else None


def blocks(lines: list[str]) -> Iterator[tuple[int, int, int, str, str]]:
    """(first line, last line, level, title, path) of the block that each heading begins, which goes to the line before the next, and
    of one of level 0 before the first. A path has the titles of a heading's ancestors and its own, joined by ' > '. Texts
    without a heading have no blocks."""
    stack: list[tuple[int, str]] = []
    start, level, title = 1, 0, ""
    for n, line in enumerate(lines, 1):
        if not (found := heading(line)):
            continue
        if n > start:
            yield start, n - 1, level, title, " > ".join(t for _, t in stack)
        # levels on the stack rise, so what a heading closes is its end
        while stack and stack[-1][0] >= found[0]:
            stack.pop()
        stack.append(found)
        start, (level, title) = n, found
    if stack:
        yield start, len(lines), level, title, " > ".join(t for _, t in stack)


def pieces(lines: list[str], start: int, end: int, max_lines: int) -> Iterator[tuple[int, int]]:
    """(first line, last line): a block of more than max_lines lines in pieces.

    A piece ends at max_lines lines, or at a blank line once it is half full (two lines at least) and has two lines
    that are not blank. What is left, when it fits, is the last piece.
    """
    least, filled = max(2, max_lines // 2), 0
    for n in range(start, end + 1):
        if end - start + 1 <= max_lines:
            break
        blank = not lines[n - 1].strip()
        filled += not blank
        count = n - start + 1
        if count >= max_lines or (blank and count >= least and filled >= 2):
            yield start, n
            start, filled = n + 1, 0
    if start <= end:
        yield start, end
