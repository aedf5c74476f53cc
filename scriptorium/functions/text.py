"""Text functions with the meaning that Python gives them, as expressions of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are white space, as the inside of a class that Java and RE2 both read.
SPACE = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters, plainly.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What ends a line, and what of it is not a newline.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
RARE_END = r"[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def split_lines(c: Column) -> Column:
    """The lines of a text, without their ends; a last line end begins no line, and an empty text has none."""
    parts = F.when(c.rlike(RARE_END), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalize(c: Column) -> Column:
    """Line ends as newlines, and no white space at both ends."""
    return strip(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def fingerprint(c: Column) -> Column:
    """A document's identity: the first 16 hex digits of the SHA-256 of its normalized text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def fold_key(c: Column) -> Column:
    """A key under which texts are equal that differ in white space or, by full case folding, in case only.

    Capitals of small letters, small again, are equal where folded texts are, but for the dotless i, which is kept as it
    is, and the final sigma. A change of case directly on another would be simplified away.
    """
    bare = F.lower(F.regexp_replace(c, f"[{SPACE}]+", ""))
    capitals = F.upper(F.replace(bare, F.lit("ı"), F.lit("\ue000")))
    return F.replace(F.lower(F.replace(capitals, F.lit("\ue000"), F.lit("ı"))), F.lit("ς"), F.lit("σ"))
