"""Rules that drop chunks without value. The first rule that a chunk breaks is its drop_rule; repeats are looked for
among the chunks that the other rules leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.config import FilterConfig
from scriptorium.functions import text as T

#: Lines that are page numbers.
PAGE_LINES = (
    rf"^第[{T.SPACE}]*\p{{Nd}}+[{T.SPACE}]*页([{T.SPACE}]*[/／|][{T.SPACE}]*共?[{T.SPACE}]*\p{{Nd}}+[{T.SPACE}]*页)?\z",
    rf"(?i)^page[{T.SPACE}]+\p{{Nd}}+([{T.SPACE}]*(/|of)[{T.SPACE}]*\p{{Nd}}+)?\z",
    rf"^-{{0,2}}[{T.SPACE}]*\p{{Nd}}{{1,3}}[{T.SPACE}]*-{{0,2}}\z",
)


def no_text(content: Column) -> Column:
    return ~content.rlike(r"[\p{L}\p{N}]")


#: How a page number begins.
PAGE_BEGIN = r"^(第|-|\p{Nd}|[pP][aA][gG][eE])"


def page_furniture(content: Column) -> Column:
    """Whether every line with text is a page number, and there is one. Lines are looked at only if the first may be one."""
    lines = F.filter(F.transform(T.split_lines(content), T.strip), lambda x: x != "")

    def is_page(line: Column) -> Column:
        a, b, c = (line.rlike(p) for p in PAGE_LINES)
        return a | b | c

    begins = F.substring(T.strip(content), 1, 4).rlike(PAGE_BEGIN)
    return F.when(begins, (F.size(lines) > 0) & F.forall(lines, is_page)).otherwise(F.lit(False))


def filter_chunks(chunks: DataFrame, config: FilterConfig | None = None, more: dict[str, Callable[[Column], Column]] | None = None, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """chunks (path, chunk_no, content and others) with drop_rule and drop_detail, null for those that stay.

    more: rules of the user by name, each from the content's column to a condition; they come after the built-in ones and
    before the search for repeats. Repeats are searched for among chunks of equal ``by``.
    """
    config = config or FilterConfig()
    if not config.enabled:
        return chunks.withColumn("drop_rule", F.lit(None).cast("string")).withColumn("drop_detail", F.lit(None).cast("string"))
    content = F.col("content")
    rule = F.when(no_text(content), "no_text").when(page_furniture(content), "page_furniture")
    if config.min_chars:
        rule = rule.when(F.length(T.strip(content)) < config.min_chars, "too_short")
    for name, breaks in (more or {}).items():
        rule = rule.when(breaks(content), name)
    found = chunks.withColumn("drop_rule", rule)
    if config.drop_duplicates:
        first = Window.partitionBy(*by, "__key", F.col("drop_rule").isNull()).orderBy("chunk_no")
        again = F.col("drop_rule").isNull() & (F.row_number().over(first) > 1)
        found = found.withColumn("__key", F.sha2(T.fold_key(content), 256)).withColumn("drop_rule", F.when(again, "duplicate").otherwise(F.col("drop_rule"))).drop("__key")
    size = F.length(T.strip(content)).cast("string")
    return found.withColumn("drop_detail", F.when(F.col("drop_rule") == "too_short", F.concat(size, F.lit(f" of {config.min_chars} characters"))))


def dropped_by_rule(chunks: DataFrame) -> DataFrame:
    """(drop_rule, n): chunks for each rule, ``kept`` for those that stay."""
    return chunks.groupBy(F.coalesce("drop_rule", F.lit("kept")).alias("drop_rule")).agg(F.count("*").alias("n"))


def summary(counts: dict[str, int]) -> str:
    """One line of the counts that ``dropped_by_rule`` gives."""
    gone = {k: n for k, n in sorted(counts.items()) if k != "kept"}
    return f"{sum(gone.values())} chunks dropped" + (f" ({', '.join(f'{k} {n}' for k, n in gone.items())})" if gone else "")
