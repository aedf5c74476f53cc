"""How well a chunking strategy serves questions: a case is hit if one chunk of its file covers the expected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scriptorium.config import ChunkConfig
from scriptorium.operators import chunking
from scriptorium.operators.filters import filter_chunks

CASE = "id string, question string, path string, source_text string, expect_start_line int, expect_end_line int, family string, failure_mode string"


#: Lines of a range in which cases meet chunks.
RANGE = 64


def _chunks(sources: DataFrame, configs: list[ChunkConfig]) -> DataFrame:
    """Chunks (setting, __source, chunk_no, start_line, end_line, citation) that stay, of each of sources (__source, path, text) and of configs."""
    made = chunking.sections(sources, [(c.strategy, c.max_lines) for c in configs])
    kept = []
    for rules in dict.fromkeys(c.filter for c in configs):
        own = [k for k, c in enumerate(configs) if c.filter == rules]
        of_rules = made if len(own) == len(configs) else made.filter(F.col("setting").isin(own))
        kept.append(filter_chunks(of_rules, rules, by=("setting", "__source")).filter("drop_rule is null"))
    whole = kept[0]
    for more in kept[1:]:
        whole = whole.unionByName(more)
    return whole.select("setting", "__source", "chunk_no", "start_line", "end_line", chunking.citation(whole).alias("citation"))


def outcomes_of(cases: DataFrame, configs: list[ChunkConfig]) -> DataFrame:
    """(setting, id, family, path, hit, matched_citation) for each case and the number of each of configs: the first covering
    chunk's citation, null for a miss.

    Each distinct file is read once and chunked by all settings.
    """
    sources = cases.select("path", F.col("source_text").alias("text")).distinct().withColumn("__source", F.xxhash64("path", "text").cast("string"))
    return _met(sources, cases.withColumn("__source", F.xxhash64("path", "source_text").cast("string")), configs)


def outcomes_in(sources: DataFrame, cases: DataFrame, configs: list[ChunkConfig]) -> DataFrame:
    """``outcomes_of`` cases (id, family, path, expect_start_line, expect_end_line) whose files are rows of sources (path, text), a path once."""
    return _met(sources.select("path", "text").withColumn("__source", F.col("path")), cases.withColumn("__source", F.col("path")), configs)


def _met(sources: DataFrame, cases: DataFrame, configs: list[ChunkConfig]) -> DataFrame:
    """The outcomes of cases by their __source. A chunk stands in the ranges of RANGE lines that it has lines in, a case in that
    of its first line, and only chunks and cases of one range meet; so many cases of one long file are no product with its chunks.
    """
    chunks = _chunks(sources, configs)
    dealt = chunks.withColumn("__range", F.explode(F.sequence(F.expr(f"start_line div {RANGE}"), F.expr(f"end_line div {RANGE}"))))
    asked = cases.withColumn("__range", F.expr(f"expect_start_line div {RANGE}"))
    asked = asked.select("id", "family", "path", "__source", "__range", "expect_start_line", "expect_end_line").withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))))
    met = asked.join(dealt, ["setting", "__source", "__range"], "left")
    covers = (F.col("start_line") <= F.col("expect_start_line")) & (F.col("end_line") >= F.col("expect_end_line"))
    found = met.groupBy("setting", "id", "family", "path").agg(F.min(F.when(covers, F.struct("chunk_no", "citation"))).getField("citation").alias("matched_citation"))
    return found.select("setting", "id", "family", "path", F.col("matched_citation").isNotNull().alias("hit"), "matched_citation")


def outcomes(cases: DataFrame, config: ChunkConfig) -> DataFrame:
    """``outcomes_of`` one setting: (id, family, path, hit, matched_citation)."""
    return outcomes_of(cases, [config]).drop("setting")


def compare(cases: DataFrame, configs: list[ChunkConfig]) -> DataFrame:
    """(strategy, max_lines, family, hits, total) for each family of cases, and for all of them as family ``all``, by each setting; all
    settings in one pass."""
    got = outcomes_of(cases, configs).groupingSets([["setting", "family"], ["setting"]], "setting", "family").agg(
        F.grouping("family").alias("g"), F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("total")
    )
    name = F.element_at(F.array(*(F.lit(c.strategy) for c in configs)), F.col("setting") + 1)
    lines = F.element_at(F.array(*(F.lit(c.max_lines) for c in configs)), F.col("setting") + 1)
    return got.select(name.alias("strategy"), lines.alias("max_lines"), F.when(F.col("g") == 1, "all").otherwise(F.col("family")).alias("family"), "hits", "total")


def by_family(cases: DataFrame, config: ChunkConfig) -> DataFrame:
    """``compare`` of one setting."""
    return compare(cases, [config])


def chunk_counts(cases: DataFrame, config: ChunkConfig) -> DataFrame:
    """(path, chunks) of the cases' files."""
    sources = cases.select("path", F.col("source_text").alias("text")).distinct()
    return chunking.chunk(sources, config).groupBy("path").agg(F.count("*").alias("chunks"))


def of_family(cases: DataFrame, family: str) -> DataFrame:
    return cases.filter(F.col("family") == family)


def summary(rows: list[Row]) -> str:
    """One line of what ``by_family`` gives for one setting."""
    (whole,) = [r for r in rows if r.family == "all"]
    parts = ", ".join(f"{r.family}:{r.hits}/{r.total}" for r in sorted(rows, key=lambda r: r.family) if r.family != "all")
    return f"{whole.strategy}(max_lines={whole.max_lines}) hit_rate={whole.hits}/{whole.total}={whole.hits / whole.total:.2f} [{parts}]"
