"""The folds by which trained operators are judged, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.graphs import small


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the key as text leaves 1 when divided by 3. False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, label: str, most: int, key: str = "doc_id", skip: int = 0) -> DataFrame:
    """At most ``most`` rows of each label (all, if fewer), the same ones at each run: those whose hashed key is least, one row for each
    key, however often it is repeated. With skip, those that come after a sample of so many rows. Rows without key or label have no part.

    Only labels and keys are ranked, each task's least ones at a time; of a key's rows the least stands for it.
    """
    at = F.xxhash64(F.col(key), F.lit(17))
    order = Window.partitionBy(label).orderBy("__at", key)
    keys = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(label, key).agg(F.first(at).alias("__at"))
    ranked = keys.withColumn("__rank", F.row_number().over(order)).filter((F.col("__rank") <= skip + most) & (F.col("__rank") > skip))
    chosen = ranked.select(label, key)
    others = [c for c in rows.columns if c not in (label, key)]
    if not others:
        return chosen.select(*rows.columns)
    known = rows.join(small(chosen), [label, key]).groupBy(label, key).agg(F.min(F.struct(*others)).alias("__row"))
    return known.select(*(F.col(c) if c in (label, key) else F.col("__row").getField(c).alias(c) for c in rows.columns))
