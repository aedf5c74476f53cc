"""Tables that join by size, and connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.cuts import cut

#: Most rows of a few plain columns that may be broadcast (some 40 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """df with a broadcast hint if a count finds at most so many rows; any larger df is left to a shuffled join.

    items names an array column whose elements count besides the rows.
    """
    if df.limit(most + 1).count() > most:
        return df
    if items and (df.agg(F.sum(F.size(items)) + F.count("*")).first()[0] or 0) > most:
        return df
    return F.broadcast(df)


def _least(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node's larger neighbours, then the node's smaller ones, go to its least."""

    def near(e: DataFrame, keep: Column) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return e.filter(keep).join(least, "u")

    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = near(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # from here on, v < u in every row
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that it reaches.

    Alternates large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)
    until every node has one edge, to a node that has none. Every group is reduced by min, which Spark combines before the
    shuffle; rounds are about the logarithm of the number of nodes. Each round is cut to a table.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = cut(edges.distinct(), "links")

    def settled(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(df.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").isEmpty()

    while not settled(now):
        now = cut(_least(now), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
