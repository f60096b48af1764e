"""Connected components by alternating large-star and small-star.

Large-star links each neighbour above a node to the least node of the node's
neighbourhood, small-star those below it and the node itself.  Rounds go on until
a pair of them changes nothing.  A node's neighbourhood is only aggregated and
joined, never gathered, so a node with very many links is split like any skewed
key of a join; links are written after each half round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, stage


def star(links: DataFrame, large: bool) -> DataFrame:
    """One half round over links (a, b) with b < a."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        # every node with its whole neighbourhood; keeps the neighbours above it
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``links`` (a, b); the component is its least node."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stage(ordered, "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before, is_now = None, mark(now)
    while before != is_now and is_now[0]:
        before = is_now
        last = now
        now = settled(links.sparkSession, "small", lambda: star(stage(star(last, True), "large"), False))  # noqa: B023
        is_now = mark(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
