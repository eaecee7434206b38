"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentspark.llm.frames import hot_rows, join_hot
from sentspark.storage import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of all ends of ``edges(a, b)``.

    Alternates large-star and small-star steps until the links are stars around their
    smallest nodes: a number of rounds that is logarithmic in the longest path. Every step
    is a partial aggregate and a join; the links of a node with very many of them stay where
    they are, and what the node needs is brought to them.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    while (state := _state(edges)) != seen:
        seen = state
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        low = materialise(low, "links-low")
        stars = join_hot(both, low, "a", hot_rows(low, 2 * state[0]))
        large = stars.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        low = materialise(low, "links-low")
        # the large step leaves no more links than there were ends
        stars = join_hot(large, low, "a", hot_rows(low, 2 * state[0]))
        small = stars.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = materialise(small.filter("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
