"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import small as small_table
from framekit.session import cut

#: Edges of a node from which on it counts as a hot centre.
HOT_EDGES = 1_000


def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` with ``low`` of their ``a``; centres of very many edges, of which there are few, are brought to them rather than the edges to one task."""
    hot = small_table(cut(low.filter(F.col("edges") >= HOT_EDGES).select(F.col("a").alias("centre"), F.col("low").alias("hot_low")), "hot"))
    marked = edges.join(hot, edges["a"] == hot["centre"], "left").select(edges["a"], edges["b"], hot["hot_low"])
    cold = marked.filter("hot_low is null").select("a", "b").join(low.filter(F.col("edges") < HOT_EDGES).select("a", "low"), "a")
    return cold.select("a", "b", "low").union(marked.filter("hot_low is not null").select("a", "b", "hot_low"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``), where ``root`` is the smallest node that it reaches.

    Nulls and loops are left out. The work of a round is a grouping of the edges; their number never grows, and rounds grow as the
    logarithm of the longest path.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: larger neighbours of a node go to its smallest neighbour
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("edges"))
        large = _with_low(both, low).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: smaller neighbours and the node itself go to the smallest of them
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("edges"))
        small = _with_low(down, least).filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", "low"))
        following = cut(small.filter("a <> b").distinct(), "edges")
        # a forest of depth one: no node is both a child and a parent, and no node has two parents
        parents = following.select(F.col("b").alias("a")).distinct()
        unfinished = following.join(parents, "a", "left_semi").limit(1).count() or following.groupBy("a").count().filter("count > 1").limit(1).count()
        now = following
        if not unfinished:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
