"""Connected components of an edge list by alternating large-star and small-star steps, as joins
and aggregates only: no node's neighbours are ever gathered, the edges of a hub are not sent to one
task, and every step is written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import cut, skew_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), where root is the component's least node.
    Self-loops and repeated edges are allowed; null ends are ignored."""
    edges = edges.select("a", "b").filter("a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = cut(skew_join(both.filter("b > a"), least.filter("n > 0"), "a", before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = skew_join(large, low, "a", before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
