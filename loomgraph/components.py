"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b) that isn't its component's smallest node.

    Alternating large-star and small-star rounds: the number of links never grows, a node's minimum is a combinable
    aggregate, and each round is cut in the shared checkpoint folder. The minima are cut as well, so that the join that
    takes them to a hub's links reads two plain exchanges, of which adaptive execution splits a hub's.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        sums = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sums["n"] == 0 or (sums["n"], sums["x"]) == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = (sums["n"], sums["x"])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.least("u", "m").alias("m")))
        large = e.join(low, "a").select(F.col("m").alias("a"), "b").distinct()  # a < b: these are the links to larger nodes
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = cut(small.unionAll(least.select(F.col("m").alias("a"), "b")).distinct())
    raise RuntimeError("connected components didn't settle")
