"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import settle


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for every node of `links` (a, b); the component is one of its nodes.

    Each round draws a new random order of the nodes, points every node to the first of itself and
    its neighbours, and contracts: links become links between what their ends point to. A round
    removes a constant share of the remaining nodes on average, so their number of rounds grows with
    the logarithm of the longest path. Aggregates are combined before each shuffle, and joins split
    hot nodes; links and labels are written once a round. Raises if `rounds` were not enough.
    """
    links = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    for turn in range(rounds):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("o"), F.col(c).alias("n"))
        to = settle(
            both.groupBy("a").agg(F.min(order("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(order("a").alias("own"), F.col("m"))["n"].alias("to")), "steps",
        )
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), "to")
            labels = settle(
                labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels"
            )
        a, b = (to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = links.join(a, "a").join(b, "b").filter("to_a <> to_b")
        links = settle(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
