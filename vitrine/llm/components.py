"""Connected components of a graph given as links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.store import Store


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's least neighbour."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def star_roots(links: DataFrame, store: Store, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` but the roots themselves.

    The root is the least node of the component. Each round writes its links, so
    lineage stays short; they never grow in number. Links of a node to itself
    and repeated ones have no effect; no links give no rows. Joins on a hot node
    are plain shuffles on both sides, which adaptive execution splits.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = store.put(links, "links"), None
    for k in range(rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, links, seen = links, store.put(_small_star(_large_star(links)), f"stars{k}"), state
        store.drop("links" if not k else f"stars{k - 1}")
    raise RuntimeError(f"components not settled after {rounds} rounds")
