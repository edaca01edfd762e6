"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable over the undirected links.

    Nodes without a link to another node, and null ends, are left out. Links may repeat. Each round is
    one written table, so lineage stays short and a lost executor costs at most one round. No
    neighbourhood is ever collected: a hub's rows meet only in aggregates and in joins that AQE splits. Nothing is
    broadcast: the planner sizes the minima by the links' compressed files, many times less than they hold.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    links = materialize(links, "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        small = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = materialize(small.distinct(), "links")
        new = _state(links)
        if new == state:
            break
        state = new
    root = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return root.union(links.select("b", "b")).distinct()


def _state(links: DataFrame) -> tuple:
    """Count and an order-free digest: a round that changes nothing leaves both as they were."""
    row = links.agg(
        F.count(F.lit(1)),
        F.bit_xor(F.xxhash64("a", "b")),
        F.sum(F.xxhash64("b", "a", F.lit(3)).cast("decimal(38,0)")),
    ).first()
    return tuple(row)
