"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins. Minima combine before the
shuffle and are written before they are joined, so that both sides of a join are plain shuffles,
of which adaptive execution can split a hub's rows. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Only nodes of at least one edge are returned. Edges between a node and itself, null
    ends and repeated edges are of no account. No edge gives no row.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v").distinct()
    now = scratch.save(pairs, "edges")
    state = _state(now)
    while state[0]:
        # large star: each neighbour above a node is linked to the smallest of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = scratch.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        # small star: a node's smaller neighbours are linked to the smallest of them
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        scratch.drop(now, least, large, low)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    # now a star: each node is linked to its component's smallest node alone
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
