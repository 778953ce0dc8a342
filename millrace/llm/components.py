"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

#: Parts that the neighbours of one node are dealt into, so that a node with very many meets none of its tasks alone.
PARTS = 64


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest ``v`` of its ``u``, which comes once for each part of the neighbours."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    each = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = each.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))  # PARTS at most
    return dealt.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    found = _with_least(edges.union(edges.select("v", "u"))).filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest."""
    found = _with_least(edges)
    return found.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 60, most_edges: int | None = None) -> DataFrame:
    """(node, root) for every node that has an edge and isn't its component's smallest; the root is the smallest node.

    Each round is written to the shared folder, so a lost executor costs one round at most; a round never has more
    edges than the one before, so a small graph's rounds are few files. ``most_edges`` says so of the edges given. Nodes are longs.
    """
    now = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).filter("u <> v").distinct()
    now, before = written(now, "edges", most_edges), None
    for _ in range(most_rounds):
        # sums wrap around on both sides alike, and xor of hashes needs no order
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = written(_small_star(_large_star(now)), "edges", state[0])
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
