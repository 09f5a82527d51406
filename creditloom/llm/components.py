"""Connected components of a link table, by alternating star contractions.

A large star links each node's larger neighbours to its smallest neighbour, a small star its smaller ones; the rounds
alternate until nothing changes, which leaves each node linked to its component's smallest node. A node with
very many links is met in joins of two stored sides only, which Spark can split; minima combine before the shuffle.
Every step is stored, so a lost executor repeats one step. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import stored


def roots(links: DataFrame) -> DataFrame:
    """node, root for every node that has a link; the root is the component's smallest node.

    Links are two columns a, b of comparable nodes in any order and number; nulls and loops are ignored.
    """
    ordered = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, seen = stored(ordered.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        edges = _small_star(_large_star(edges))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "large-star")
    larger = both.where("v > u").join(least, "u")
    return stored(larger.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "links")


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    smaller = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
