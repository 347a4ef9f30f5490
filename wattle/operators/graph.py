"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.session import ensure_checkpoint_dir


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of
    ``edges`` (a, b; integers).

    Contraction: each node points to its least neighbour, if that is smaller;
    pointers are followed to their end by doubling; edges move to the ends, and
    those inside one end vanish. Every round at least halves the nodes that
    still have edges, so rounds are logarithmic, and each is checkpointed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = _both_ways(edges.select("a", "b").where("a <> b")).checkpoint()
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().checkpoint()
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.min("b").alias("b"))
        up = up.select("a", F.least("a", "b").alias("b")).checkpoint()
        while True:
            over = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
            far = up.join(over, "b").select("a", F.col("c").alias("b"), (F.col("b") != F.col("c")).alias("moved"))
            far = far.checkpoint()
            up = far.select("a", "b")
            if far.where("moved").isEmpty():
                break
        move = up.select(F.col("a").alias("root"), F.col("b").alias("next"))
        roots = roots.join(move, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")).checkpoint()
        one = edges.join(up.select("a", F.col("b").alias("u")), "a").select("u", "b")
        two = one.join(up.select(F.col("a").alias("b"), F.col("b").alias("v")), "b").select("u", "v")
        edges = two.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct().checkpoint()
    return roots
