"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, stacked

MAX_ROUNDS = 100


def _pointed(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each (u, v) with the least node known to u. A hot u is a skewed join key, which Spark splits."""
    return links.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are tied to the least of its neighbourhood."""
    both = stacked(edges.select("u", "v"), edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _pointed(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _pointed(down, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint); root is the component's least node.

    Edges shrink to stars in a number of rounds that grows with the logarithm of the nodes. Each round is written to the
    shared folder, so lineage stays short and a lost executor repeats one round at most. Only two numbers a round come
    to the driver. An empty edge table gives an empty result.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)), "stars")
        # Sums of hashes tell two edge sets apart; shifting keeps them within range.
        now = tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stacked(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), roots)
