"""Connected components by alternating large-star and small-star steps, all as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.session import stored

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable from it.

    Each step writes its table to the shared folder, so lost executors cost a task and plans stay
    short. The minima of a step are stored before they meet the links again: the join then has an
    exchange on both sides, and AQE can split the links of a hub. Rounds grow with the logarithm
    of the longest chain. Null ends and links to itself are ignored.
    """
    a, b = F.col("a"), F.col("b")
    pairs = links.where("a is not null and b is not null and a <> b")
    edges = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        edges = _small_star(_large_star(edges))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _mark(edges: DataFrame):
    # Both steps only ever move ends to smaller nodes, so an unchanged hash means unchanged links.
    # Wrapping 64-bit sums of hashes cannot overflow as decimals of 38 digits.
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the node's smallest neighbour."""
    lowest = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    hubs = edges.select("v").distinct().withColumnRenamed("v", "u")
    # The smallest neighbour of v, itself included: v, or what v as the larger end knows.
    near = stored(hubs.join(lowest, "u", "left").select(F.col("u").alias("v"), F.coalesce("m", "u").alias("m")), "near")
    return stored(edges.join(near, "v").select("u", F.col("m").alias("v")).distinct(), "large")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get the smallest of them."""
    lowest = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    moved = edges.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small")
