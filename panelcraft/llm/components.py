"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return scratch.save(out.where("u <> v").distinct(), "large")


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return scratch.save(out.where("u <> v").distinct(), "small")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From links (u, v) to (node, component): the smallest node reachable, for every node that has a link.

    Both steps are one aggregation and one join on small rows. The star centre of a hot group is pre-aggregated
    on the map side, and the minima are read back from files, so that the skewed join can be split. The steps
    alternate until the links no longer change; only a count and two sums come to the driver.
    """
    edges = scratch.save(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        edges = _small_star(_large_star(edges, scratch), scratch)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
