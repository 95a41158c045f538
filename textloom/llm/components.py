"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Links (u, v) with the least neighbour of u; the table of those is written, so that skewed u can be split."""
    least = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(least.hint("merge"), "u")


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) for each node of the links (u, v), nodes that stand alone left out.

    Alternating large-star and small-star steps: each links larger
    neighbours, then smaller ones, to the least one known. The links become
    stars after a number of rounds that grows with the logarithm of the
    diameter. No node's neighbours are ever gathered, only their minimum.
    """
    scratch = Scratch(spark)
    now = scratch.keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(scratch, both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = scratch.keep(large)
        small = _with_least(scratch, large)
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.keep(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
