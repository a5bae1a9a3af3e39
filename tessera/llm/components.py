"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each u; a table of its own, so that the join with it can split a frequent u."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: each v is then the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u and v, longs, in any direction. A row per node that isn't the smallest of its component: u, and the smallest as v."""
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        low = _least(large)
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "edges")
        release(edges, least, large, low)
        edges = new
    return edges
