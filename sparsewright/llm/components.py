"""Connected components by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Parts that the links of one id are dealt into when they are joined with its smallest neighbour.
SALTS = 32


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and all its v.  A hub's pairs go to `SALTS` tasks."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("n") > 64 * SALTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    least = least.select("u", "m", F.explode(parts).alias("salt"))
    counted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    either = counted.unionByName(pairs.withColumn("salt", F.lit(-1)))  # only one of a pair's two rows meets its u
    return either.join(least, ["u", "salt"]).select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and none if it is another's: nothing is left to do."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    ups = F.sum("up")
    return ends.groupBy("id").agg(ups.alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): one row (id, component) per linked id; a component is named by its smallest id.

    The links become stars in O(log n) rounds of two written tables; a hub's links are never gathered in
    one task.  No links give no rows; a link of an id to itself gives it a component of its own.
    """
    nodes = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    edges = checkpointed(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), slim=True)
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        near = _with_smallest(checkpointed(large, slim=True))
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.filter("u != v").distinct(), slim=True)
    return nodes.join(edges.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
