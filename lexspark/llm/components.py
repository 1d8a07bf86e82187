"""Connected components of links by alternating large-star and small-star steps.

Each step is an aggregation and a join on ids; a hot node's links are spread by AQE in the join and aggregated before
the shuffle.  Every round is written to the shared folder, so rounds do not pile up lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.storage import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame) -> DataFrame:
    """links: (a, b), read as a's neighbours b; every neighbour and a itself are linked with the least of them."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = links.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
    return joined.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in edges (a, b), both bigint; component is the smallest id that links reach."""
    at = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        # Large star: neighbours greater than a, and a, go to the least; then small star among the rest.
        large = _both(at)
        least = large.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        grown = large.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        small = scratch.save(_star(grown.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        # Done when every node has one parent and no parent has a parent.
        parents = small.groupBy("b").agg(F.count("*").alias("n"))
        open_ = parents.filter("n > 1").select("b").unionByName(small.join(parents.select(F.col("b").alias("child")), F.col("a") == F.col("child"), "left_semi").select("b"))
        done = open_.isEmpty()
        scratch.drop(at)
        at = small
        if done:
            break
    return at.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(at.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
