"""Connected components of links by alternating stars: each round is a few joins, and lineage is cut by stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import discard, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(u, v)`` with u > v.

    Large star: each node's larger neighbours point to the smallest of the node and its neighbours. Small star:
    its smaller neighbours and itself do. The minimum is a partial aggregate, so a node with very many links is no hot task.
    """
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ways.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("_u"), F.least("low", "u").alias("low"))
    joined = ways.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            least.select(F.col("_u").alias("u"), F.col("low").alias("v"))
        )
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of the links ``(a, b)`` but the roots themselves.

    Self-links, nulls and repeated links change nothing; without links the result is empty.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    edges, path = store(edges, "edges")
    before = None
    while True:
        stepped, new_path = store(_star(_star(edges, True), False), "edges")
        state = stepped.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        edges, path = stepped, new_path
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
