"""Connected components of a graph that does not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.session import written


def _checksum(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node ``u`` of the links (u, v) that is not the smallest of its component, the
    smallest, ``v``.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce
    and beyond", 2014), about log2 of the longest path of them; no task sees a whole component, as
    only minima meet at a node. Each round is written to the shared folder.
    """
    clean = edges.select("u", "v").filter("u != v")
    edges = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges
