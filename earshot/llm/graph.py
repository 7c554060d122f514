"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame, of: str) -> DataFrame:
    return edges.groupBy(of).agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link: root is the least node of its component.

    Alternates two rewrites of the edges until nothing changes: link each greater neighbour of a node to the node's least
    neighbour, then each smaller one. The edges never grow in number, depth halves or better each time, and the only thing
    that the driver sees is a count and a checksum. Minima are pre-aggregated, so a node with very many links has one row on one side
    of each join, and adaptive execution splits the other side's partition.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    check = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    before = check(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        large = both.join(_least(both, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        least = _least(large, "u")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        was, edges = edges, materialize(small.distinct(), "edges")
        discard(was)
        now = check(edges)
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tops.distinct())
