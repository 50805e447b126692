"""Connected components by alternating large-star and small-star steps.

Each step's edges are written to the shared folder, so a lost executor costs one step at most. A step shuffles
edges by node and keeps one minimum a node; no group of neighbours is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut_lineage


def _minima(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Ties every neighbour of u that is larger than u to the smallest node around u. edges: (u, v), each pair once."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Ties u and its smaller neighbours to the smallest of them. edges: (u, v) with v < u."""
    low = _minima(edges)
    ties = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first())


def star_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node.

    links: (a, b) in any order, repeated or not; links of a node to itself and NULLs are left out.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before, now = None, _state(edges)
    while now != before and now[0]:
        wide = cut_lineage(large_star(edges), "large-star")
        edges = cut_lineage(small_star(wide), "small-star")
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
