"""Distributed union-find over a table of links.

Links are rewritten by alternating large-star and small-star steps until every
component is a star around its smallest node.  A step is one minimum per node
(combined on the map side) joined back to the links; a node with a third of all
links is a skewed join key, which adaptive execution splits, never a collected
group.  Each round is written to the shared folder, so lineage stays short and a
lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefp.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v), u > v.  Large: every larger neighbour of a node moves to
    the node's least neighbour; small: every smaller neighbour does, and the node."""
    sides = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        sides = sides.unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = sides.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    joined = sides.join(least, "n")
    if large:
        moved = joined.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(
            least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return moved.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another node; the component is
    its smallest node.  Null ends, self-links and repeated links are ignored."""
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialize(links, "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        links = materialize(_star(_star(links, True), False), "links")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
