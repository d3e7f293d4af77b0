"""Distributed union-find: connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def _toward_least(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """Send every link (node, other) to the hub's least neighbour: (other, least)."""
    joined = links.join(hubs, "node")
    return joined.select(F.col("other").alias("node"), F.col("least").alias("other")).where("node <> other")


def _are_stars(links: DataFrame) -> bool:
    """Whether every link (node, other) leads to a root: no node has two links, or is another's ``other``."""
    ends = links.select("node", F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("other").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of_node.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0"))).first()[0] == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Large-star and small-star steps alternate until the links are stars, each around
    its least node; every step is a partial aggregate (the least neighbour) and an equi-join
    that adaptive execution can split at hot hubs. Links that are stars already take no step.
    A step's links are written to the shared folder, so the lineage stays short and lost
    executors cost one step.
    """
    links = (
        edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .where("node <> other")
        .distinct()
    )
    links = stored(links, "links")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        hubs = both.groupBy("node").agg(F.min("other").alias("least"))
        hubs = hubs.select("node", F.least("node", "least").alias("least"))
        large = _toward_least(both.where("other > node"), hubs)  # at most a row a link; here and below node > other
        hubs = large.groupBy("node").agg(F.min("other").alias("least"))
        small = _toward_least(large, hubs).unionByName(hubs.select("node", F.col("least").alias("other")))
        links = stored(small.distinct(), "links")
    roots = links.select(F.col("other").alias("node")).distinct()
    return links.select("node", F.col("other").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
