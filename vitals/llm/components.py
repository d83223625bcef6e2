"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import landed


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``edges`` (a, b).

    Each round halves the distance to the smallest id. A node's neighbours are
    never gathered: their minimum is combined before the shuffle and joined back,
    where adaptive execution splits the node with most links.
    """
    edges = landed(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").distinct()
        large = landed(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").selectExpr("b a", "m b")
        edges = landed(small.unionByName(least.selectExpr("a", "m b")).distinct(), "small-star")
        now = _state(edges)
        if now == before:
            break
        before = now
    # every edge now leads from a node to the smallest of its component
    out = edges.selectExpr("a id", "b component")
    return out.unionByName(edges.select("b").distinct().selectExpr("b id", "b component"))
