"""Connected components of an edge table by alternating large-star and small-star
steps; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with v < u. Large star: connect the larger neighbours of every node to
    the smallest of node and neighbours; small star: the node and its smaller ones."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    x = both.join(low, F.col("u") == F.col("c"))
    if large:
        out = x.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = x.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(x.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) -> ``node, comp`` with comp the smallest node of the component, for
    every node that has a link."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u <> v").distinct(), tag)
    before = None
    for _ in range(max_rounds):
        edges = materialise(_star(_star(edges, True), False), tag)
        # the number of edges and the sum of their ends no longer change: every node points to its smallest
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
