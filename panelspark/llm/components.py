"""Connected components of links, in rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.sources.sinks import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link to another.

    links: undirected, of type long. Each round writes its links to the shared folder, so a lost executor costs no
    recomputation of earlier rounds. Groups are only aggregated (least neighbour) and joined, never gathered. A
    link of a node to itself is ignored. No links: no rows.
    """
    both = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, last = settle(both), None
    while True:
        edges = settle(_small_star(settle(_large_star(edges))))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links of each node to its larger neighbours are moved to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    near = both.toDF("u", "v")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.where(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links of each node to its smaller neighbours are moved to the least of them, as is the node itself."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
