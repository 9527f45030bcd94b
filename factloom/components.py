"""Connected components of an edge table, by rounds of star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage, release


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(*keys, "a").agg(F.least("a", F.min("b")).alias("m"))
    moved = both.filter(F.col("b") > F.col("a")).join(least, [*keys, "a"])
    return moved.select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller neighbours of a node, and the node, move to the smallest of them."""
    least = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    moved = edges.join(least, [*keys, "a"]).filter(F.col("b") != F.col("m"))
    return moved.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(*keys, "a", F.col("m").alias("b")))


def components(edges: DataFrame, left: str, right: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, node, component: for every node with an edge, the smallest node it is connected with.

    Nodes of both columns need one ordered type. With ``keys`` each value has a graph of its own. A hub is
    never gathered: minima are combined before the shuffle, and joins on a hub are left to AQE's skew handling.
    The rounds go on to the fixed point; their number grows with the logarithm of the nodes.
    """
    named = list(keys)
    a, b = F.col(left), F.col(right)
    rows = edges.filter(a != b).select(*named, F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    rows, before = cut_lineage(rows, "edges"), None
    while True:
        moved = cut_lineage(_small_star(_large_star(rows, named).distinct(), named).distinct(), "stars")
        release(rows)
        rows = moved
        sums = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*named, "a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
    roots = rows.select(*named, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return rows.select(*named, F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
