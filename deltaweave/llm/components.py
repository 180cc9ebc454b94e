"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROWS = 100_000  # of links in one partition, at least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links` that isn't its component's least node, which is `root`.

    Links with a null end and links of a node to itself say nothing. Each round is two joins on a node against its least
    neighbour (one row for each node, so a node with many links is split, not gathered), and ends in a checkpoint. The
    rounds stop when the links no longer change; then every link leads to a root.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") > F.col("b")).distinct()
    edges = checkpoint(edges)
    state = _state(edges)
    while state[0]:
        edges = edges.coalesce(1 + state[0] // ROWS)  # a few links left needn't be many small files
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        edges = checkpoint(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a > b").distinct())
        del both, least, large, small
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
