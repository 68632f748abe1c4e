"""Connected components of an edge table.

Alternates two star steps: large star ties every greater neighbour of a node to
the least node around it, small star every lesser one. Both keep components as
they are, and in a number of rounds that grows with the logarithm of the nodes
the edges become stars around each component's least node. Each step is a
combined aggregation and a join, its result a table in the shared folder; a node
with very many edges is a skewed join side, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.min("dst").alias("_least"))
    joined = both.join(least, "src").where(F.col("dst") > F.col("src"))
    return joined.select("dst", F.least("src", "_least").alias("src"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("_least"))
    joined = down.join(least, "src")
    return joined.select("dst", F.col("_least").alias("src")).union(least.select("src", "_least"))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` (its least node) of every node in ``src, dst`` edges of BIGINTs."""
    tidy = lambda df: df.toDF("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    metrics = (F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum"))
    stars = tidy(edges.select(F.greatest("src", "dst"), F.least("src", "dst")))
    before, turn = None, 0
    while True:
        large = scratch.save(tidy(_large_star(stars)), f"{name}-large-{turn}")
        stars, seen = scratch.save_measured(tidy(_small_star(large)), f"{name}-small-{turn}", *metrics)
        if seen == before:
            break
        before, turn = seen, turn + 1
    leaves = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return leaves.union(stars.select(F.col("dst").alias("node"), F.col("dst"))).distinct()
