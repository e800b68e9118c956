"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(a long, b long)``; root is the smallest node reachable.

    Loops and repeated edges are ignored; without edges the result is empty.
    Each round replaces edges by edges to smaller neighbours, keeps as many at
    most, and is written, so that a lost executor never repeats earlier rounds.
    The number of rounds grows with the logarithm of the longest chain. A node
    with very many edges is an aggregate's key and a join's key only: minima are
    combined before the shuffle and the join is split where it is skewed.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = small.select("v", F.col("m")).union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        edges = written(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now
