"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the component's least node.

    Alternating star contraction: each node hangs its larger neighbours on the
    least node it knows, then its smaller ones. Edges stay as many as they
    were, and the number of rounds grows with the logarithm of the longest
    chain. Every round is written to the shared folder.
    """
    both = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        ways = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m"))
        large = ways.join(least, F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(least, F.col("u") == F.col("at"))
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        both = stored(moved.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        after = both.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            break
        before = tuple(after)
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
