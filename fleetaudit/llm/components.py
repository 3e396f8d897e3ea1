"""Connected components by alternating neighbour contraction, as joins and grouped minima."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (a, b: long).

    Large step: each node's larger neighbours move to its smallest neighbour. Small step: a node's
    smaller neighbours and the node itself move to the smallest of them. The edges never grow in
    number and end as stars. Each round is written to the shared folder, so the lineage stays short
    and a lost executor costs one round. No neighbour list is gathered: the smallest neighbour is a
    grouped minimum, joined back. ``edges`` is read several times: it should be a written table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        # A node without a smaller neighbour is the smallest itself.
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        large = edges.join(low, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v"))
        floor = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        # Of the rows of a node that with its smallest neighbour stands for the node itself.
        small = large.join(floor, F.col("u") == F.col("n")).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("n")).alias("u"), F.col("m").alias("v"))
        edges = staged(small.distinct(), "edges")
        # Stars at last: no node has two smaller neighbours, and nobody's smaller neighbour has one itself.
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
