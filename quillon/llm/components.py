"""Connected components by alternating large-star and small-star steps.

Everything stays in tables: a step is one aggregation and one join on a node,
and a hot node's rows can be split by Spark's skew join.  Each round is written
to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where(F.col("v") < F.col("u"))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        low = low.withColumn("m", F.least("m", "u"))
        out = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for every node with an edge (u, v)."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    while True:
        # Done when every node points to one lower node and no such node points further.
        n, nodes = e.count(), e.select("u").distinct().count()
        inner = n == nodes and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if n == nodes and not inner:
            break
        before, e = e, stored(_star(_star(e, True), False), "edges")
        dropped(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
