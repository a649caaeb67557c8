"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import _common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. large: joins each node's larger neighbours to its least; small: its least and itself to that."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes that hang on several others, or on one that hangs on another itself. Without any, the edges are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.filter(F.col("hangs") + F.col("holds") > 1).filter("hangs > 0").count()


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 100) -> DataFrame:
    """(node, component): the least node of each component, for every node that has an edge to another one.

    A number of rounds that grows with the logarithm of the longest path is enough; if they are used up, an error is raised.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    e = C.as_table(e, "edges", n=F.count(F.lit(1)))
    for _ in range(rounds):
        if not e.measured["n"] or not _unsettled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        new = C.as_table(_star(_star(e, True), False), "edges", n=F.count(F.lit(1)))
        C.drop_table(e)
        e = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
