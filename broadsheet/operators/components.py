"""Connected components of links, by alternating large and small stars (DataFrame functions only).

Every round is a minimum by node and a join on it; hubs are cut to stars of their smallest neighbour, and skewed joins
are left to adaptive execution. Nothing is gathered by component or sent to the driver. Rounds end when all components are
stars, which takes a logarithmic number of them, however long the chains are.

Defined results: nodes are of any type that has an order; repeated links, links in both directions and links of a node with itself
change nothing; links with a null end do not count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import session


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, F.col("u") == F.col("x"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
    joined = edges.join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or is the end of edges only."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.where("out > 1 OR (out = 1 AND into = 1)").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node is linked with; nodes without links are not in it."""
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = session.scratch(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "component-edges")
    while not _are_stars(edges):
        after = session.scratch(_small(_large(edges)), "component-edges")
        session.drop(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
