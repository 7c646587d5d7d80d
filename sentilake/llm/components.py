"""Connected components of a graph of links, by alternating large and small stars.

Both steps are a grouped minimum and a join that leaves the rows of nodes with very many
neighbours where they are; neither gathers a node's neighbours.
Each round is staged in the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, stage, unstage


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))


def _stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it is one itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    of = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return of.where((F.col("child") > 1) | (F.col("child") + F.col("root") > 1)).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each linked node with its component's smallest node: node, root.

    Links with a null end or to the node itself say nothing; doubled ones do no harm.
    Nodes without links aren't returned.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = links.count()
    while True:
        ends = 2 * size
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the larger neighbours of each node meet the least of its neighbours and itself
        least = _least(both).select("a", F.least("a", "least").alias("least"), "n")
        large = attach(both, least, "a", ends).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: each node and its smaller neighbours meet the least of these
        joined = attach(large, _least(large), "a", ends)
        small = joined.select("a", F.col("least").alias("b")).unionByName(joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        earlier, links = links, stage(small.distinct())
        unstage(earlier)
        size = links.count()
        if _stars(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
