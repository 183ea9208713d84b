"""Connected components by star contraction, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace


def _large(edges: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Links the larger neighbours of each node with its smallest one, itself included."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    # written, so that Spark can split the edges of a node that has very many
    least = workspace.stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    scratch.append(least)
    moved = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours with the smallest of these. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a centre or has one link to a centre. edges: a < b, without repeated ones."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1 AND up > 0").isEmpty()


def components(edges: DataFrame, least: str = "component") -> DataFrame:
    """(node, component) for each end of edges (a, b): the smallest node that it is linked with, itself included.

    Large-star and small-star steps alternate until every component is a star, in a number of rounds that grows with
    the logarithm of its size. Each round's edges are written to the shared folder and number no more than those
    before. Minima are added up before the shuffle and written before they are joined with the edges, so Spark can split
    those of a node with very many links; loops and repeated edges don't matter, nulls are left out.
    """
    now = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = workspace.stage(now, "edges")
    while not _stars(now):
        scratch = [now]
        large = workspace.stage(_large(now, scratch), "edges")
        now = workspace.stage(_small(large), "edges")
        for done in [*scratch, large]:
            workspace.drop(done)
    found = now.select(F.col("b").alias("node"), F.col("a").alias(least))
    return found.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias(least)).distinct())
