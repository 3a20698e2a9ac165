"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its partners.  The minimum is pre-aggregated, and the
    join back leaves a node with very many partners to Spark's skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _digest(pairs: DataFrame):
    return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, held: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Nulls and loops do not count.  A node without an edge has no row.  Every round is written to the
    shared folder, and the one before it dropped; rounds are logarithmic in the size of the largest
    component.  The result is a table of ``held``.
    """
    held = held or Scratch()
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = held.write(ends, "edges")
    before = _digest(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = _least(large)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        last, stars = stars, held.write(small, "stars")
        held.drop(last)
        if (now := _digest(stars)) == before:
            break
        before = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = held.write(roots, "roots")
    held.drop(stars)
    return out
