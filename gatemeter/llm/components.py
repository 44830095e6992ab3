"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatemeter.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) of every vertex of edges (a, b); the label is the component's least vertex.

    Each round gives every vertex its least neighbour as parent, moves labels and edges to
    parents, and drops edges within one vertex; the edge table shrinks by half or more.
    Minima are combined before they are shuffled, so a vertex with many edges is no burden;
    joins meet written tables on both sides, so that skewed keys can be split. Rounds of few
    edges write few files.
    """
    left = scratch.cut(edges.where("a <> b").select("a", "b").distinct())
    n = left.count()
    labels = scratch.cut(left.select(F.col("a").alias("v")).union(left.select("b")).distinct().select("v", F.col("v").alias("label")), 2 * n)
    vertices = labels.count()
    while n:
        near = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("p"))
        parents = scratch.cut(near.select(F.col("a").alias("v"), F.least("a", "p").alias("p")), 2 * n)
        up = parents.select(F.col("v").alias("q"), F.col("p").alias("pp"))
        moved = scratch.cut(labels.join(up, F.col("label") == F.col("q"), "left").select("v", F.coalesce("pp", "label").alias("label")), vertices)
        one = left.join(up, F.col("a") == F.col("q")).select(F.col("pp").alias("a"), "b")
        both = one.join(up, F.col("b") == F.col("q")).select("a", F.col("pp").alias("b"))
        climbs = parents.join(up, F.col("p") == F.col("q")).select(F.col("p").alias("a"), F.col("pp").alias("b"))
        rest = scratch.cut(both.union(climbs).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 3 * n)
        scratch.drop(left, labels, parents)
        left, labels, n = rest, moved, rest.count()
    scratch.drop(left)
    return labels
