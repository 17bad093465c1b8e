"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.session import materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them.

    ``both_ways``: of all neighbours those above the node (large star), else those below it and the
    node itself (small star). The least neighbour is an aggregate that is joined back, so a node
    with many neighbours is not gathered anywhere. Edges may come out more than once.
    """
    if both_ways:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = around.join(least, "a")
    if both_ways:
        hung = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), "m")
    else:
        hung = hung.select(F.explode(F.array("a", "b")).alias("a"), "m")
    return hung.filter(F.col("a") > F.col("m")).select("a", F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether every upper end ``a`` has one lower end, which is no upper end itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    ).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up + down > 1 and up > 0").count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """``a, b`` for every node of ``edges`` that is not the least of its component, which is ``b``.

    Alternates large and small stars until each component is one star, in about the logarithm of
    the longest path. Each round is a table in the shared folder.
    """
    edges = materialize(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "component-edges",
    )
    while not _settled(edges):
        large = _stars(edges, True)
        edges = materialize(_stars(large, False).distinct(), "component-edges")
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); a root is its component's least node."""
    hung = stars(edges)
    roots = hung.select("b").distinct()
    return hung.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
