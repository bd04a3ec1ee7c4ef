"""Connected components of an edge list, by alternating large and small stars.

Each round sends every neighbour of a node to the least label seen there. Least labels are aggregates, so a node with
very many edges is combined on the map side; only its edges, never its group, meet in one place, and the joins may be
split when they are skewed. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): around every node, its larger (or other) neighbours are tied to the least of its neighbourhood."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = around.join(least, "a")
    if large:
        return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.filter("m < a").select("a", F.col("m").alias("b"))
    return tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)


def _settled(edges: DataFrame) -> bool:
    """Whether every node with an edge to a lesser one has one alone, to a node that has none: then that is the least of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down + up > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that can be reached. Loops and repeated edges count once.

    An empty edge list gives an empty result. Null ends are not allowed.
    """
    edges = cut(edges.filter("a <> b").distinct())
    for _ in range(rounds):
        edges = _star(edges, large=True).distinct()
        edges = cut(_star(edges, large=False).distinct())
        if _settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
