"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpoint, counted

#: Rounds in which nodes go by their own order, which leads to the least node; later rounds each have a random one.
BY_NODE = 4


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _nearest(edges: DataFrame, turn: int) -> DataFrame:
    """``a, m``: the first node around each, itself included, in the order of the round.

    It is stored, so that a join with it reads two plain tables: the edges of a
    hub are then split over tasks as any skewed join's are.
    """
    ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    place = (lambda c: F.struct(F.lit(0).alias("at"), F.col(c).alias("node"))) if turn < BY_NODE else (lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("at"), F.col(c).alias("node")))
    return checkpoint(ends.groupBy("a").agg(F.min(place("b")).alias("m")).select("a", F.least(place("a"), "m")["node"].alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for edges ``a, b`` of any ordered type: the component is its least node.

    Contracts the graph round by round: each node is replaced by the first node
    around it, edges within one node go, and the rounds end with the last edge.
    In a random order a round leaves three quarters of the nodes or fewer, as
    expected, so that rounds grow with the logarithm of the nodes whatever the
    graph.  A round shuffles the edges that are left, with map-side combining,
    and no row ever holds a neighbourhood.
    """
    edges, left = counted(_downward(edges))
    levels: list[DataFrame] = []
    while left or not levels:
        levels.append(_nearest(edges, len(levels)))
        ends = edges.join(levels[-1], "a").select(F.col("m").alias("x"), F.col("b").alias("a")).join(levels[-1], "a")
        edges, left = counted(_downward(ends.select(F.col("x").alias("a"), F.col("m").alias("b")))) if left else (edges, 0)
    found = levels[0]
    for k, level in enumerate(levels[1:], 2):
        found = found.join(level.select(F.col("a").alias("m"), F.col("m").alias("next")), "m", "left").select("a", F.coalesce("next", "m").alias("m"))
        found = checkpoint(found) if k % 4 == 0 or k == len(levels) else found  # few joins a plan
    if len(levels) > BY_NODE:
        found = found.join(checkpoint(found.groupBy("m").agg(F.min("a").alias("least"))), "m").select("a", F.col("least").alias("m"))
    return found.select(F.col("a").alias("node"), F.col("m").alias("component"))
