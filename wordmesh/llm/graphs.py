"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmesh.llm.common import Scratch

#: Far beyond what the logarithm of any component's size asks for; passing it means a fault, and raises.
MOST_ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, s: Scratch) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node of its component.

    Large stars and small stars in turn: each step moves edges towards the least neighbour, until none moves. The number
    of steps grows with the logarithm of a component's size; each step's edges are written to the shared folder.
    """
    now = s.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, after = None, _sum(now)
    for _ in range(MOST_ROUNDS):
        if before == after or not after[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, now = now, s.table(small.filter("a <> b").distinct(), "edges")
        s.drop(old)
        before, after = after, _sum(now)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
