"""Connected components by repeated contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.operators.checkpoints import cut_anew

#: Rounds whose moves are followed in one plan.
ROUNDS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); nodes of one component share their root.

    In each round every node points to its neighbour with the smallest hash of that round, if it
    is smaller than its own, and edges are rewritten to the targets. As the order is drawn anew
    each round, long chains shrink by a constant factor in expectation. Each round is cut, and
    the loop ends when no edge is left.
    """
    edges = cut_anew(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    moves: list[DataFrame] = []
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = cut_anew(best.select(F.col("a").alias("node"), F.when(F.col("m") < rank("a"), F.col("m")["v"]).otherwise(F.col("a")).alias("root")))
        moves.append(to)
        left = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").filter(F.col("ra") != F.col("rb"))
        edges = cut_anew(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        turn += 1
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves.pop()
    while moves:  # from the last and fewest nodes to the first and all
        step = out.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = moves.pop().join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        out = out if len(moves) % ROUNDS else cut_anew(out)
    return out
