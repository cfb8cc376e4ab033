"""Connected components by contraction, as joins and groupings of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): a table (id, component), the smallest id that each vertex reaches.

    In each round every vertex looks at itself and its neighbours for the best one, by the magnitude of its
    degree and then by a hash that differs from round to round, goes on from there once more, and the edges
    are contracted by that map until none is left. The hash makes long chains shrink by a constant factor a
    round in expectation, whatever the order of ids, and degrees make a star vanish in one, so rounds are
    about the logarithm of the vertices. Maps are then followed in turn. Null ends are ignored; a loop keeps
    its vertex out of the result unless another edge has it. Each round's tables are written to the shared
    folder and deleted once the next ones are."""
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = table(edges.filter("a <> b").select(*pair).distinct(), "edges")
    named = None
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.floor(-F.log2(F.count(F.lit(1)))).alias("rank"))
        order = degree.select(F.col("a").alias("b"), F.struct("rank", F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("v")).alias("p"))
        asked = both.union(degree.select("a", F.col("a").alias("b")))
        best = table(asked.join(order, "b").groupBy("a").agg(F.min("p").alias("p")).select(F.col("a").alias("id"), F.col("p.v").alias("to")), "best")
        on = best.select(F.col("id").alias("to"), F.col("to").alias("next"))
        to = table(best.join(on, "to").select("id", F.col("next").alias("to")), "contraction")
        moved = edges.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        contracted = table(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if named is None:
            follow = table(to.select("id", F.col("to").alias("component")), "components")
        else:
            step = to.select(F.col("id").alias("component"), F.col("to").alias("next"))
            follow = table(named.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "components")
            drop(named)
        drop(edges, best, to)
        named, edges, turn = follow, contracted, turn + 1
    if named is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    out = table(named.join(least, "component").select("id", F.col("least").alias("component")), "components")
    drop(named, edges)
    return out
