"""From survey geometry to a grid: the frame, contours and points burnt in, the rest filled.

A grid's frame comes from the robust box of the survey and a budget of nodes, before any row of it is made. Lines
are sampled closely enough to miss no node that they cross, every sample falls on its nearest node, and the last
one written wins, which is an ordered aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry, order


def frame(points: DataFrame, keys: Sequence[str], step: float | None = None, most_nodes: int = 500_000, share: float = 0.004) -> DataFrame:
    """(keys, x0, y0, dx, dy, nx, ny) of each survey's grid, from all its points (keys, x, y).

    The wanted distance of nodes is `step`, or a 400th of the longer side but 0.5 at least; it grows by 1.3 until the
    grid has most_nodes at most. Nodes then stand evenly from edge to edge, two at least each way."""
    box = order.robust_box(points, keys, share)
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    wanted = F.lit(float(step)) if step else F.greatest(F.lit(0.5), F.greatest(w, h) / 400)
    # The first of the steps s, 1.3 s, 1.3^2 s ... with (w / s + 1)(h / s + 1) within the budget.
    grown = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.col("__s") * F.pow(F.lit(1.3), i.cast("double")))
    fits = F.filter(grown, lambda s: (w / s + 1) * (h / s + 1) <= most_nodes)
    rows = box.withColumn("__s", wanted).withColumn("__s", F.try_element_at(fits, F.lit(1)))
    n = lambda side: F.greatest(F.lit(2), F.floor(side / F.col("__s") + 0.5) + 1).cast("int")
    rows = rows.withColumns({"nx": n(w), "ny": n(h)})
    d = lambda side, k: F.when(side > 0, side / (F.col(k) - 1)).otherwise(1.0)
    return rows.select(*keys, F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), d(w, "nx").alias("dx"), d(h, "ny").alias("dy"), "nx", "ny")


def _node(v: Column, v0: str, d: str) -> Column:
    return F.floor((v - F.col(v0)) / F.col(d) + 0.5).cast("int")


def burn(lines: DataFrame, points: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row, col, z) of the nodes that lines (keys, line, v, x, y, z) cross or points (keys, point, x, y, z) stand nearest to.

    A piece between two vertices has a sample at least every node's distance, both ends included. The last sample in
    the order of line, vertex and place wins a node; points only get nodes that no line has, the first of them wins.
    What falls outside the frame, and pieces with a null coordinate, burn nothing. lines may repeat no (line, v)."""
    keys = list(keys)
    followed = order.following(lines, [*keys, "line"], "v", ["x", "y", "z"])
    s = followed.join(frames, keys)
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x_2") - F.col("x"), F.col("y_2") - F.col("y")) / F.least("dx", "dy"))).cast("int")
    s = s.withColumn("__n", n).filter("__n is not null").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    t = F.col("__i") / F.col("__n")
    at = lambda c: F.col(c) + t * (F.col(f"{c}_2") - F.col(c))
    s = s.withColumns({"row": _node(at("y"), "y0", "dy"), "col": _node(at("x"), "x0", "dx"), "__z": at("z")})
    inside = F.col("row").between(0, F.col("ny") - 1) & F.col("col").between(0, F.col("nx") - 1)
    hard = s.filter(inside & F.col("__z").isNotNull()).groupBy(*keys, "row", "col").agg(F.max_by("__z", F.struct("line", "v", "__i")).alias("z"))
    p = points.join(frames, keys).withColumns({"row": _node(F.col("y"), "y0", "dy"), "col": _node(F.col("x"), "x0", "dx")})
    soft = p.filter(inside & F.col("z").isNotNull()).groupBy(*keys, "row", "col").agg(F.min_by(F.col("z"), F.col("point")).alias("z"))
    both = hard.withColumn("__p", F.lit(0)).unionByName(soft.withColumn("__p", F.lit(1)))
    return both.groupBy(*keys, "row", "col").agg(F.min_by("z", "__p").alias("z"))


def survey_grid(lines: DataFrame, points: DataFrame, key: str, step: float | None = None, most_nodes: int = 500_000) -> DataFrame:
    """(key, row, col, z): contours and points as a whole grid, free nodes filled between them; most_nodes bounds what one task fills."""
    every = lines.select(key, "x", "y").unionByName(points.select(key, "x", "y"))
    frames = frame(every, [key], step, most_nodes)
    burnt = burn(lines, points, frames, [key])
    nodes = frames.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).select(key, "row", "col")
    return geometry.fill_grid(nodes.join(burnt, [key, "row", "col"], "left"), key)
