"""Points against polylines: the nearest segment through a tree of tiles, stationing along an axis, flood rasters.

A tile of half diagonal h whose centre lies D from the nearest segment holds no point that is farther than D + h
from a segment, so whatever is nearest to any point of the tile lies within D + 2h of its centre. Tiles are
divided again and again, and a tile looks only among the segments that its parent has left, of which it keeps
those within that radius. A point then meets the few segments of its smallest tile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop, meet

#: Points that a smallest tile holds on average, segments of a key below which tiles do not pay, and how often a tile is divided each way at a time.
POINTS, SEGMENTS, PARTS = 64, 8, 4
#: How often tiles are divided at most: a tile's number still fits an int.
DEEPEST = 12


def share(x: Column, y: Column) -> Column:
    """Where between 0 and 1 along the segment x1, y1, x2, y2 the point lies nearest; 0 on a segment without length."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    l2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / F.when(l2 > 0, l2).otherwise(1.0)))


def distance(x: Column, y: Column, t: Column) -> Column:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.hypot(x - (x1 + t * (x2 - x1)), y - (y1 + t * (y2 - y1)))


def tile(v: Column, v0: Column, parts: int) -> Column:
    """The number of the tile that holds v, of `parts` along the side of a box that begins at v0."""
    at = F.floor((v - v0) * parts / F.when(F.col("side") > 0, F.col("side")).otherwise(1.0))
    return F.least(F.lit(parts - 1), F.greatest(F.lit(0), at)).cast("int")


def levels_needed(placed: DataFrame, by: Sequence[str], many: int) -> int:
    """How often tiles are divided until a point shares its tile with POINTS places at most, on average over points.

    Counted, as points may fill a strip or a corner of their box only: then most tiles hold none and the others more."""
    level = max(0, math.ceil(math.log(max(1, many / POINTS), PARTS * PARTS)))
    if level in (0, DEEPEST):
        return level
    places = cut(placed.select(*by, *[tile(F.col(c), F.col(f"{c}0"), PARTS**DEEPEST).alias(f"t{c}") for c in "xy"]).distinct())
    while level < DEEPEST:
        held = places.groupBy(*by, *[F.floor(F.col(c) / PARTS ** (DEEPEST - level)) for c in ("tx", "ty")]).agg(F.count(F.lit(1)).cast("double").alias("n"))
        if (held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= POINTS:
            break
        level += 1
    drop(places)
    return level


def nearest_segment(points: DataFrame, segments: DataFrame, keys: Sequence[str] = (), levels: int | None = None) -> DataFrame:
    """Each point (keys, point_id, x, y) on the nearest of its keys' segments (segment, x1, y1, x2, y2): (keys, point_id, segment, t, distance).

    Of equally near segments the first by `segment` is taken. Points without a segment of their keys give no row,
    null positions neither. Tiles are those that hold points, so their number is bounded by these."""
    keys = list(keys)
    keyed = [F.lit(1).alias("__k")] if not keys else []
    points = points.select(*keys, *keyed, "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    segments = segments.select(*keys, *keyed, "segment", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    by = keys or ["__k"]
    box = cut(points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count(F.lit(1)).alias("n")))
    steps = []
    if levels is None:
        many = box.agg(F.max("n")).first()[0] or 0
        most = segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        levels = 0 if most <= SEGMENTS else levels_needed(points.join(box, by), by, many)
    placed = points.join(box, by).drop("n").withColumns({f"t{c}": tile(F.col(c), F.col(f"{c}0"), PARTS**levels) for c in "xy"})
    left = segments
    if levels:
        tiles = cut(placed.groupBy(*by, "tx", "ty", "x0", "y0", "side").agg(F.count(F.lit(1)).alias("n")))
        steps.append(tiles)
        left = segments.withColumns({"tx": F.lit(0), "ty": F.lit(0)})
        for level in range(1, levels + 1):
            coarse, parent = PARTS ** (levels - level), PARTS ** (levels - level + 1)
            size = F.col("side") / (PARTS**level)
            down = lambda c, d: F.floor(F.col(c) / d).cast("int")
            some = tiles.select(*by, down("tx", parent).alias("px"), down("ty", parent).alias("py"), down("tx", coarse).alias("tx"), down("ty", coarse).alias("ty"), "x0", "y0", "side").distinct()
            some = some.select(*by, "px", "py", "tx", "ty", (F.col("x0") + (F.col("tx") + 0.5) * size).alias("x"), (F.col("y0") + (F.col("ty") + 0.5) * size).alias("y"), (size * math.sqrt(0.5)).alias("h"))
            met = meet(some, left.withColumnsRenamed({"tx": "px", "ty": "py"}), [*by, "px", "py"])
            met = met.withColumn("d", distance(F.col("x"), F.col("y"), share(F.col("x"), F.col("y"))))
            met = met.withColumn("least", F.min("d").over(Window.partitionBy(*by, "px", "py", "tx", "ty")))
            # The slack covers rounding of centres and distances, which only lets more through.
            reach = (F.col("least") + 2 * F.col("h")) * (1 + 1e-9) + 1e-9 * (F.abs("x") + F.abs("y"))
            left = cut(met.filter(F.col("d") <= reach).select(*by, "tx", "ty", "segment", "x1", "y1", "x2", "y2"))
            steps.append(left)
    rows = meet(placed, left, [*by, "tx", "ty"]) if levels else placed.join(left, by)
    rows = rows.withColumn("t", share(F.col("x"), F.col("y")))
    best = rows.groupBy(*by, "point_id").agg(F.min(F.struct(distance(F.col("x"), F.col("y"), F.col("t")).alias("distance"), "segment", "t")).alias("b"))
    out = cut(best.select(*keys, "point_id", "b.segment", "b.t", "b.distance"))
    drop(box, *steps)
    return out


def segments_of(lines: DataFrame, keys: Sequence[str], order: str, carry: Sequence[str] = ()) -> DataFrame:
    """(keys, segment, x1, y1, x2, y2, length, s0, carry and carry_2): the segments between vertices (keys, order, x, y, carry) with their chainage.

    A line of one vertex is one segment without length. One line's vertices are ordered together."""
    w = Window.partitionBy(*keys).orderBy(order)
    following = {f"{c}2": F.lead(c).over(w) for c in ("x", "y")} | {f"{c}_2": F.lead(c).over(w) for c in carry}
    v = lines.withColumns({**following, "segment": F.row_number().over(w) - 1, "__last": F.lead(order).over(w).isNull()})
    v = v.filter(~F.col("__last") | (F.col("segment") == 0)).withColumns({c: F.when(F.col("__last"), F.col(b)).otherwise(F.col(c)) for c, b in {"x2": "x", "y2": "y", **{f"{c}_2": c for c in carry}}.items()})
    v = v.select(*keys, "segment", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", *[F.col(c) for c in carry], *[F.col(f"{c}_2") for c in carry])
    v = v.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    along = Window.partitionBy(*keys).orderBy("segment")
    return v.withColumn("s0", F.sum("length").over(along) - F.col("length"))


def reference(points: DataFrame, axes: DataFrame, keys: Sequence[str], order: str = "v") -> DataFrame:
    """Linear referencing: (keys, point_id, s, distance) of points along their keys' axis, whose vertices are (keys, order, x, y)."""
    segments = cut(segments_of(axes, keys, order))
    near = nearest_segment(points, segments, keys)
    return near.join(segments.select(*keys, "segment", "s0", "length"), [*keys, "segment"]).select(*keys, "point_id", (F.col("s0") + F.col("t") * F.col("length")).alias("s"), "distance")


def station_sections(sections: DataFrame, keys: Sequence[str], axes: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """Sections (keys, section_id, x, y, bed) in the order of flow: (keys, section_id, i, station, mean_slope).

    With an axis they stand by their position along it, turned round where the first bed lies below the last;
    without one by falling bed. Stations add up the distances between successive midpoints. mean_slope is the fall
    of beds between the ends over the length, 1e-4 at least; a single section has none. reverse turns all round.
    Equal positions stand by section_id."""
    keys = list(keys)
    if axes is not None:
        at = reference(sections.withColumnRenamed("section_id", "point_id"), axes, keys).select(*keys, F.col("point_id").alias("section_id"), F.col("s").alias("__s"))
        rows = sections.join(at, [*keys, "section_id"])
    else:
        rows = sections.withColumn("__s", -F.col("bed"))
    w = Window.partitionBy(*keys).orderBy("__s", "section_id")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__first": F.first("bed").over(every), "__last": F.last("bed").over(every), "__r": F.row_number().over(w)})
    turned = ((F.col("__first") < F.col("__last")) if axes is not None else F.lit(False)) != F.lit(reverse)
    v = Window.partitionBy(*keys).orderBy(F.when(turned, -F.col("__r")).otherwise(F.col("__r")))
    gap = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(v), F.col("y") - F.lag("y").over(v)), F.lit(0.0))
    rows = rows.withColumns({"i": F.row_number().over(v) - 1, "__gap": gap}).withColumn("station", F.sum("__gap").over(v))
    whole = Window.partitionBy(*keys)
    length = F.max("station").over(whole)
    fall = F.abs(F.col("__first") - F.col("__last")) / F.when(length > 0, length).otherwise(1.0)
    mean = F.when(F.count(F.lit(1)).over(whole) > 1, F.greatest(F.lit(1e-4), fall))
    return rows.withColumn("mean_slope", mean).select(*keys, "section_id", "i", "station", "mean_slope")


def flood_raster(cells: DataFrame, sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row, col, wse, depth) of cells (keys, row, col, x, y, z): the water level of sections (keys, station, x, y, wse) on the nearest
    place of the line through their midpoints, and how far it stands over the ground: 0 where it does not, null where there is no z. One section is one level for all."""
    keys = list(keys)
    segments = cut(segments_of(sections, keys, "station", ["wse"]))
    at = cells.select(*keys, F.struct("row", "col", "z").alias("point_id"), "x", "y")
    near = meet(nearest_segment(at, segments, keys), segments.select(*keys, "segment", "wse", "wse_2"), [*keys, "segment"])
    wse = F.col("wse") + F.col("t") * (F.col("wse_2") - F.col("wse"))
    depth = F.when(F.col("point_id.z").isNotNull(), F.greatest(F.lit(0.0), wse - F.col("point_id.z")))
    return near.select(*keys, "point_id.row", "point_id.col", wse.alias("wse"), depth.alias("depth"))
