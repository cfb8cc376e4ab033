"""Piers and decks against sections, and effective flows of reaches.

Footprints are polygons, sections are lines. Edges of both fall into the grid cells that they run through, and only
what shares a cell is tested for crossing. The stretches of a section inside a footprint follow from its crossings,
and what several footprints block is the union of their stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop
from . import stations
from .axes import segments_of


def through_cells(rows: DataFrame, cell: float) -> DataFrame:
    """rows (x1, y1, x2, y2, ...) once for each grid cell (r, q) that the segment runs through, with a rim for rounding.

    Columns of cells first, then within each the rows between the segment's heights there: a long slanting segment
    falls into as many cells as it crosses, not into all of its box."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rim = 1e-9 * (1 + F.abs(x1) + F.abs(x2) + F.abs(y1) + F.abs(y2))
    at = lambda v: F.floor(v / cell).cast("bigint")
    rows = rows.withColumn("q", F.explode(F.sequence(at(F.least(x1, x2) - rim), at(F.greatest(x1, x2) + rim))))
    height = lambda x: F.when(x1 == x2, None).otherwise(y1 + (x - x1) / F.when(x1 != x2, x2 - x1) * (y2 - y1))
    clip = lambda y: F.least(F.greatest(y1, y2), F.greatest(F.least(y1, y2), y))
    a, b = clip(height(F.col("q") * cell - rim)), clip(height((F.col("q") + 1) * cell + rim))
    low, high = F.when(x1 == x2, F.least(y1, y2)).otherwise(F.least(a, b)), F.when(x1 == x2, F.greatest(y1, y2)).otherwise(F.greatest(a, b))
    return rows.withColumn("r", F.explode(F.sequence(at(low - rim), at(high + rim))))


def side(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Above 0 to the left of the line from (x1, y1) to (x2, y2)."""
    return (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)


def stretches(sections: DataFrame, footprints: DataFrame, cell: float) -> DataFrame:
    """(section_id, structure_id, s_from, s_to): the stretches, in the section's chainage, that lie inside a footprint.

    sections (section_id, v, x, y) by vertices, footprints (structure_id, ring array<struct<lon,lat>>) in the same
    plane. A pair is found by a crossing of edges or by a first vertex inside; each crossing counts once, at half
    open ends, whatever number of cells both share. A section that ends inside is blocked to its end."""
    lines = cut(segments_of(sections, ["section_id"], "v"))
    edges = stations.edges(footprints, "structure_id").withColumn("edge", F.monotonically_increasing_id())
    edges = cut(edges)
    e = through_cells(edges, cell).select("r", "q", "structure_id", "edge", *[F.col(c).alias(f"e{c}") for c in ("x1", "y1", "x2", "y2")])
    met = through_cells(lines, cell).join(e, ["r", "q"])
    x1, y1, x2, y2, ex1, ey1, ex2, ey2 = (F.col(c) for c in ("x1", "y1", "x2", "y2", "ex1", "ey1", "ex2", "ey2"))
    a, b = side(x1, y1, ex1, ey1, ex2, ey2), side(x2, y2, ex1, ey1, ex2, ey2)
    c, d = side(ex1, ey1, x1, y1, x2, y2), side(ex2, ey2, x1, y1, x2, y2)
    crosses = ((a > 0) != (b > 0)) & ((c > 0) != (d > 0))
    hits = met.filter(crosses).select("section_id", "structure_id", "segment", "edge", (F.col("s0") + a / (a - b) * F.col("length")).alias("s")).dropDuplicates(["section_id", "structure_id", "segment", "edge"])
    first = lines.filter("segment = 0").select(F.col("section_id").alias("point_id"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    inside = stations.inside(first, footprints, "point_id", "structure_id", cell).select(F.col("point_id").alias("section_id"), "structure_id", F.lit(0.0).alias("s"))
    ends = hits.select("section_id", "structure_id", "s").unionByName(inside)
    w = Window.partitionBy("section_id", "structure_id").orderBy("s")
    total = lines.groupBy("section_id").agg(F.sum("length").alias("total"))
    paired = ends.withColumns({"k": F.row_number().over(w), "s_to": F.lead("s").over(w)}).filter("k % 2 = 1").join(total, "section_id")
    out = cut(paired.select("section_id", "structure_id", F.col("s").alias("s_from"), F.coalesce("s_to", "total").alias("s_to")))
    drop(lines, edges)
    return out


def blocked(intervals: DataFrame, keys: Sequence[str] = ("section_id",)) -> DataFrame:
    """(keys, blocked, n): the length that intervals (keys, s_from, s_to) cover together, and how many separate pieces that is."""
    w = Window.partitionBy(*keys).orderBy("s_from", "s_to").rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.withColumn("__upto", F.max("s_to").over(w))
    new = F.greatest(F.lit(0.0), F.col("s_to") - F.greatest("s_from", F.coalesce("__upto", F.col("s_from"))))
    apart = F.col("__upto").isNull() | (F.col("s_from") > F.col("__upto"))
    return rows.groupBy(*keys).agg(F.sum(new).alias("blocked"), F.count(F.when(apart, 1)).alias("n"))


def obstructions(sections: DataFrame, structures: DataFrame, cell: float) -> DataFrame:
    """One row per section that any structure meets: (section_id, blocked, n_pieces, widest_id, widest, soffit, crest).

    structures (structure_id, kind, ring, soffit, thickness): piers block, decks ("deck") cover. blocked is the union
    of the piers' stretches; widest the longest that one pier blocks, the first by id of equals. soffit is the lowest
    of the decks' undersides, crest the highest of their tops."""
    found = stretches(sections, structures, cell).join(structures.select("structure_id", "kind", "soffit", "thickness"), "structure_id")
    piers = found.filter("kind <> 'deck'")
    union = blocked(piers)
    one = blocked(piers, ["section_id", "structure_id"]).groupBy("section_id").agg(F.min(F.struct((-F.col("blocked")).alias("b"), "structure_id")).alias("m"))
    decks = found.filter("kind = 'deck'").groupBy("section_id").agg(F.min("soffit").alias("soffit"), F.max(F.col("soffit") + F.coalesce("thickness", F.lit(0.8))).alias("crest"))
    every = found.select("section_id").distinct()
    rows = every.join(union, "section_id", "left").join(one, "section_id", "left").join(decks, "section_id", "left")
    return rows.select("section_id", F.coalesce("blocked", F.lit(0.0)).alias("blocked"), F.coalesce("n", F.lit(0)).alias("n_pieces"), F.col("m.structure_id").alias("widest_id"), (-F.col("m.b")).alias("widest"), "soffit", "crest")


def narrowed(flow: Column, area: Column, width: Column, blocked_width: Column, level: Column, soffit: Column, crest: Column) -> dict[str, Column]:
    """What obstructions make of a section: width left (a fifth of it at least), velocity there, whether the deck is under water, and the bridge's opening."""
    left = F.greatest(0.2 * width, width - blocked_width)
    return {
        "width": left, "velocity": flow / F.greatest(area * left / width, F.lit(1e-3)), "submerged": level > soffit,
        "z_low": soffit, "z_crest": F.when(crest > soffit, crest).otherwise(soffit + 0.8),
    }


def deck_over(pieces: DataFrame, decks: DataFrame, cell: float) -> DataFrame:
    """(piece_id, structure_id): the first deck by id whose footprint holds the centre of each piece (piece_id, x, y); pieces under none are left out."""
    points = pieces.select(F.col("piece_id").alias("point_id"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    met = stations.inside(points, decks, "point_id", "structure_id", cell)
    return met.groupBy(F.col("point_id").alias("piece_id")).agg(F.min("structure_id").alias("structure_id"))


def effective_flows(reaches: DataFrame, joins: DataFrame, default: float | None = None) -> DataFrame:
    """(reach, q, sources, state) of reaches (reach, q) that receive from others by joins (reach, source), several either way.

    A reach that receives carries the flows of all headwaters that lead to it, each once however many ways lead
    there; a headwater its own, or the default. state: "own"; "sum"; "cycle" for reaches that lead back to
    themselves, which carry what headwaters bring; "fed by a cycle" and null flow where no headwater leads there
    at all. Unknown sources are ignored. Cycles are found from the closure, by pairs that reach each other."""
    known = reaches.select(F.col("reach").alias("source"))
    links = joins.join(known, "source", "left_semi").join(reaches.select("reach"), "reach", "left_semi").select("source", "reach").distinct()
    links = cut(links)
    # The nodes that lead to each reach: pointers down the network, several a node.
    tree = links.select(F.col("source").alias("id"), F.col("reach").alias("next_down"))
    closed = cut(stations.upstream(tree, reaches.select(F.col("reach").alias("id"))))
    fed = links.select("reach").distinct()
    heads = reaches.join(fed, "reach", "left_anti").select(F.col("reach").alias("id"), F.coalesce(F.col("q"), F.lit(default).cast("double")).alias("__q"))
    sums = closed.join(heads, "id").groupBy(F.col("root").alias("reach")).agg(F.sum("__q").alias("__sum"), F.count(F.lit(1)).alias("sources"))
    # A reach is on a cycle where one that it leads to leads to it.
    cycle = links.join(closed, (F.col("root") == F.col("source")) & (F.col("id") == F.col("reach"))).select(F.col("source").alias("reach")).distinct().withColumn("__cycle", F.lit(True))
    rows = reaches.select("reach").join(fed.withColumn("__fed", F.lit(True)), "reach", "left").join(sums, "reach", "left").join(cycle, "reach", "left")
    state = F.when(F.col("__cycle"), "cycle").when(F.col("__fed").isNull(), "own").when(F.col("sources").isNull(), "fed by a cycle").otherwise("sum")
    return rows.select("reach", F.col("__sum").alias("q"), F.coalesce("sources", F.lit(0)).alias("sources"), state.alias("state"))
