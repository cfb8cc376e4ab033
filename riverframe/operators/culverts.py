"""Culverts of every type: inlet and outlet control, normal and critical depth, rating and choice of a size.

All of it is expressions over rows of culverts and flows, so a rating of millions of culverts is one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import river
from ..functions.river import G

# Published coefficients of inlet control (K, M, c, Y), entrance loss, Manning's n and whether the inlet follows the slope, by type.
TYPES = {
    "concrete_square": ("circular", 0.0098, 2.0, 0.0398, 0.67, 0.5, 0.012, False),
    "concrete_groove": ("circular", 0.0018, 2.0, 0.0292, 0.74, 0.2, 0.012, False),
    "concrete_groove_projecting": ("circular", 0.0045, 2.0, 0.0317, 0.69, 0.2, 0.012, False),
    "metal_headwall": ("circular", 0.0078, 2.0, 0.0379, 0.69, 0.5, 0.024, False),
    "metal_mitered": ("circular", 0.0210, 1.33, 0.0463, 0.75, 0.7, 0.024, True),
    "metal_projecting": ("circular", 0.0340, 1.50, 0.0553, 0.54, 0.9, 0.024, False),
    "box_flared_30_75": ("box", 0.026, 1.0, 0.0385, 0.81, 0.4, 0.013, False),
    "box_flared_90_15": ("box", 0.061, 0.75, 0.0400, 0.80, 0.5, 0.013, False),
    "box_parallel": ("box", 0.061, 0.75, 0.0423, 0.82, 0.5, 0.013, False),
}
FIELDS = ("shape", "k", "m", "c", "y", "ke", "n", "mitered")
#: Factor of the discharge intensity in metres, and where the two inlet equations meet.
KU, LOW, HIGH = 1.811, 3.5, 4.0


def coefficient(kind: Column, field: str) -> Column:
    """A field of FIELDS of the culvert's type; an unknown type counts as the first."""
    at = FIELDS.index(field)
    out = None
    for name, row in list(TYPES.items())[1:]:
        out = (F if out is None else out).when(kind == name, F.lit(row[at]))
    return out.otherwise(F.lit(next(iter(TYPES.values()))[at]))


def barrel(box: Column, depth: Column, height: Column, width: Column) -> tuple[Column, Column, Column]:
    """(area, surface width, wetted perimeter) of a barrel filled to a depth; a full one keeps what it has at its top."""
    y = F.greatest(F.lit(0.0), F.least(depth, height))
    r = height / 2
    angle = 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r - y) / r)))
    tiny = lambda x: F.when(x == 0, 1e-6).otherwise(x)
    return (
        F.when(box, width * y).otherwise(r * r / 2 * (angle - F.sin(angle))),
        F.when(box, width).otherwise(tiny(2 * r * F.sin(angle / 2))),
        F.when(box, width + 2 * y).otherwise(tiny(r * angle)),
    )


def critical_depth(box: Column, flow: Column, height: Column, width: Column) -> Column:
    """Depth at which area^3 / surface width is flow^2 / g; 0 without flow, the barrel's height at most."""

    def below(y: Column) -> Column:
        a, t, _ = barrel(F.lit(False), y, height, width)
        return a * a * a / t < flow * flow / G

    round_ = river.bisect(F.lit(1e-4), height, below, 60)
    return F.when(flow <= 0, 0.0).when(box, F.least(height, river.critical_depth_box(flow, width))).otherwise(round_)


def normal_depth(box: Column, flow: Column, height: Column, width: Column, n: Column, slope: Column) -> Column:
    """Depth of uniform flow; 0 without flow or fall, the barrel's height where it cannot carry the flow."""

    def carried(y: Column) -> Column:
        a, _, p = barrel(box, y, height, width)
        return a * F.pow(a / p, F.lit(2 / 3)) * F.sqrt(slope) / n

    inside = river.bisect(F.lit(1e-4), height, lambda y: carried(y) < flow, 60)
    return F.when((flow <= 0) | (slope <= 0), 0.0).when(carried(height) < flow, height).otherwise(inside)


def design(culverts: DataFrame) -> DataFrame:
    """culverts (kind, height, width, length, slope, n, tailwater, flow, barrels) with what each does: box, q (a barrel's flow), dc, dn,
    intensity, stage, inlet, outlet, control, headwater, submerged, v_out.

    Null width is the height, null n that of the type, null tailwater 0, fewer than one barrel one; slope may be 0.
    Headwaters are above the inlet's floor; the larger of inlet and outlet control governs, and inlet where they are
    equal. Water leaves at normal depth under inlet control, full under outlet control."""
    kind = F.col("kind")
    rows = culverts.withColumns({"box": coefficient(kind, "shape") == "box", "n": F.coalesce("n", coefficient(kind, "n")), "tailwater": F.coalesce("tailwater", F.lit(0.0)), "barrels": F.greatest(F.lit(1), F.coalesce(F.floor(F.col("barrels") + 0.5), F.lit(1)))})
    rows = rows.withColumns({"width": F.when(F.col("box"), F.coalesce("width", "height")).otherwise(F.col("height")), "q": F.col("flow") / F.col("barrels")})
    box, q, d, w, s = (F.col(c) for c in ("box", "q", "height", "width", "slope"))
    rows = rows.withColumns({"dc": critical_depth(box, q, d, w), "dn": normal_depth(box, q, d, w, F.col("n"), s), "__full": F.when(box, w * d).otherwise(math.pi * d * d / 4), "__radius": F.when(box, w * d / (2 * (w + d))).otherwise(d / 4)})
    full, dc = F.col("__full"), F.col("dc")
    at_critical, _, _ = barrel(box, F.least(dc, d * 0.999), d, w)
    vc = F.when(dc > 0, q / at_critical).otherwise(0.0)
    fall = F.when(coefficient(kind, "mitered"), 0.7 * s).otherwise(-0.5 * s)
    rows = rows.withColumns({"intensity": KU * q / (full * F.sqrt(d)), "__v": q / full, "__energy": (dc + vc * vc / (2 * G)) / d})
    x = F.col("intensity")
    free = F.col("__energy") + coefficient(kind, "k") * F.pow(x, coefficient(kind, "m")) + fall
    drowned = coefficient(kind, "c") * x * x + coefficient(kind, "y") + fall
    t = (x - LOW) / (HIGH - LOW)
    inlet = F.greatest(F.lit(0.0), F.when(x <= LOW, free).when(x >= HIGH, drowned).otherwise(free * (1 - t) + drowned * t)) * d
    lost = (1 + coefficient(kind, "ke") + 2 * G * F.col("n") * F.col("n") * F.col("length") / F.pow(F.col("__radius"), F.lit(4 / 3))) * F.col("__v") * F.col("__v") / (2 * G)
    outlet = F.greatest("tailwater", (F.least(dc, d) + d) / 2) + lost - s * F.col("length")
    rows = rows.withColumns({"stage": F.when(x <= LOW, "free").when(x >= HIGH, "drowned").otherwise("between"), "inlet": inlet, "outlet": outlet})
    rows = rows.withColumns({"control": F.when(F.col("inlet") >= F.col("outlet"), "inlet").otherwise("outlet"), "headwater": F.greatest(F.lit(0.0), "inlet", "outlet")})
    at_normal, _, _ = barrel(box, F.least(F.col("dn"), d * 0.999), d, w)
    leaves = F.when(F.col("control") == "outlet", F.col("__v")).when(F.col("dn") > 0, q / at_normal).otherwise(0.0)
    return rows.withColumns({"submerged": F.col("headwater") / d > 1.2, "v_out": leaves}).drop("__full", "__radius", "__v", "__energy")


def rating(culverts: DataFrame, keys: Sequence[str], steps: int = 24) -> DataFrame:
    """(keys, i, flow, headwater, control) at even steps up to about what full barrels carry: 2.5 times area times sqrt(g height), for all barrels."""
    box = coefficient(F.col("kind"), "shape") == "box"
    full = F.when(box, F.coalesce("width", "height") * F.col("height")).otherwise(math.pi * F.col("height") * F.col("height") / 4)
    most = F.greatest(F.lit(1), F.coalesce(F.floor(F.col("barrels") + 0.5), F.lit(1))) * 2.5 * full * F.sqrt(G * F.col("height"))
    rows = culverts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("flow", most * F.col("i") / steps)
    return design(rows).select(*keys, "i", "flow", "headwater", "control")


def smallest(culverts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, height, width, headwater) of the first size (size, height, width), in order of `size`, that keeps the headwater within `allowed`.

    culverts have the columns of design() but height and width, and `allowed`; those that no size serves keep a row of
    nulls. The list of sizes is a catalogue: each culvert tries all of them, in one projection."""
    catalogue = sizes.agg(F.array_sort(F.collect_list(F.struct("size", F.col("height").cast("double").alias("height"), F.col("width").cast("double").alias("width")))).alias("__sizes"))
    given = culverts.drop("height", "width")
    tried = design(given.join(F.broadcast(catalogue)).withColumn("__s", F.explode("__sizes")).withColumns({"height": F.col("__s.height"), "width": F.col("__s.width")}).drop("__sizes"))
    w = Window.partitionBy(*keys).orderBy((F.col("headwater") <= F.col("allowed")).desc(), "__s")
    first = tried.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    fits = F.col("headwater") <= F.col("allowed")
    return first.select(*keys, *[F.when(fits, F.col(c)).alias(c) for c in ("height", "width", "headwater")])
