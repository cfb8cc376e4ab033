"""Survey geometry as joins: polylines, sections, triangulations, blending of rasters, boundaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import cut, meet
from .axes import nearest_segment  # noqa: F401

#: Triangles that locate() tries first.
FIRST = 1024


def resample(lines: DataFrame, keys: Sequence[str], n: int, ring: str = "line") -> DataFrame:
    """n equidistant points along each polyline array<struct<lon,lat>>: (keys, i, s, lon, lat), s in metres.

    Vertices become segments with their chainage; each asked distance joins the one segment it falls on."""
    v = lines.select(*keys, F.posexplode(ring).alias("v", "p")).select(*keys, "v", "p.lon", "p.lat")
    w = Window.partitionBy(*keys).orderBy("v")
    seg = v.withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)}).filter("lon2 is not null")
    seg = seg.withColumn("d", geo.flat_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    seg = seg.withColumn("s1", F.sum("d").over(w)).withColumn("s0", F.col("s1") - F.col("d"))
    total = seg.groupBy(*keys).agg(F.max("s1").alias("total"))
    asked = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("s", F.col("total") * F.col("i") / (n - 1))
    hit = asked.join(seg, list(keys)).filter((F.col("s") >= F.col("s0")) & ((F.col("s") < F.col("s1")) | ((F.col("i") == n - 1) & (F.col("s1") == F.col("total")))) & (F.col("d") > 0))
    t = (F.col("s") - F.col("s0")) / F.col("d")
    w1 = Window.partitionBy(*keys, "i").orderBy("v")
    hit = hit.withColumn("__r", F.row_number().over(w1)).filter("__r = 1")
    return hit.select(*keys, "i", "s", (F.col("lon") + t * (F.col("lon2") - F.col("lon"))).alias("lon"), (F.col("lat") + t * (F.col("lat2") - F.col("lat"))).alias("lat"))


def cross_line(points: DataFrame, width: float, n: int = 81) -> DataFrame:
    """Points across a bearing: from (section_id, lon, lat, bearing) to (section_id, i, s, lon, lat), s from the left."""
    rows = points.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("s", width * F.col("i") / (n - 1))
    off, across = F.col("s") - width / 2, F.radians(F.col("bearing") + 90)
    return rows.select("section_id", "i", "s", (F.col("lon") + off * F.sin(across) / (geo.LON_M * F.cos(F.radians("lat")))).alias("lon"), (F.col("lat") + off * F.cos(across) / geo.LAT_M).alias("lat"))


def rasterize_tin(triangles: DataFrame, keys: Sequence[str], x0: float, y0: float, cell: float) -> DataFrame:
    """Heights of cell centres inside triangles (tri, x1..z3): (keys, row, col, z). The last triangle that covers a cell wins.

    A triangle is copied to the cells of its own bounding box only."""
    lo, hi = (lambda c: F.least(*[F.col(f"{c}{i}") for i in (1, 2, 3)])), (lambda c: F.greatest(*[F.col(f"{c}{i}") for i in (1, 2, 3)]))
    col = lambda v: F.floor((v - x0) / cell).cast("int")
    row = lambda v: F.floor((v - y0) / cell).cast("int")
    t = triangles.withColumn("row", F.explode(F.sequence(row(lo("y")), row(hi("y"))))).withColumn("col", F.explode(F.sequence(col(lo("x")), col(hi("x")))))
    px, py = x0 + (F.col("col") + 0.5) * cell, y0 + (F.col("row") + 0.5) * cell
    x1, y1, x2, y2, x3, y3 = (F.col(f"{c}{i}") for i in (1, 2, 3) for c in "xy")
    d = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    safe = F.when(d != 0, d)
    a = ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / safe
    b = ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / safe
    c = 1 - a - b
    rows = t.filter((a >= -1e-6) & (b >= -1e-6) & (c >= -1e-6))
    z = a * F.col("z1") + b * F.col("z2") + c * F.col("z3")
    return rows.groupBy(*keys, "row", "col").agg(F.max_by(z, F.col("tri")).alias("z"))


def locate(points: DataFrame, triangles: DataFrame, cell: float, tolerance: float = 1e-3) -> DataFrame:
    """First triangle that holds each point, with barycentric weights: (point_id, tri, a, b, c). Both sides meet on grid cells.

    Triangles come in the order of tri, FIRST of them and then sixteen times as many each time, and only points that none
    of those before holds go on to the next: where triangles lie many deep, a point does not meet them all."""
    at = lambda v: F.floor(v / cell).cast("int")
    lo, hi = (lambda c: F.least(*[F.col(f"{c}{i}") for i in (1, 2, 3)])), (lambda c: F.greatest(*[F.col(f"{c}{i}") for i in (1, 2, 3)]))
    t = triangles.withColumn("r", F.explode(F.sequence(at(lo("y")), at(hi("y"))))).withColumn("q", F.explode(F.sequence(at(lo("x")), at(hi("x")))))
    p = points.withColumns({"r": at(F.col("y")), "q": at(F.col("x"))})
    x1, y1, x2, y2, x3, y3 = (F.col(f"{c}{i}") for i in (1, 2, 3) for c in "xy")
    x, y = F.col("x"), F.col("y")
    d = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    a = ((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / F.when(d != 0, d)
    b = ((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / F.when(d != 0, d)
    found, some, left, low = [], FIRST, p, None
    while True:
        high, n = triangles.select("tri").orderBy("tri").limit(some).agg(F.max("tri"), F.count("tri")).first()
        band = t if n < some else t.filter(F.col("tri") <= high)
        rows = left.join(band if low is None else band.filter(F.col("tri") > low), ["r", "q"])
        rows = rows.withColumns({"a": a, "b": b}).withColumn("c", 1 - F.col("a") - F.col("b")).filter(F.least("a", "b", "c") >= -tolerance)
        found.append(cut(rows.groupBy("point_id").agg(F.min(F.struct("tri", "a", "b", "c")).alias("m")).select("point_id", "m.*")))
        if n < some:
            return reduce(DataFrame.unionByName, found)
        left, low, some = cut(meet(left, found[-1].select("point_id"), "point_id", "left_anti")), high, some * 16


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """Edges (a, b, left, right) of triangles (tri, n1, n2, n3); right is null on the boundary."""
    pairs = F.array(*[F.struct(F.least(f"n{i}", f"n{j}").alias("a"), F.greatest(f"n{i}", f"n{j}").alias("b")) for i, j in ((1, 2), (2, 3), (3, 1))])
    e = triangles.select("tri", F.explode(pairs).alias("e")).select("tri", "e.a", "e.b")
    both = e.groupBy("a", "b").agg(F.min("tri").alias("left"), F.max("tri").alias("right"))
    return both.withColumn("right", F.when(F.col("right") != F.col("left"), F.col("right")))


def cells_to_nodes(field: DataFrame, triangles: DataFrame, value: str, area: str = "area") -> DataFrame:
    """Area-weighted mean of cell values at nodes: (node, value)."""
    rows = field.join(triangles.select("tri", area, F.explode(F.array("n1", "n2", "n3")).alias("node")), "tri")
    return rows.groupBy("node").agg((F.sum(F.col(value) * F.col(area)) / F.sum(area)).alias(value))


def laplace_fill(z: np.ndarray, fixed: np.ndarray, rounds: int = 400, omega: float = 1.6, tolerance: float = 1e-4) -> np.ndarray:
    """Fill the cells that are not fixed by red-black over-relaxation of Laplace's equation with free edges."""
    z = np.where(fixed, z, z[fixed].mean() if fixed.any() else 0.0)
    red = np.indices(z.shape).sum(axis=0) % 2 == 0
    for _ in range(rounds):
        worst = 0.0
        for colour in (red, ~red):
            p = np.pad(z, 1, mode="edge")
            mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
            change = np.where(colour & ~fixed, omega * (mean - z), 0.0)
            z = z + change
            worst = max(worst, float(np.abs(change).max()))
        if worst < tolerance:
            break
    return z


def fill_grid(cells: DataFrame, grid: str) -> DataFrame:
    """Cells (grid, row, col, z); where z is null it is filled from the others of its grid tile."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy() - part["row"].min(), part["col"].to_numpy() - part["col"].min()
        z = np.full((r.max() + 1, c.max() + 1), np.nan)
        z[r, c] = part["z"].to_numpy(float)
        part = part.copy()
        part["z"] = laplace_fill(z, ~np.isnan(z))[r, c]
        return part[[grid, "row", "col", "z"]]

    return cells.select(grid, "row", "col", F.col("z").cast("double").alias("z")).groupBy(grid).applyInPandas(run, f"{grid} {kinds[grid]}, row int, col int, z double")


def blend(base: DataFrame, survey: DataFrame, keys: Sequence[str], feather: Column) -> DataFrame:
    """Survey heights over base heights: weight 0 at the survey's edge, 1 from `feather` metres inside (survey has d_edge)."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d_edge") / feather))
    joined = base.join(survey.select(*keys, "row", "col", F.col("z").alias("zs"), "d_edge"), [*keys, "row", "col"], "left")
    return joined.select(*keys, "row", "col", F.coalesce(w * F.col("zs") + (1 - w) * F.col("z"), F.col("z")).alias("z"))


def chaikin(ring: Column, rounds: int = 1) -> Column:
    """Corner cutting of a closed ring array<struct<lon,lat>>."""
    for _ in range(rounds):
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        mix = lambda p, q, k: F.struct(((1 - k) * p["lon"] + k * q["lon"]).alias("lon"), ((1 - k) * p["lat"] + k * q["lat"]).alias("lat"))
        ring = F.flatten(F.zip_with(ring, following, lambda p, q: F.array(mix(p, q, 0.25), mix(p, q, 0.75))))
    return ring


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas and Peucker's rule keeps."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a], points[b] - points[a]
        rel = points[a + 1 : b] - p
        length = float(np.hypot(*d))
        far = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.array(sorted(keep))


def boundary_edges(mask: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Directed outline edges (keys, r1, c1, r2, c2) of masks of cells, the mask on the left: sides without a neighbour."""
    sides = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.array(*map(F.lit, e)).alias("e")) for dr, dc, e in ((-1, 0, (0, 1, 0, 0)), (1, 0, (1, 0, 1, 1)), (0, -1, (0, 0, 1, 0)), (0, 1, (1, 1, 0, 1)))])
    asked = mask.select(*keys, "row", "col", F.explode(sides).alias("s")).withColumns({"nr": F.col("row") + F.col("s.dr"), "nc": F.col("col") + F.col("s.dc")})
    open_ = asked.join(mask.select(*keys, F.col("row").alias("nr"), F.col("col").alias("nc")), [*keys, "nr", "nc"], "left_anti")
    return open_.select(*keys, *[(F.col("row" if i % 2 == 0 else "col") + F.col("s.e")[i]).alias(n) for i, n in enumerate(("r1", "c1", "r2", "c2"))])


def outlines(mask: DataFrame, key: str) -> DataFrame:
    """Longest outline of each mask as a ring of corners: (key, ring array<struct<r,c>>). One mask's outline is one group."""
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r1, c1, r2, c2 in part[["r1", "c1", "r2", "c2"]].itertuples(index=False):
            out.setdefault((r1, c1), []).append((r2, c2))
        rings = []
        while out:
            start = min(out)
            ring, at, came = [start], start, (0, 0)
            while True:
                choices = out[at]
                # At a corner where two cells touch, turn to the side of the mask just left.
                nxt = min(choices, key=lambda q: (q[0] - at[0]) * came[1] - (q[1] - at[1]) * came[0])
                choices.remove(nxt)
                if not choices:
                    del out[at]
                came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
                if at == start:
                    break
                ring.append(at)
            rings.append(ring)
        best = max(rings, key=len)
        straight = lambda a, b, c: (b[0] - a[0], b[1] - a[1]) == (c[0] - b[0], c[1] - b[1])
        best = [b for a, b, c in zip(best[-1:] + best[:-1], best, best[1:] + best[:1]) if not straight(a, b, c)]
        return pd.DataFrame([(part[key].iloc[0], [{"r": int(r), "c": int(c)} for r, c in best])], columns=[key, "ring"])

    return boundary_edges(mask, [key]).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, ring array<struct<r:int,c:int>>")
