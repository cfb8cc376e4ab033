"""Rasters and basins: fill, flow directions, accumulation, watersheds, drainage, storage curves.

Relational operators work on a table of cells (row, col, z) and scale with it: neighbours are an
equi-join, accumulation and watersheds are pointer doubling. Priority-flood filling is sequential within
a tile and runs per tile as a kernel; the tiles of one raster exchange their borders until these stand still.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop, meet

# The eight neighbours in the order in which ties are broken (drow, dcol).
N8 = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))

#: Side of the squares of cells that flow_directions() deals out together.
BLOCK = 64


def fill(z: np.ndarray, eps: float = 1e-3) -> np.ndarray:
    """Priority-flood with a rise of eps per cell, seeded at the border, in single precision."""
    rows, cols = z.shape
    out = z.astype(np.float32).copy()
    done = np.zeros(z.shape, bool)
    heap: list[tuple[float, int, int, int]] = []
    for r in range(rows):
        for c in range(cols):
            if r in (0, rows - 1) or c in (0, cols - 1):
                done[r, c] = True
                heapq.heappush(heap, (float(out[r, c]), len(heap), r, c))
    count = len(heap)
    while heap:
        level, _, r, c = heapq.heappop(heap)
        for dr, dc in N8:
            a, b = r + dr, c + dc
            if 0 <= a < rows and 0 <= b < cols and not done[a, b]:
                done[a, b] = True
                out[a, b] = max(out[a, b], np.float32(level + eps))
                count += 1
                heapq.heappush(heap, (float(out[a, b]), count, a, b))
    return out


def fill_sinks(cells: DataFrame, grid: str, eps: float = 1e-3) -> DataFrame:
    """(grid, row, col, z) with z filled; a grid is a raster of its own that fits one task. fill_raster() fills one of many tiles."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        z = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.float32(np.inf))
        z[r - r.min(), c - c.min()] = part["z"]
        part = part.copy()
        part["z"] = fill(z, eps)[r - r.min(), c - c.min()].astype(float)
        return part[[grid, "row", "col", "z"]]

    return cells.select(grid, "row", "col", F.col("z").cast("double").alias("z")).groupBy(grid).applyInPandas(run, f"{grid} {kinds[grid]}, row int, col int, z double")


def flood(z: np.ndarray, level: np.ndarray, eps: float = 1e-3) -> np.ndarray:
    """Priority-flood from all cells of finite level; cells that nothing reaches stay infinite, cells of infinite z keep their level."""
    rows, cols = z.shape
    out = level.astype(np.float32)
    heap = [(float(out[r, c]), int(r), int(c)) for r, c in zip(*np.nonzero(np.isfinite(out)))]
    heapq.heapify(heap)
    while heap:
        at, r, c = heapq.heappop(heap)
        if at > out[r, c]:
            continue
        rise = np.float32(at + eps)
        for dr, dc in N8:
            a, b = r + dr, c + dc
            if 0 <= a < rows and 0 <= b < cols and (up := max(z[a, b], rise)) < out[a, b]:
                out[a, b] = up
                heapq.heappush(heap, (float(up), a, b))
    return out


def fill_raster(cells: DataFrame, tile: int = 256, eps: float = 1e-3) -> DataFrame:
    """(row, col, z) with z filled over one raster of any size, with the levels that fill() gives on all of it.

    Tiles of tile x tile cells are flooded apart, each from the outlets in it and from the levels that the cells
    around it have so far; only border cells travel, and only tiles that hear of a lower level run again. Levels
    only fall, and once none does they are those of a single flood."""
    kernel = "row int, col int, z double"
    place = lambda r, c: (F.floor(r / tile).cast("int").alias("tr"), F.floor(c / tile).cast("int").alias("tc"))
    base = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))
    r0, r1, c0, c1 = base.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if r0 is None:
        return base
    outlet = F.col("row").isin(r0, r1) | F.col("col").isin(c0, c1)
    tiles = cut(base.select(*place(F.col("row"), F.col("col")), "row", "col", "z", outlet.alias("outlet"), F.lit(False).alias("around")))
    present = tiles.select("tr", "tc").distinct()

    def flooded(part: pd.DataFrame) -> pd.DataFrame:
        r = part["row"].to_numpy() - part["tr"].iloc[0] * tile + 1
        c = part["col"].to_numpy() - part["tc"].iloc[0] * tile + 1
        own, start = ~part["around"].to_numpy(bool), part["outlet"].to_numpy(bool)
        z, level = np.full((2, tile + 2, tile + 2), np.float32(np.inf))
        z[r[own], c[own]] = part["z"].to_numpy()[own]
        level[r[~own], c[~own]] = part["z"].to_numpy()[~own]
        level[r[start], c[start]] = z[r[start], c[start]]
        return part[["row", "col"]].assign(z=flood(z, level, eps)[r, c].astype(float))[own]

    def border(part: pd.DataFrame) -> pd.DataFrame:
        out = flooded(part)
        r, c = out["row"] % tile, out["col"] % tile
        return out[((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)) & np.isfinite(out["z"])]

    near = F.array_distinct(F.array(*[F.struct(*place(F.col("row") + a, F.col("col") + b)) for a, b in N8]))
    key = ["tr", "tc", "row", "col"]

    def heard(around: DataFrame) -> DataFrame:
        return around.select(*key, "z", F.lit(False).alias("outlet"), F.lit(True).alias("around"))

    run, around = tiles, None
    while True:
        found = run.groupBy("tr", "tc").applyInPandas(border, kernel)
        sent = found.select("row", "col", "z", F.explode(near).alias("t")).select("t.tr", "t.tc", "row", "col", "z")
        away = sent.filter((F.col("tr") != F.floor(F.col("row") / tile)) | (F.col("tc") != F.floor(F.col("col") / tile)))
        news = away.join(present, ["tr", "tc"], "left_semi").groupBy(*key).agg(F.min("z").alias("z"))
        if around is not None:
            news = news.join(around.withColumnRenamed("z", "old"), key, "left").filter("old is null or z < old").drop("old")
        news = cut(news)
        if news.isEmpty():
            break
        around = news if around is None else cut(around.unionByName(news).groupBy(*key).agg(F.min("z").alias("z")))
        again = news.select("tr", "tc").distinct()
        run = tiles.unionByName(heard(around)).join(again, ["tr", "tc"], "left_semi")
    whole = tiles if around is None else tiles.unionByName(heard(around))
    return whole.groupBy("tr", "tc").applyInPandas(flooded, kernel)


def flow_directions(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, col, to_row, to_col): steepest of the eight descents; null at the border and in pits. Ties take the first in N8's order.

    Every cell tells its height to the nine cells around it, itself included. Cells that lie near are dealt out together, so that a
    task adds up most of what is told before it goes to others: about one row a cell is shuffled."""
    cell = [*keys, "row", "col"]
    told = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for i, (a, b) in enumerate((*N8, (0, 0)))])
    base = cells.select(*cell, F.col("z").cast("double").alias("z")).repartition(*keys, F.floor(F.col("row") / BLOCK), F.floor(F.col("col") / BLOCK))
    sent = base.withColumn("n", F.explode(told)).select(*keys, (F.col("row") - F.col("n.dr")).alias("row"), (F.col("col") - F.col("n.dc")).alias("col"), F.col("n.o").alias("o"), "z")
    met = sent.groupBy(*cell).agg(*[F.max(F.when(F.col("o") == i, F.col("z"))).alias(f"__z{i}") for i in range(9)], F.max(F.col("o") == 8).alias("__own")).filter("__own")
    slope = [(F.col("__z8") - F.col(f"__z{i}")) / F.lit(float(np.hypot(a, b))) for i, (a, b) in enumerate(N8)]
    met = met.withColumns({f"__s{i}": F.when(s > 0, s) for i, s in enumerate(slope)})
    best = F.when(reduce(lambda a, b: a & b, [F.col(f"__z{i}").isNotNull() for i in range(8)]), F.greatest(*[F.col(f"__s{i}") for i in range(8)]))
    met = met.withColumn("__best", best)
    to = lambda c, k: F.coalesce(*[F.when(F.col(f"__s{i}") == F.col("__best"), F.col(c) + o[k]) for i, o in enumerate(N8)])
    return met.select(*cell, to("row", 0).alias("to_row"), to("col", 1).alias("to_col"))


def accumulate(directions: DataFrame, keys: Sequence[str] = (), rounds: int = 40) -> DataFrame:
    """Upstream cell count, itself included, by pointer doubling: after k rounds a cell holds the sum of its paths of up to 2^k - 1 steps.

    log2(longest path) rounds, each one join and one pre-aggregated grouping over all grids at once."""
    cell = [*keys, "row", "col"]
    acc = directions.select(*cell, F.lit(1).cast("bigint").alias("acc"))
    jump = directions.filter("to_row is not null").select(*cell, "to_row", "to_col")
    old: list[DataFrame] = []
    for i in range(rounds):
        if jump.isEmpty():
            break
        sent = meet(jump, acc, cell).groupBy(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("acc").alias("more"))
        acc = meet(acc, sent, cell, "left").select(*cell, (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"))
        far = jump.select(*keys, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("r2"), F.col("to_col").alias("c2"))
        jump = meet(jump, far, [*keys, "to_row", "to_col"]).select(*cell, F.col("r2").alias("to_row"), F.col("c2").alias("to_col"))
        acc, jump = cut(acc), cut(jump)
        drop(*old)
        old = [acc, jump]
    return acc


def watershed(directions: DataFrame, outlets: DataFrame, keys: Sequence[str] = (), rounds: int = 40) -> DataFrame:
    """(keys, row, col, outlet): every cell that drains through an outlet (keys, row, col, outlet), each to the first one on its way.

    Pointers stop at outlets and are doubled until none moves."""
    cell = [*keys, "row", "col"]
    marked = meet(directions, outlets.select(*cell, "outlet"), cell, "left")
    at = marked.select(*cell, F.when(F.col("outlet").isNull(), F.col("to_row")).alias("to_row"), F.when(F.col("outlet").isNull(), F.col("to_col")).alias("to_col"), "outlet")
    old = None
    for _ in range(rounds):
        step = at.select(*keys, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("r2"), F.col("to_col").alias("c2"), F.col("outlet").alias("o2"))
        at = cut(meet(at, step, [*keys, "to_row", "to_col"], "left").select(*cell, F.col("r2").alias("to_row"), F.col("c2").alias("to_col"), F.coalesce("outlet", "o2").alias("outlet")))
        if old is not None:
            drop(old)
        old = at
        if at.filter("to_row is not null").isEmpty():
            break
    return at.filter("outlet is not null").select(*cell, "outlet")


def snap_outlet(acc: DataFrame, points: DataFrame, radius: int, least_cells: int) -> DataFrame:
    """Each point (point_id, row, col) moves to the nearest cell of enough accumulation in its window, else to the largest; first of equals."""
    spread = F.sequence(F.lit(-radius), F.lit(radius))
    w = points.select("point_id", "row", "col").withColumn("dr", F.explode(spread)).withColumn("dc", F.explode(spread))
    w = w.select("point_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"))
    met = meet(w, acc, ["row", "col"])
    enough = (F.col("acc") >= least_cells).cast("int")
    order = F.struct((-enough).alias("e"), F.when(enough == 1, F.col("d2")).otherwise(-F.col("acc")).alias("k"), "row", "col")
    return met.groupBy("point_id").agg(F.min(order).alias("b")).select("point_id", "b.row", "b.col")


def drainage(acc: DataFrame, directions: DataFrame, least_cells: int) -> DataFrame:
    """Segments of the drainage network: cells of enough accumulation whose receiver has enough as well."""
    big = acc.filter(F.col("acc") >= least_cells).select("row", "col", "acc")
    to = big.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    return meet(meet(big, directions, ["row", "col"]), to, ["to_row", "to_col"], "left_semi").select("row", "col", "to_row", "to_col", "acc")


def morphometry(cells: DataFrame, cell_x_m: float, cell_y_m: float, keys: Sequence[str] = ("outlet",)) -> DataFrame:
    """Area km2, relief, mean position, perimeter (cell edges that border other cells) and compactness of each basin (keys, row, col, z)."""
    sides = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(m)).alias("m")) for a, b, m in ((-1, 0, cell_x_m), (1, 0, cell_x_m), (0, -1, cell_y_m), (0, 1, cell_y_m))])
    near = cells.select(*keys, "row", "col", F.explode(sides).alias("s")).select(*keys, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("s.m").alias("m"))
    edge = near.join(cells.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti").groupBy(*keys).agg((F.sum("m") / 1000).alias("perimeter_km"))
    base = cells.groupBy(*keys).agg((F.count(F.lit(1)) * (cell_x_m * cell_y_m / 1e6)).alias("area_km2"), (F.max("z") - F.min("z")).alias("relief_m"), F.avg("row").alias("row"), F.avg("col").alias("col"))
    return base.join(edge, list(keys)).withColumn("compactness", 0.28 * F.col("perimeter_km") / F.sqrt("area_km2"))


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """z at fractional (x = column, y = row) by an equi-join with four neighbours; points outside the raster give no row."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = points.withColumns({"__r": F.floor("y").cast("int"), "__c": F.floor("x").cast("int")}).withColumn("k", F.explode(corners))
    weight = F.when(F.col("k.a") == 1, F.col("y") - F.col("__r")).otherwise(1 - (F.col("y") - F.col("__r"))) * F.when(F.col("k.b") == 1, F.col("x") - F.col("__c")).otherwise(1 - (F.col("x") - F.col("__c")))
    p = p.select("point_id", (F.col("__r") + F.col("k.a")).alias("row"), (F.col("__c") + F.col("k.b")).alias("col"), weight.alias("w"))
    return p.join(cells, ["row", "col"]).groupBy("point_id").agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.count(F.lit(1)).alias("k")).filter("k = 4").drop("k")


def storage_curve(cells: DataFrame, keys: Sequence[str], cell_m2: float, levels: int = 24) -> DataFrame:
    """Area and volume below `levels` equally spaced levels per reservoir.

    Cells are counted into the level above them first, then summed up along levels: no cell meets every level."""
    span = cells.groupBy(*keys).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (levels - 1)
    binned = cells.join(span, list(keys)).withColumn("k", F.when(step > 0, F.ceil((F.col("z") - F.col("lo")) / F.when(step > 0, step))).otherwise(0).cast("int"))
    inexact = (F.col("lo") + F.col("k") * step) <= F.col("z")
    counted = binned.withColumn("k", F.when(inexact, F.col("k") + 1).otherwise(F.col("k"))).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"))
    grid = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(counted.withColumnRenamed("k", "i"), [*keys, "i"], "left").fillna({"n": 0, "s": 0.0}).withColumns({"n": F.sum("n").over(w), "s": F.sum("s").over(w)})
    level = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (levels - 1)
    return rows.select(*keys, F.col("i").alias("level_no"), level.alias("level"), (F.col("n") * cell_m2).alias("area"), ((level * F.col("n") - F.col("s")) * cell_m2).alias("volume"))


def hypsometric_split(bands: DataFrame, line, keys: Sequence[str]) -> DataFrame:
    """Area below a line (pluvial) and above it, bands (lo, hi, area) cut linearly."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (line - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return bands.groupBy(*keys).agg(F.sum(F.col("area") * share).alias("below"), F.sum(F.col("area") * (1 - share)).alias("above"))
