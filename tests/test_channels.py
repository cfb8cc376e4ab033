"""Main stems, traces, nearest segments, stationing, flood rasters and pools against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riverframe.operators import axes, channels, pointers, reservoirs, terrain


def raster(seed, rows, cols):
    rng = random.Random(seed)
    return {(r, c): 2.0 * r + abs(c - cols // 2) + rng.random() * 3 for r in range(rows) for c in range(cols)}


def frame(spark, z, key=None):
    rows = [(key, r, c, v) if key is not None else (r, c, v) for (r, c), v in z.items()]
    return spark.createDataFrame(rows, ("k string, " if key is not None else "") + "row int, col int, z double")


def plain_flow(z):
    to = {}
    for (r, c), v in z.items():
        near = [(r + a, c + b) for a, b in terrain.N8]
        if all(p in z for p in near):
            slopes = [((v - z[p]) / math.hypot(p[0] - r, p[1] - c), -i, p) for i, p in enumerate(near)]
            best = max(slopes)
            to[r, c] = best[2] if best[0] > 0 else None
        else:
            to[r, c] = None
    acc = dict.fromkeys(z, 0)
    for p in z:
        while p is not None:
            acc[p] += 1
            p = to[p]
    return to, acc


def plain_stem(to, acc, p):
    path = [p]
    while donors := [q for q in to if to[q] == path[-1]]:
        path.append(min(donors, key=lambda q: (-acc[q], q)))
    return path


def test_a_path_of_5000_cells_takes_13_rounds(spark, monkeypatch):
    rounds = []
    real = pointers.cut
    monkeypatch.setattr(pointers, "cut", lambda df: rounds.append(1) or real(df))
    n = 5000
    links = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") + 1 < n, F.col("id") + 1).alias("to"), F.lit(2.0).alias("m"), (F.col("id") % 977).cast("double").alias("top"))
    got = {r.node: r for r in pointers.follow(links, ["node"], ["to"], sums=["m"], maxima=["top"]).collect()}
    assert len(rounds) - 2 <= 13  # the first table and the result are written as well
    assert len(got) == n and all(r.end_node == n - 1 and r.m == 2.0 * (n - 1 - i) and r.top == max(x % 977 for x in range(i, n)) for i, r in got.items() if i % 500 == 0 or i > n - 3)
    rounds.clear()
    way = pointers.along(links, spark.createDataFrame([(0, "a"), (4990, "b")], "node bigint, name string"), ["node"], ["to"], ["m"]).collect()
    assert len(rounds) < 40
    assert sorted((r.name, r.i, r.node, r.m) for r in way) == [("a", i, i, 2.0 * i) for i in range(n)] + [("b", i, 4990 + i, 2.0 * i) for i in range(10)]


def test_pointers_in_a_circle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node int, to int")
    with pytest.raises(ValueError):
        pointers.follow(links, ["node"], ["to"])
    with pytest.raises(ValueError):
        pointers.along(links, links.select("node").filter("node = 1"), ["node"], ["to"])


def test_stems_and_traces_of_two_rasters(spark):
    grids = {"a": raster(1, 17, 13), "b": raster(2, 12, 15)}
    cells = frame(spark, grids["a"], "a").union(frame(spark, grids["b"], "b"))
    directions = terrain.flow_directions(cells, ["k"])
    acc = terrain.accumulate(directions, ["k"])
    ranks = channels.stem_ranks(directions, acc, 10.0, 20.0, ["k"])
    outlets = cells.select("k", "row", "col", (F.col("row") * 100 + F.col("col")).alias("outlet"))
    stems = {(r.k, r.outlet): r for r in channels.main_stems(ranks, outlets, cells, ["k"]).collect()}
    along = {}
    for r in channels.stem_cells(ranks, outlets, ["k"]).collect():
        along.setdefault((r.k, r.outlet), []).append((r.i, (r.row, r.col), r.station))
    points = outlets.filter("row % 3 = 1").withColumnRenamed("outlet", "point_id")
    traced = {}
    for r in channels.trace_channels(directions, acc, points, 3, ["k"]).collect():
        traced.setdefault((r.k, r.point_id), set()).add(((r.row, r.col), (r.to_row, r.to_col), r.acc, r.downstream))
    for k, z in grids.items():
        to, count = plain_flow(z)
        for p in z:
            path, name = plain_stem(to, count, p), (k, p[0] * 100 + p[1])
            length = sum(math.hypot((a[1] - b[1]) * 10, (a[0] - b[0]) * 20) for a, b in zip(path, path[1:]))
            s = stems[name]
            assert s.n_cells == len(path) and s.length_m == pytest.approx(length) and s.z_head == z[path[-1]]
            assert s.slope == pytest.approx((z[path[-1]] - z[p]) / length if length else 0)
            assert [x[1] for x in sorted(along[name])] == path and sorted(along[name])[-1][2] == pytest.approx(length)
            if p[0] % 3 == 1:
                want = set()
                for q in z:
                    way = [q]
                    while to[way[-1]] is not None:
                        way.append(to[way[-1]])
                    if p in way[1:] and count[q] >= 3:
                        want.add((q, to[q], count[q], False))
                q = p
                while to[q] is not None:
                    want.add((q, to[q], count[q], True))
                    q = to[q]
                assert traced.get(name, set()) == want


def plain_nearest(p, segments):
    best = None
    for i, (x1, y1, x2, y2) in segments:
        l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / (l2 or 1.0)))
        d = math.hypot(p[0] - (x1 + t * (x2 - x1)), p[1] - (y1 + t * (y2 - y1)))
        if best is None or (d, i) < best[:2]:
            best = (d, i, t)
    return best


@pytest.mark.parametrize("levels", [None, 0, 1, 3])
def test_nearest_segment_against_all_pairs(spark, levels):
    rng = random.Random(7)
    segments, points = {}, {}
    for k in ("a", "b"):
        walk = [(rng.uniform(0, 100), rng.uniform(0, 100))]
        for _ in range(60):
            walk.append((walk[-1][0] + rng.uniform(-30, 40), walk[-1][1] + rng.uniform(-30, 40)))
        segments[k] = [(i, (*a, *b)) for i, (a, b) in enumerate(zip(walk, walk[1:]))] + [(60, (*walk[3], *walk[3]))]
        # A third of all points stand in one place, some far from everything.
        points[k] = [(i, *((50.0, 50.0) if i % 3 == 0 else (rng.uniform(-50, 900), rng.uniform(-50, 900)))) for i in range(300)] + [(300, 1e5, -1e5)]
    p = spark.createDataFrame([(k, *x) for k, v in points.items() for x in v] + [("c", 1, 0.0, 0.0), ("a", 999, None, 1.0)], "k string, point_id int, x double, y double")
    s = spark.createDataFrame([(k, i, *x) for k, v in segments.items() for i, x in v], "k string, segment int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.k, r.point_id): (r.distance, r.segment, r.t) for r in axes.nearest_segment(p, s, ["k"], levels).collect()}
    want = {(k, i): plain_nearest((x, y), segments[k]) for k, v in points.items() for i, x, y in v}
    assert got.keys() == want.keys()
    assert all(got[q][1] == want[q][1] and got[q][0] == pytest.approx(want[q][0]) for q in want)


def test_tiles_leave_few_segments(spark, monkeypatch):
    """With enough points a cell meets a handful of the segments, not all."""
    left = []
    real = axes.cut
    monkeypatch.setattr(axes, "cut", lambda df: left.append(real(df)) or left[-1])
    monkeypatch.setattr(axes, "drop", lambda *t: None)
    p = spark.range(16384).select(F.col("id").alias("point_id"), (F.col("id") % 128).cast("double").alias("x"), F.floor(F.col("id") / 128).cast("double").alias("y"))
    s = spark.range(256).select(F.col("id").alias("segment"), (F.col("id") / 2).alias("x1"), F.lit(60.0).alias("y1"), (F.col("id") / 2 + 0.5).alias("x2"), F.lit(60.0).alias("y2"))
    assert axes.nearest_segment(p, s).count() == 16384
    last = [t for t in left if "segment" in t.columns and "tx" in t.columns][-1]
    per_tile = {(r.tx, r.ty): r.n for r in last.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Beside the line a tile meets what lies about it; far off the line looks flat, and more of it is about equally far.
    assert len(per_tile) == 256 and max(n for (x, y), n in per_tile.items() if y == 7) < 75 and sum(per_tile.values()) < 256 * 128


def test_section_stations(spark):
    rows = [("a", 1, 0.0, 0.0, 5.0), ("a", 2, 30.0, 1.0, 9.0), ("a", 3, 70.0, -2.0, 7.0), ("b", 1, 3.0, 3.0, 1.0)]
    sections = spark.createDataFrame(rows, "k string, section_id int, x double, y double, bed double")
    axis = spark.createDataFrame([(k, v, 40.0 * v, 0.0) for k in "ab" for v in range(4)], "k string, v int, x double, y double")
    got = {(r.k, r.section_id): r for r in axes.station_sections(sections, ["k"], axis).collect()}
    # The first along the axis lies lower than the last: flow goes the other way.
    assert [got["a", i].i for i in (3, 2, 1)] == [0, 1, 2]
    d1, d2 = math.hypot(40, 3), math.hypot(30, 1)
    assert got["a", 1].station == pytest.approx(d1 + d2) and got["a", 1].mean_slope == pytest.approx(2 / (d1 + d2)) and got["b", 1].mean_slope is None
    by_bed = {(r.k, r.section_id): r.i for r in axes.station_sections(sections, ["k"]).collect()}
    assert [by_bed["a", i] for i in (2, 3, 1)] == [0, 1, 2]
    turned = {(r.k, r.section_id): r.i for r in axes.station_sections(sections, ["k"], reverse=True).collect()}
    assert [turned["a", i] for i in (1, 3, 2)] == [0, 1, 2]


def test_flood_raster(spark):
    sections = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 5.0), ("a", 1.0, 10.0, 0.0, 7.0), ("b", 0.0, 3.0, 3.0, 2.0)], "k string, station double, x double, y double, wse double")
    cells = spark.createDataFrame([("a", 0, 0, 5.0, 2.0, 1.0), ("a", 0, 1, 20.0, 0.0, 9.0), ("b", 0, 0, 90.0, 0.0, 0.5), ("b", 0, 1, 0.0, 0.0, None)], "k string, row int, col int, x double, y double, z double")
    got = {(r.k, r.row, r.col): (r.wse, r.depth) for r in axes.flood_raster(cells, sections, ["k"]).collect()}
    assert got == {("a", 0, 0): (6.0, 5.0), ("a", 0, 1): (7.0, 0.0), ("b", 0, 0): (2.0, 1.5), ("b", 0, 1): (2.0, None)}


def plain_pool(z, dam, level):
    if z[dam] >= level:
        return set()
    seen, todo = {dam}, [dam]
    while todo:
        r, c = todo.pop()
        for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if p in z and p not in seen and z[p] < level:
                seen.add(p)
                todo.append(p)
    return seen


def test_pools_against_flooding(spark):
    rng = random.Random(4)
    # Equal heights, pits behind rims, a part without a way to the dam, and a basin of one cell.
    basins = {"a": {(r, c): float(rng.randint(0, 9)) for r in range(11) for c in range(9)}, "b": {(r, c): rng.random() * 10 for r in range(8) for c in range(8)}, "c": {(3, 3): 1.0}}
    basins["b"].update({(20, 20): 0.0, (20, 21): 0.0})
    dams = {"a": (5, 4), "b": (0, 0), "c": (3, 3)}
    cells = spark.createDataFrame([(k, r, c, v) for k, z in basins.items() for (r, c), v in z.items()] + [("a", 50, 50, None)], "dam string, row int, col int, z double")
    at = spark.createDataFrame([(k, *p, basins[k][p]) for k, p in dams.items()], "dam string, row int, col int, z double")
    levels = reservoirs.flood_levels(cells, at)
    found = {(r.dam, r.row, r.col): r.level for r in levels.collect()}
    assert ("b", 20, 20) not in found and found["c", 3, 3] == 1.0
    curve = {(r.dam, r.height): r for r in reservoirs.height_volume(levels, at, 4.0, step=0.5, highest=12.0).collect()}
    assert len(curve) == 3 * 24
    for k, z in basins.items():
        for i in range(1, 25):
            level = z[dams[k]] + 0.5 * i
            pool = plain_pool(z, dams[k], level)
            assert {p for p in z if found.get((k, *p), math.inf) < level} == pool
            row = curve[k, 0.5 * i]
            assert row.n == len(pool) and row.area == 4.0 * len(pool) and row.volume == pytest.approx(4 * sum(level - z[p] for p in pool))
