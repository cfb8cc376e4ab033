"""Steps that must not grow faster than their tables: what is joined, sent through the driver or laid out, and the results of it."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from riverframe.functions import river
from riverframe.operators import axes, channels, geometry, hydraulics, terrain


def ground(spark, rows=40, cols=30, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(r, c, 1.0 * r + abs(c - 14) + rng.random() * 2.0) for r in range(rows) for c in range(cols)], "row int, col int, z double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_directions_need_no_join(spark):
    cells = ground(spark)
    assert "Join" not in plan(terrain.flow_directions(cells))
    z = {(r.row, r.col): r.z for r in cells.collect()}
    for r in terrain.flow_directions(cells).collect():
        near = [((z[r.row, r.col] - z[p]) / (a * a + b * b) ** 0.5, -i, p) for i, (a, b) in enumerate(terrain.N8) if (p := (r.row + a, r.col + b)) in z]
        best = max(near)
        assert (r.to_row, r.to_col) == (best[2] if len(near) == 8 and best[0] > 0 else (None, None))


def test_growing_tables_are_not_broadcast(spark):
    cells = ground(spark)
    directions = terrain.flow_directions(cells)
    acc = terrain.accumulate(directions)
    points = spark.createDataFrame([(1, 20, 14), (2, 10, 10)], "point_id int, row int, col int")
    ranks = channels.stem_ranks(directions, acc, 1.0, 1.0)
    stems = points.withColumnRenamed("point_id", "outlet")
    for df in (terrain.drainage(acc, directions, 3), terrain.snap_outlet(acc, points, 2, 5), channels.main_stems(ranks, stems, cells), channels.stem_cells(ranks, stems)):
        assert "Broadcast" not in plan(df)


def test_totals_without_laying_out_basins(spark):
    cells = ground(spark)
    directions = terrain.flow_directions(cells)
    rng = random.Random(5)
    places = [(r, 14) for r in range(1, 39, 3)] + [(rng.randrange(40), rng.randrange(30)) for _ in range(30)] + [(4, 14), (4, 14), (200, 3)]
    points = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(places)], "point_id int, row int, col int")
    totals = channels.basin_totals(directions, points, cells.withColumns({"r": F.col("row"), "c": F.col("col")}), ["r", "c"], ["z"], ["z"], sides=True)
    laid = channels.basins_of(directions, points).join(cells, ["row", "col"])
    names = ["point_id", "area_km2", "relief_m", "row", "col", "perimeter_km", "compactness"]
    rounded = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select(*names).collect())
    got = rounded(channels.morphometry_of(totals, 10.0))
    assert got == rounded(terrain.morphometry(laid, 10.0, 10.0, ["point_id"])) and len(got) == len(places) - 1


def test_low_part_of_basins(spark):
    cells = ground(spark)
    directions = terrain.flow_directions(cells)
    points = spark.createDataFrame([(i, r, 14) for i, r in enumerate(range(1, 39, 4))] + [(50, 5, 14), (51, 20, 9)], "point_id int, row int, col int")
    z0 = points.join(cells, ["row", "col"]).select("point_id", F.col("z").alias("z0"))
    want = channels.basins_of(directions, points).join(cells, ["row", "col"]).join(z0, "point_id").filter("z < z0 + 6")
    rows = lambda df: sorted(map(tuple, df.select("point_id", "row", "col", "z").collect()))
    assert rows(channels.low_basins(directions, points, cells, 6.0)) == rows(want)


def test_points_below_many_triangles(spark, monkeypatch):
    """Triangles that lie many deep come in bands; the first that holds a point is the same as without bands."""
    rng = random.Random(8)
    corners = [[rng.uniform(0, 20) for _ in range(2)] for _ in range(60)]
    tri = spark.createDataFrame([(i, x, y, x + rng.uniform(1, 5), y + rng.uniform(0, 2), x + rng.uniform(0, 2), y + rng.uniform(1, 5)) for i, (x, y) in enumerate(corners)], "tri int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    points = spark.createDataFrame([(i, rng.uniform(0, 24), rng.uniform(0, 24)) for i in range(300)], "point_id int, x double, y double")
    whole = sorted(map(tuple, geometry.locate(points, tri, 4.0).collect()))
    tried = []
    monkeypatch.setattr(geometry, "FIRST", 3)
    monkeypatch.setattr(geometry, "cut", lambda df: tried.append(df.count()) or df)
    assert sorted(map(tuple, geometry.locate(points, tri, 4.0).collect())) == whole
    assert len(tried) > 3 and 0 < len(whole) < 300


def test_points_in_a_strip_have_small_tiles(spark, monkeypatch):
    """A long strip fills few tiles of its square box; these are divided until they are small, so a point meets few segments."""
    seen = []
    monkeypatch.setattr(axes, "cut", lambda df: seen.append(df.localCheckpoint()) or seen[-1])
    monkeypatch.setattr(axes, "drop", lambda *t: None)
    i = F.col("id")
    points = spark.range(16384).select(i.alias("point_id"), (i % 4).cast("double").alias("x"), F.floor(i / 4).cast("double").alias("y"))
    segments = spark.range(1024).select(i.alias("segment"), F.lit(1.5).alias("x1"), (4.0 * i).alias("y1"), F.lit(1.5).alias("x2"), (4.0 * i + 3).alias("y2"))
    got = axes.nearest_segment(points, segments).filter("distance > 1.5 + 1e-9 or segment <> floor(floor(point_id / 4) / 4)")
    assert got.count() == 0 and seen[-1].count() == 16384
    left = [t for t in seen if "segment" in t.columns and "tx" in t.columns][-1].groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("segments"))
    tiles = next(t for t in seen if {"tx", "ty", "n"} <= set(t.columns))
    assert tiles.join(left, ["tx", "ty"]).agg(F.sum(F.col("n") * F.col("segments"))).first()[0] < 20 * 16384


def test_normal_depth_needs_no_bisection(spark):
    """Ordinary values take six cheap steps (none of the halvings is left to do), and odd ones give what halving gives."""
    usual = [(q, b, n, j) for q in (1e-9, 0.3, 7.0, 90.0, 4000.0) for b in (0.5, 5.0, 34.0, 900.0) for n in (0.011, 0.035) for j in (1e-5, 0.0085, 0.3)]
    odd = [(q, 10.0, 0.03, 0.001) for q in (0.0, -1.0, 1e9, None, float("nan"), float("inf"))] + [(5.0, b, 0.03, j) for b, j in ((0.0, 0.001), (None, 0.001), (4.0, 0.0), (4.0, -0.1), (4.0, None))]
    cols = [F.col(c) for c in "qbnj"]
    halved = river.bisect(F.lit(0.0), F.lit(200.0), lambda y: river.manning(F.col("b") * y, F.col("b") * y / (F.col("b") + 2 * y), F.col("n"), F.col("j")) < F.col("q"))
    rows = spark.createDataFrame(usual + odd, "q double, b double, n double, j double")
    got = rows.select("q", halved.alias("want"), river.rectangular_normal_depth(*cols).alias("y"), river.rectangular_normal_depth(*cols, steps=0).alias("y0")).collect()
    assert all(abs(r.y - r.want) <= 1e-12 * max(1.0, r.want) for r in got)
    few = [r for r in got[: len(usual)] if r.want < 199]
    assert len(few) > 80 and all(r.y0 == r.y for r in few)


def test_backwater_looks_at_a_section_few_times(monkeypatch):
    """Levels need a few looks at each section, not one for every halving."""
    looks, real = [], hydraulics.wetted
    monkeypatch.setattr(hydraulics, "wetted", lambda *a, **k: looks.append(1) or real(*a, **k))
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 8, 200)
    x = np.cumsum(rng.uniform(20, 300, (200, 7)), 1)
    s, z = np.sort(rng.uniform(0, 30, (200, 7, 5)), -1), rng.uniform(0, 3, (200, 7, 5))
    z[..., [0, -1]] += 40
    for regime in ("sub", "super"):
        looks.clear()
        w, low, area, _ = hydraulics.profiles(x, s, z, counts, 50.0, 0.035, 0.002, 0.1, 0.3, regime)
        assert len(w) == counts.sum() and (area > 0).all() and (w > low).all()
        assert len(looks) < 7 * 45


def test_roots_are_those_of_halving():
    def halved(f, lo, hi):
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = np.where(f(mid) < 0, mid, lo), np.where(f(mid) < 0, hi, mid)
        return (lo + hi) / 2

    c = np.array([-3.0, -1.0, -1e-9, 0.0, 1e-7, 0.3, 1.0, 7.0, 99.0, 1e6, math.nan])
    lo, hi = np.full(c.shape, -1.0), np.full(c.shape, 100.0)
    for f in (lambda w: w - c, lambda w: np.where(w < c, -1e9, w - c + 5), lambda w: np.sign(w - c) * np.abs(w - c) ** 0.2, lambda w: (w - c) ** 3, lambda w: np.where(w > c, 0.1, 3.0) * (w - c), lambda w: np.arctan(50 * (w - c))):
        assert np.allclose(hydraulics.root(f, lo, hi), halved(f, lo, hi), rtol=1e-12, atol=1e-12)
