"""Delineation by widening windows against the whole raster."""

import random

import pytest

from riverframe.operators import channels, terrain, windows


def test_windows_against_the_whole_raster(spark, tmp_path):
    rng = random.Random(6)
    # Two valleys, so that some basins are long and others end within their first block.
    cells = spark.createDataFrame([(r, c, 1.0 * r + 2 * min(abs(c - 12), abs(c - 35)) + rng.random() * 2.5) for r in range(60) for c in range(48)], "row int, col int, z double")
    path = str(tmp_path / "blocks")
    windows.write_blocks(cells, path, 8)
    directions = terrain.flow_directions(cells)
    points = spark.createDataFrame([(1, 1, 12), (2, 30, 35), (3, 58, 20), (4, 20, 12), (5, 200, 3), (6, 40, 47), (7, 31, 35)], "point_id int, row int, col int")
    basins, states = windows.delineate(spark, path, points, size=8, first=4)
    want = {tuple(r) for r in channels.basins_of(directions, points).select("point_id", "row", "col").collect()}
    assert {tuple(r) for r in basins.select("point_id", "row", "col").collect()} == want
    state = {r.point_id: (r.half, r.truncated) for r in states.collect()}
    assert set(state) == set(range(1, 8)) and not any(t for _, t in state.values())
    assert state[1][0] > state[3][0] and state[5][0] == 4
    cut_off, states = windows.delineate(spark, path, points, size=8, first=4, rounds=1)
    state = {r.point_id: r.truncated for r in states.collect()}
    assert state[1] and not state[3]
    assert {tuple(r) for r in cut_off.filter("point_id = 3").select("point_id", "row", "col").collect()} == {w for w in want if w[0] == 3}


@pytest.mark.parametrize("most", [windows.LISTED_MOST, 1])
def test_only_wanted_blocks_are_read(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(windows, "LISTED_MOST", most)
    cells = spark.range(40 * 40).selectExpr("cast(id div 40 as int) as row", "cast(id % 40 as int) as col", "cast(id as double) as z")
    path = str(tmp_path / "blocks")
    windows.write_blocks(cells, path, 10)
    blocks = spark.createDataFrame([(1 * (1 << 31) + 2,), (0,)], "block bigint")
    read = windows.read_blocks(spark, path, blocks)
    assert {(r.row, r.col) for r in read.filter(f"block = {(1 << 31) + 2}").collect()} == {(r, c) for r in range(9, 21) for c in range(19, 31)}
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("PartitionFilters: ")[1:]).split("]")[0]
    assert "block" in filters and (most == 1 or str((1 << 31) + 2) in filters)
    assert spark.read.parquet(path).select("block").distinct().count() == 16
