"""Shapefiles written and read by the data source."""

import datetime
import glob
import os
import struct

import pytest
from pyspark.sql import functions as F

from riverframe.sources import shapefile

SCHEMA = "id bigint, name string, area double, day date, ok boolean, rings array<array<struct<lon:double,lat:double>>>"


def squares(n):
    """n squares along a line, every tenth with a hole."""
    rows = []
    for i in range(n):
        x, y = i * 2.0, (i % 7) * 3.0
        outer = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        hole = [(x + 0.25, y + 0.25), (x + 0.5, y + 0.25), (x + 0.5, y + 0.5)]
        rings = [[{"lon": a, "lat": b} for a, b in r] for r in ([outer, hole] if i % 10 == 0 else [outer])]
        rows.append((i, f"basin {i} ñ" if i % 3 else None, i / 7 if i % 4 else None, datetime.date(2020, 1, 1 + i % 28), i % 2 == 0 if i % 5 else None, rings))
    return rows


@pytest.fixture()
def source(spark):
    spark.dataSource.register(shapefile.ShapefileSource)
    return spark


def test_round_trip_of_10000_polygons(source, tmp_path):
    path = str(tmp_path / "out")
    source.createDataFrame(squares(10_000), SCHEMA).repartition(5, "id").write.format("polygons_shp").mode("overwrite").save(path)
    back = source.read.format("polygons_shp").load(path)
    assert back.columns == [*shapefile.BOX, "rings", "id", "name", "area", "day", "ok"]
    rows = {r.id: r for r in back.collect()}
    assert len(rows) == 10_000
    for i, name, area, day, ok, rings in squares(10_000):
        r = rows[i]
        assert (r.name, r.area, r.day, r.ok) == (name, area, day, ok) and (r.xmin, r.ymin, r.xmax) == (rings[0][0]["lon"], rings[0][0]["lat"], rings[0][0]["lon"] + 1)
        got = [[(p.lon, p.lat) for p in ring] for ring in r.rings]
        assert [set(g) for g in got] == [{(p["lon"], p["lat"]) for p in ring} for ring in rings] and all(g[0] == g[-1] for g in got)
        turn = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:])) for g in got]
        assert turn[0] < 0 and all(t > 0 for t in turn[1:])
    # A second write takes the place of the first, an append adds to it.
    source.createDataFrame(squares(10), SCHEMA).coalesce(1).write.format("polygons_shp").mode("overwrite").save(path)
    assert source.read.format("polygons_shp").load(path).count() == 10
    source.createDataFrame(squares(3), SCHEMA).coalesce(1).write.format("polygons_shp").mode("append").save(path)
    assert source.read.format("polygons_shp").load(path).count() == 13


def test_the_box_keeps_files_closed(source, tmp_path):
    path = str(tmp_path / "out")
    source.createDataFrame(squares(1000), SCHEMA).repartitionByRange(8, "id").write.format("polygons_shp").mode("overwrite").save(path)
    files = sorted(glob.glob(f"{path}/part-*.shp"))
    assert len(files) == 8
    reader = shapefile.ShapefileReader(path, "100,0,110,100")
    opened = {r.path for r in reader.partitions()}
    assert len(opened) == 1
    for f in files:
        if f not in opened:  # a file outside may even be broken
            os.truncate(f, 0)
    got = source.read.format("polygons_shp").option("bbox", "100,0,110,100").load(path).collect()
    want = [i for i, *_, rings in squares(1000) if rings[0][0]["lon"] <= 110 and rings[0][0]["lon"] + 1 >= 100]
    assert sorted(r.id for r in got) == want


def test_comparisons_are_pushed(source, tmp_path):
    path = str(tmp_path / "out")
    source.createDataFrame(squares(1000), SCHEMA).repartitionByRange(4, "id").write.format("polygons_shp").mode("overwrite").save(path)
    source.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = source.read.format("polygons_shp").option("pushdown", "true").load(path).filter("xmin <= 20 and xmax > 11 and id <> 7")
        assert sorted(r.id for r in df.collect()) == [6, 8, 9, 10]
    finally:
        source.conf.unset("spark.sql.python.filterPushdown.enabled")
    box = (0.0, 0.0, 10.0, 10.0)
    assert shapefile.outside(box, [("xmin", ">=", 11.0)]) and shapefile.outside(box, [("ymax", "<", 0.0)]) and not shapefile.outside(box, [("xmin", "<=", 0.0), ("ymax", ">=", 10.0)])
    assert shapefile.fails(box, [("xmax", ">", 10.0)]) and not shapefile.fails(box, [("xmax", ">=", 10.0)])


def test_files_of_others_and_odd_rows(source, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, "", 1.5, None, None, None), (2, "x", None, None, True, []), *squares(2)]
    source.createDataFrame(rows, SCHEMA).coalesce(1).write.format("polygons_shp").mode("overwrite").save(path)
    os.remove(f"{path}/{shapefile.NOTE}")  # as another program writes them
    one = glob.glob(f"{path}/*.shp")[0]
    got = source.read.format("polygons_shp").load(one).collect()
    assert sorted((r.id, r.rings is None, r.name) for r in got) == sorted([(1, True, None), (2, True, "x"), (0, False, None), (1, False, "basin 1 ñ")])
    head = open(one, "rb").read(100)
    assert struct.unpack(">i", head[:4])[0] == 9994 and struct.unpack("<2i", head[28:36]) == (1000, 5) and struct.unpack(">i", head[24:28])[0] * 2 == os.path.getsize(one)
    with pytest.raises(Exception, match="254"):
        source.createDataFrame([(1, "y" * 300, None, None, None, None)], SCHEMA).write.format("polygons_shp").mode("append").save(path)
    assert not glob.glob(f"{path}/_part-*") and source.read.format("polygons_shp").load(path).count() == 4
    empty = str(tmp_path / "none")
    source.createDataFrame([], SCHEMA).write.format("polygons_shp").mode("overwrite").save(empty)
    assert not glob.glob(f"{empty}/*.shp") or source.read.format("polygons_shp").load(empty).count() == 0


def test_basins(source, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0000001), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    tiny = [(0.0, 0.0), (1.0, 0.0)]
    rows = [(11, 0, 1.234, [[{"lon": x, "lat": y} for x, y in ring]]), (12, 11, 2.0, [[{"lon": x, "lat": y} for x, y in tiny]])]
    path = str(tmp_path / "b")
    source.createDataFrame(rows, "HYBAS_ID bigint, NEXT_DOWN bigint, SUB_AREA double, rings array<array<struct<lon:double,lat:double>>>").write.format("polygons_shp").mode("overwrite").save(path)
    shapes = source.read.format("polygons_shp").load(path)
    got = shapefile.basins(shapes, {"id": "HYBAS_ID", "next_down": "NEXT_DOWN", "sub_area": "SUB_AREA"}, 0.001).collect()
    assert [(r.id, r.next_down, r.sub_area, r.up_area, r.w, r.s, r.e, r.n) for r in got] == [(11, 0, 1.23, None, 0.0, 0.0, 2.0, 2.0)] and len(got[0].ring) == 5
    assert shapefile.basins(shapes, {"id": "HYBAS_ID"}).select(F.size("ring").alias("n")).first().n == 6
