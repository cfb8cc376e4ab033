import numpy as np
import pytest
from pyspark.sql import functions as F

from riverframe.functions import geo, river
from riverframe.operators import hydraulics, stations, terrain
from riverframe.sources import stations as sources
from riverframe.sources import survey


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


S, Z = np.array([0.0, 0.0, 10.0, 10.0]), np.array([6.0, 0.0, 0.0, 6.0])


def test_rectangular_section(spark):
    a, p, b, _ = hydraulics.wetted(S, Z, 2.0)
    assert (a, p, b) == (20.0, 14.0, 10.0)
    q = hydraulics.manning_flow(S, Z, 2.0, 0.03, 0.001)
    assert abs(q - 26.74) < 0.01 and abs(hydraulics.normal_level(S, Z, q, 0.03, 0.001) - 2) < 1e-3
    pts = spark.createDataFrame([(1, float(s), float(z), i) for i, (s, z) in enumerate(zip([0, 0.001, 9.999, 10], Z))], "k int, s double, z double, i int")
    r = hydraulics.section_properties(pts, ["k"], F.lit(2.0)).first()
    assert abs(r.area - 20) < 0.01 and abs(r.perimeter - 14) < 0.01
    assert abs(value(spark, river.critical_depth_box(F.lit(8.0), F.lit(2.0))) - 1.177) < 1e-3
    assert abs(hydraulics.critical_level(S, Z, 30.0) - (900 / 981) ** (1 / 3)) < 1e-3
    y = value(spark, river.rectangular_normal_depth(F.lit(q), F.lit(10.0), F.lit(0.03), F.lit(0.001)))
    assert abs(y - 2) < 1e-9


def test_backwater_of_a_uniform_reach(spark):
    pts = lambda z: [(0.0, z + 6), (0.001, z), (10.0, z), (10.001, z + 6)]
    rows = [(1, float(i * 50), pts(10 - i * 50 * 0.001)) for i in range(10)]
    df = spark.createDataFrame(rows, "reach int, station double, pts array<struct<s:double,z:double>>")
    for regime in ("sub", "mixed"):
        got = hydraulics.backwater(df, "reach", 26.74, n=0.03, slope=0.001, regime=regime).collect()
        assert len(got) == 10 and all(abs(r.depth - 2) < 0.01 and r.fr < 1 for r in got)


def marched(reaches, regime):
    """Profiles of reaches as lists of (station, [(s, z), ...])."""
    counts = np.array([len(r) for r in reaches])
    points = np.array([len(p) for r in reaches for _, p in r])
    s, z = (hydraulics.padded(np.array([p[i] for r in reaches for _, pts in r for p in pts]), points, counts) for i in (0, 1))
    x = hydraulics.padded(np.array([x for r in reaches for x, _ in r]), counts, np.ones(len(reaches), int))[:, 0]
    return hydraulics.profiles(x, s, z, counts, 30.0, 0.03, 0.002, 0.1, 0.3, regime)


def test_backwater_of_many_reaches_is_that_of_each(spark):
    r = np.random.default_rng(5)
    reaches = {}
    for i in range(12):
        ends = [(0.0, 40.0), *((float(x), float(r.uniform(0, 3))) for x in range(1, r.integers(3, 9))), (9.0, 40.0)]
        reaches[i] = [(50.0 * k, [(s, z - 0.1 * k) for s, z in ends]) for k in range(r.integers(1, 6))]
    for regime in ("sub", "super", "mixed"):
        whole = marched(list(reaches.values()), regime)
        single = [np.concatenate(x) for x in zip(*(marched([x], regime) for x in reaches.values()))]
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(whole, single))
    df = spark.createDataFrame([(i, x, p) for i, rows in reaches.items() for x, p in rows], "reach int, station double, pts array<struct<s:double,z:double>>").repartition(3)
    got = {(x.reach, x.station): x.level for x in hydraulics.backwater(df, "reach", 30.0, n=0.03, regime="mixed").collect()}
    assert np.allclose([got.pop((i, x)) for i, rows in reaches.items() for x, _ in rows], whole[0], rtol=0, atol=1e-9) and not got


def test_queries_take_every_reach_and_culvert(spark):
    from riverframe.plans import registry

    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    got = registry.queries()["backwater_profile"](spark, sf)
    assert got.count() == want and got.filter("depth > 0").count() == want
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    rated = registry.queries()["culvert_rating"](spark, sf).collect()
    assert {r.id for r in rated} == suppliers and len(rated) == 24 * len(suppliers)


def test_scour_and_hazard(spark):
    zero = F.lit(0.0)
    args = [F.lit(1.5), F.lit(3.0), F.lit(0.4), F.lit(20.0)]
    round_, square = (value(spark, river.pier_scour(*args, F.lit(s), zero, zero, F.lit(1.1))["csu"]) for s in ("circular", "square"))
    assert abs(round_ - 2 * 1.1 * 3 * 0.5**0.65 * 0.4**0.43) < 1e-9 and abs(square / round_ - 1.1) < 1e-9
    assert [value(spark, river.hazard_class(F.lit(h), F.lit(v))) for h, v in ((0.2, 1.0), (0.45, 1.2), (1.1, 0.5), (1.9, 0.5), (3.9, 1.0), (5.0, 1.0))] == ["H1", "H2", "H3", "H4", "H5", "H6"]
    assert abs(value(spark, river.frequency_beta(F.lit(100.0))) - 0.9875) < 1e-9
    assert value(spark, river.exponent_granular(F.lit(1.0))) == 0.40 and value(spark, river.exponent_cohesive(F.lit(9.0))) == 0.28
    k = value(spark, river.mononobe_okabe(F.lit(30.0), zero, zero, zero, zero))
    assert abs(k - 1 / 3) < 1e-9 and value(spark, river.mononobe_okabe(F.lit(10.0), zero, zero, zero, F.lit(20.0))) is None
    level = value(spark, hydraulics.bridge_level(F.lit(50.0), F.lit(10.0), F.lit(3.0), F.lit(4.0), F.lit(30.0), zero, F.lit(2.0)))
    assert 3 <= level < 10


def test_still_water_stays_still_and_mass_is_kept():
    z = np.array([0.0, 0.3, 0.1, 0.8, 0.2, 0.0])
    for _, h, q in hydraulics.shallow_water(1.0 - z, np.zeros(6), z, 5.0, 20.0):
        assert np.allclose(h + z, 1.0, atol=1e-9) and np.allclose(q, 0, atol=1e-9)
    h0 = np.where(np.arange(200) < 100, 2.0, 0.0)
    frames = list(hydraulics.shallow_water(h0, np.zeros(200), np.zeros(200), 5.0, 20.0))
    assert abs(frames[-1][1].sum() - h0.sum()) < 1e-6
    middle = frames[-1][1][99:101].mean()
    assert abs(middle - 4 / 9 * 2.0) < 0.08


def test_bed_and_culvert(spark):
    z = hydraulics.mobile_bed(np.linspace(10, 9, 11), np.full(11, 20.0), 100.0, np.full(50, 60.0), 3600.0, 0.03, 0.01, supply=0.5)
    assert z[0] < 10
    c = spark.createDataFrame([(1, 2.0, 3.0, 20.0, 0.01, 0.013)], "id int, width double, height double, length double, slope double, n double")
    hw = [r.headwater for r in hydraulics.culvert_rating(c, ["id"]).orderBy("q").collect()]
    assert len(hw) == 24 and hw == sorted(hw)


def plane(spark, rows=8, cols=9):
    return spark.createDataFrame([(r, c, float(10 * (rows - r) + abs(c - 4))) for r in range(rows) for c in range(cols)], "row int, col int, z double")


def test_valley(spark):
    cells = plane(spark)
    d = terrain.flow_directions(cells)
    to = {(r.row, r.col): (r.to_row, r.to_col) for r in d.collect()}
    assert to[3, 4] == (4, 4) and to[0, 0] == (None, None)
    acc = {(r.row, r.col): r.acc for r in terrain.accumulate(d).collect()}
    brute = {k: 0 for k in to}
    for k in to:
        at = k
        while at[0] is not None:
            brute[at] += 1
            at = to[at]
    assert acc == brute
    outlet = spark.createDataFrame([(7, 4, "o")], "row int, col int, outlet string")
    basin = {(r.row, r.col) for r in terrain.watershed(d, outlet).collect()}
    want = set()
    for k in to:
        at = k
        while at[0] is not None:
            if at == (7, 4):
                want.add(k)
            at = to[at]
    assert basin == want
    marked = terrain.watershed(d, outlet).join(cells, ["row", "col"])
    m = terrain.morphometry(marked, 100.0, 100.0).first()
    assert abs(m.area_km2 - len(want) * 0.01) < 1e-9 and m.compactness > 0
    net = terrain.drainage(terrain.accumulate(d), d, 5)
    assert net.count() > 0
    snapped = terrain.snap_outlet(terrain.accumulate(d), spark.createDataFrame([("p", 6, 3)], "point_id string, row int, col int"), 2, 5).first()
    assert acc[snapped.row, snapped.col] >= 5


def test_fill_and_storage(spark):
    z = np.full((7, 7), 5.0)
    z[3, 3] = 1.0
    z[0, 3] = 4.0
    filled = terrain.fill(z)
    assert filled[3, 3] > 4.0 and filled[0, 3] == 4.0
    cells = spark.createDataFrame([("g", r, c, float(z[r, c])) for r in range(7) for c in range(7)], "grid string, row int, col int, z double")
    got = {(r.row, r.col): r.z for r in terrain.fill_sinks(cells, "grid").collect()}
    assert all(abs(got[r, c] - filled[r, c]) < 1e-6 for r in range(7) for c in range(7))
    curve = terrain.storage_curve(cells, ["grid"], 1.0, 5).orderBy("level_no").collect()
    assert [round(c.volume, 6) for c in curve] == [round(float(np.maximum(0, c.level - z).sum()), 6) for c in curve]


def test_fill_across_tiles(spark):
    r = np.random.default_rng(3)
    rows, cols = np.mgrid[0:31, 0:26]
    z = np.hypot(rows - 15, cols - 12) + r.uniform(0, 6, rows.shape) + 40.0
    z[5:26:4, 2:24] = 90.0  # walls with gaps on alternate sides, so water winds through tiles
    z[5:26:8, 2], z[9:26:8, 23] = 50.0, 50.0
    cells = spark.createDataFrame([(i - 9, j + 3, float(z[i, j])) for i in range(31) for j in range(26)], "row int, col int, z double")
    want = terrain.fill(z)
    for tile in (7, 64):
        got = {(x.row + 9, x.col - 3): x.z for x in terrain.fill_raster(cells, tile).collect()}
        assert got == {(i, j): float(want[i, j]) for i in range(31) for j in range(26)}
    assert terrain.fill_raster(cells.limit(0)).count() == 0


def test_fill_query_is_one_raster(spark, tmp_path):
    from riverframe.plans import registry

    z = np.random.default_rng(4).uniform(900, 2000, (110, 50))
    z[44:56, 20:30] = 10.0  # a hollow across the border of two tiles
    parts = [(i * 50 + j, float(z[i, j])) for i in range(110) for j in range(50)]
    spark.createDataFrame(parts, "p_partkey bigint, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = terrain.fill(z)
    got = registry.queries()["fill_sinks"](spark, str(tmp_path)).collect()
    assert {(x.grid, x.row, x.col): x.z for x in got} == {(i // 50, i, j): float(want[i, j]) for i in range(110) for j in range(50)} and len(got) == len(parts)
    assert (want != np.concatenate([terrain.fill(z[i : i + 50]) for i in (0, 50, 100)])).any()


def test_upstream_of_a_long_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 5) for i in range(5)] + [(2000, 1002)]
    tree = spark.createDataFrame(rows, "id int, next_down int")
    got = stations.upstream(tree, spark.createDataFrame([(0,), (250,), (1000,)], "id int"))
    want = [(0, i) for i in range(300)] + [(250, i) for i in range(250, 300)] + [(1000, i) for i in (*range(1000, 1005), 2000)]
    assert sorted(map(tuple, got.collect())) == want


def test_polygons_trees_and_distance(spark):
    squares = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)])], "polygon_id int, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 5.0), (4, 0.0, 1.0)], "point_id int, lon double, lat double")
    assert sorted(map(tuple, stations.inside(points, squares).collect())) == [(1, 1), (2, 1), (2, 2), (4, 1)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (8, 9), (9, 8)], "id int, next_down int")
    got = stations.upstream(tree, spark.createDataFrame([(1,), (8,)], "id int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (8, 8), (8, 9)]
    assert abs(value(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.195) < 0.01
    lat, lon = geo.utm_inverse(F.lit(500_000.0), F.lit(10_000_000.0), F.lit(19), F.lit(True))
    assert abs(value(spark, lat)) < 1e-9 and abs(value(spark, lon) + 69) < 1e-9
    lat, lon = geo.to_wgs84(F.lit(-33.0), F.lit(-70.0), "PSAD56")
    assert 1e-4 < abs(value(spark, lat) + 33) < 0.01 and value(spark, geo.to_wgs84(F.lit(-33.0), F.lit(-70.0), "SIRGAS")[0]) == -33.0
    stas = spark.createDataFrame([(1, 0.0, 179.9, 20), (2, 0.0, -179.9, 3), (3, 10.0, 0.0, 5)], "station_id int, lat double, lon double, n_years int")
    at = spark.createDataFrame([(7, 0.0, 179.95)], "point_id int, lat double, lon double")
    assert {r.station_id for r in stations.near(at, stas, 50.0).collect()} == {1, 2}
    assert stations.recommended(stations.nearest(at, stas, 3)).first().station_id == 1


DXF = """0
SECTION
2
ENTITIES
0
LWPOLYLINE
8
CURVES
38
12.5
70
1
10
0
20
0
10
5
20
0
10
5
20
5
0
POINT
8
PTS
10
1
20
2
30
3
0
3DFACE
8
TIN
10
0
20
0
30
1
11
1
21
0
31
2
12
0
22
1
32
3
13
0
23
1
33
3
0
TEXT
8
LABELS
10
4
20
4
30
0
1
101.5
0
POLYLINE
8
OLD
10
0
20
0
30
0
0
VERTEX
8
OLD
10
1
20
1
30
7
0
VERTEX
8
OLD
10
2
20
2
30
8
0
SEQEND
0
ENDSEC
0
EOF
"""


def test_drawings_and_kml(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF)
    e = survey.read_dxf(spark, str(tmp_path / "a.dxf"))
    got = {r.layer: r for r in e.collect()}
    assert [got[k].kind for k in ("CURVES", "PTS", "TIN", "LABELS", "OLD")] == ["polyline", "point", "face", "text", "polyline"]
    assert got["CURVES"].closed and [p.z for p in got["CURVES"].points] == [12.5] * 3 and len(got["TIN"].points) == 3
    assert [(p.x, p.z) for p in got["OLD"].points] == [(1.0, 7.0), (2.0, 8.0)]
    terrain_layers = {r.layer for r in survey.layer_inventory(e).filter("terrain").collect()}
    assert terrain_layers == {"CURVES", "PTS", "TIN", "LABELS", "OLD"}
    assert survey.point_cloud(e, texts=True).filter("z = 101.5").count() == 1
    (tmp_path / "a.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>B</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0,5 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>')
    k = survey.read_kml(spark, str(tmp_path / "a.kml")).first()
    assert (k.kind, k.layer, [p.z for p in k.points]) == ("polygon", "B", [0.0, 5.0, 0.0])


def test_station_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"bna": "00000001", "tipo": "pr", "lat": -20, "lon": -70.5, "n_anios": 2, "serie": {"1990": 10.25, "1991": 3}}')
    files = sources.read_series_files(spark, str(tmp_path / "s.json"))
    assert sorted(map(tuple, sources.tidy(files).collect())) == [("00000001", "pr", 1990, 10.25), ("00000001", "pr", 1991, 3.0)]
    c = sources.catalogue(files).first()
    assert (c.n_anios, c.periodo) == (2, "1990-1991")
    (tmp_path / "d.csv").write_text("codigo,1,22\naltura,5,6\n2001-01-01,3.5,\n2001-01-02,-9999,7\n")
    assert sorted((str(r.date), r.bna, r.value) for r in sources.daily_matrix(spark, str(tmp_path / "d.csv")).collect()) == [("2001-01-01", "00000001", 3.5), ("2001-01-02", "00000022", 7.0)]
    pasted = spark.createDataFrame([("a", "year value\n1990; 4.5\n1991\t6"), ("b", "7\n8")], "id string, text string")
    assert sorted(map(tuple, sources.parse_pasted(pasted).collect())) == [("a", 1990, 4.5), ("a", 1991, 6.0), ("b", 1, 7.0), ("b", 2, 8.0)]
    grid = spark.createDataFrame([("g", r, c, float(r * 10 + c)) for r in range(2) for c in range(3)], "grid string, row int, col int, z double")
    lines = [r.line for r in survey.ascii_grid(grid, "grid", 1.0).orderBy("row").collect()]
    assert lines[0].startswith("ncols 3\nnrows 2") and lines[1] == "0.0 1.0 2.0"
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1))])
    text = value(spark, survey.geojson("Polygon", ring, F.struct(F.lit(3).alias("n"))))
    assert text == '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]},"properties":{"n":3}}'
    assert "<name>a&amp;b</name>" in value(spark, survey.kml_placemark(F.lit("a&b"), ring))


@pytest.mark.parametrize("n", [1, 3])
def test_upsert_and_override(spark, n):
    old = spark.createDataFrame([(i, "o") for i in range(5)], "k int, v string")
    new = spark.createDataFrame([(i, "n") for i in range(n)], "k int, v string")
    for f in (stations.upsert, stations.override):
        assert sorted(map(tuple, f(old, new, ["k"]).collect())) == [(i, "n" if i < n else "o") for i in range(5)]
