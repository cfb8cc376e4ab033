import numpy as np
from pyspark.sql import functions as F

from riverframe.functions import register, stats
from riverframe.operators import geometry
from riverframe.streaming import annual


def test_polylines(spark):
    line = spark.createDataFrame([("a", [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001)])], "k string, line array<struct<lon:double,lat:double>>")
    got = geometry.resample(line, ["k"], 5).orderBy("i").collect()
    total = 111.32 + 110.54
    assert [round(r.s, 3) for r in got] == [round(total * i / 4, 3) for i in range(5)]
    assert (got[0].lon, got[-1].lat) == (0.0, 0.001) and abs(got[1].lat) < 1e-12
    cross = geometry.cross_line(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "section_id int, lon double, lat double, bearing double"), 200.0, 3).orderBy("i").collect()
    assert abs(cross[0].lon + 100 / 111320) < 1e-9 and cross[1].lon == 0 and abs(cross[2].lat) < 1e-9
    seg = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 0.0), ("a", 2, 10.0, 0.0, 10.0, 10.0)], "k string, segment int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([("a", 7, 4.0, 3.0), ("a", 8, 12.0, 5.0)], "k string, point_id int, x double, y double")
    assert sorted((r.point_id, r.segment, r.t, r.distance) for r in geometry.nearest_segment(p, seg, ["k"]).collect()) == [(7, 1, 0.4, 3.0), (8, 2, 0.5, 2.0)]


def test_triangles(spark):
    t = spark.createDataFrame([("g", 1, 0.0, 0.0, 0.0, 4.0, 0.0, 4.0, 0.0, 4.0, 8.0), ("g", 2, 4.0, 0.0, 4.0, 4.0, 4.0, 12.0, 0.0, 4.0, 8.0)], "g string, tri int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, x3 double, y3 double, z3 double")
    got = {(r.row, r.col): r.z for r in geometry.rasterize_tin(t, ["g"], 0.0, 0.0, 1.0).collect()}
    assert len(got) == 16 and all(abs(z - ((c + 0.5) + 2 * (r + 0.5))) < 1e-9 for (r, c), z in got.items())
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.5, 3.5), (3, 9.0, 9.0)], "point_id int, x double, y double")
    assert sorted((r.point_id, r.tri) for r in geometry.locate(p, t, 2.0).collect()) == [(1, 1), (2, 2)]
    m = spark.createDataFrame([(1, 1, 2, 3, 1.0), (2, 2, 4, 3, 3.0)], "tri int, n1 int, n2 int, n3 int, area double")
    e = {(r.a, r.b): (r.left, r.right) for r in geometry.mesh_edges(m).collect()}
    assert e[2, 3] == (1, 2) and e[1, 2] == (1, None) and len(e) == 5
    f = spark.createDataFrame([(1, 10.0), (2, 20.0)], "tri int, h double")
    assert {r.node: r.h for r in geometry.cells_to_nodes(f, m, "h").collect()} == {1: 10.0, 2: 17.5, 3: 17.5, 4: 20.0}


def test_grids_and_outlines(spark):
    z = np.full((5, 5), np.nan)
    z[:, 0], z[:, 4] = 0.0, 8.0
    cells = spark.createDataFrame([("g", r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(5) for c in range(5)], "grid string, row int, col int, z double")
    got = {(r.row, r.col): r.z for r in geometry.fill_grid(cells, "grid").collect()}
    assert all(abs(got[r, c] - 2 * c) < 0.01 for r in range(5) for c in range(5))
    base = spark.createDataFrame([("g", 0, i, 10.0) for i in range(3)], "grid string, row int, col int, z double")
    over = spark.createDataFrame([("g", 0, 1, 20.0, 5.0), ("g", 0, 2, 20.0, 99.0)], "grid string, row int, col int, z double, d_edge double")
    assert {r.col: r.z for r in geometry.blend(base, over, ["grid"], F.lit(10.0)).collect()} == {0: 10.0, 1: 15.0, 2: 20.0}
    mask = spark.createDataFrame([("a", r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "k string, row int, col int")
    ring = geometry.outlines(mask, "k").first().ring
    assert sorted((p.r, p.c) for p in ring) == [(0, 0), (0, 3), (3, 0), (3, 3)]
    square = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))])
    cut = spark.range(1).select(geometry.chaikin(square).alias("r")).first().r
    assert len(cut) == 8 and (cut[0].lon, cut[1].lon) == (1.0, 3.0)
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], float)
    assert geometry.simplify(line, 0.5).tolist() == [0, 2, 3, 4]


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT haversine_km(0, 0, 0, 1) AS d, scs_pe(100, 80) AS p, hazard_class(1.1, 0.5) AS c, norm_inv(0.9) AS z, gamma_inv(1.0, 0.5) AS g").first()
    assert abs(r.d - 111.195) < 0.01 and abs(r.p - 50.539) < 0.01 and r.c == "H3" and abs(r.z - 1.2816) < 1e-4 and abs(r.g - 0.693147) < 1e-5


def test_sql_functions_of_tables_and_depths(spark):
    register.register(spark)
    spark.createDataFrame([(i, i / 100) for i in range(101)], "i int, p double").createOrReplaceTempView("probabilities")
    rows = spark.sql("SELECT p, norm_inv(p) AS z FROM probabilities").collect()
    want = spark.createDataFrame([(r.p,) for r in rows], "p double").select("p", stats.norm_inv(F.col("p")).alias("z")).collect()
    assert {r.p: r.z for r in rows} == {r.p: r.z for r in want} and rows[0].z is None and rows[100].z is None
    got = spark.sql("SELECT interp(x, array(1D, 2D, 4D), array(10D, 20D, 0D)) AS y FROM VALUES (0D), (1D), (1.5D), (2D), (3D), (9D), (NULL) AS t(x)").collect()
    assert [r.y for r in got] == [10.0, 10.0, 15.0, 20.0, 10.0, 0.0, None]
    y = spark.sql("SELECT normal_depth(50D, 20D, 0.035D, 0.002D) AS y").first().y
    assert abs(20 * y * (20 * y / (20 + 2 * y)) ** (2 / 3) * 0.002**0.5 / 0.035 - 50) < 1e-9


def test_stream_of_maxima(spark, tmp_path):
    rows = [("a", "2024-01-05 00:00:00", 3.0), ("a", "2024-01-06 00:00:00", 9.0), ("b", "2024-01-07 00:00:00", 1.0), ("a", "2024-03-30 00:00:00", 2.0)]
    spark.createDataFrame(rows, "k string, t string, value double").select("k", F.to_timestamp("t").alias("ts"), "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = annual.period_maxima(stream, ["k"]).writeStream.format("memory").queryName("maxima").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert sorted((r.k, r.value) for r in spark.table("maxima").collect()) == [("a", 2.0), ("a", 9.0), ("b", 1.0)]
