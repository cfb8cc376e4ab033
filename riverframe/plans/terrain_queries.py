"""Rasters, basins and geometry over parts as cells and nations as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import interpolate
from ..operators import order, stations, terrain
from . import bindings as b
from .registry import query

OFFSETS = ", ".join(f"({i}, {r}, {c}, sqrt({r * r + c * c}.0))" for i, (r, c) in enumerate(terrain.N8))


@query(f"""WITH {b.RASTER}, o(o, dr, dc, d) AS (VALUES {OFFSETS}),
n AS (SELECT a.row, a.col, o.o, x.row AS r, x.col AS c, (a.z - x.z) / o.d AS s FROM ras a, o LEFT JOIN ras x ON x.row = a.row + o.dr AND x.col = a.col + o.dc),
k AS (SELECT row, col, count(r) AS k FROM n GROUP BY 1, 2),
f AS (SELECT row, col, r, c FROM n WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY s DESC, o) = 1)
SELECT k.row, k.col, CASE WHEN k = 8 THEN f.r END AS to_row, CASE WHEN k = 8 THEN f.c END AS to_col FROM k LEFT JOIN f ON k.row = f.row AND k.col = f.col""")
def d8_direction(spark, sf_dir):
    return terrain.flow_directions(b.part_raster(spark, sf_dir))


D8 = d8_direction


@query(f"""WITH RECURSIVE {b.RASTER}, o(o, dr, dc, d) AS (VALUES {OFFSETS}),
n AS (SELECT a.row, a.col, o.o, x.row AS r, x.col AS c, (a.z - x.z) / o.d AS s FROM ras a, o LEFT JOIN ras x ON x.row = a.row + o.dr AND x.col = a.col + o.dc),
k AS (SELECT row, col, count(r) AS k FROM n GROUP BY 1, 2),
f AS (SELECT row, col, r, c FROM n WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY s DESC, o) = 1),
d AS (SELECT k.row, k.col, f.r, f.c FROM k LEFT JOIN f ON k.row = f.row AND k.col = f.col AND k = 8),
p AS (SELECT row, col FROM d UNION ALL SELECT d.r, d.c FROM p JOIN d ON p.row = d.row AND p.col = d.col WHERE d.r IS NOT NULL)
SELECT row, col, count(*) AS acc FROM p GROUP BY row, col""")
def d8_accumulation(spark, sf_dir):
    return terrain.accumulate(terrain.flow_directions(b.part_raster(spark, sf_dir)))


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS root, p_partkey AS id FROM part WHERE p_partkey BETWEEN 1 AND 8
  UNION ALL SELECT c.root, p.p_partkey FROM c JOIN part p ON p.p_partkey // 2 = c.id AND p.p_partkey > 1)
SELECT root, count(*) AS n, round(sum(p_retailprice), 2) AS area FROM c JOIN part ON p_partkey = id GROUP BY root""")
def upstream_closure(spark, sf_dir):
    p = b.read(spark, sf_dir, "part")
    tree = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("next_down"))
    closed = stations.upstream(tree, tree.filter("id between 1 and 8").select("id"))
    area = p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"))
    return closed.join(area, "id").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 2).alias("area"))


SQUARES = ((1, -73.0, -60.0, -60.0, -30.0), (2, -71.0, -40.0, -69.5, -20.0), (3, -74.0, -58.0, -70.2, -19.0))


@query(f"""WITH p AS (SELECT s_suppkey AS point_id, (-17.5 - (s_suppkey % 97) * 0.4)::DOUBLE AS lat, (-68.5 - (s_suppkey % 13) * 0.37)::DOUBLE AS lon FROM supplier),
g(polygon_id, w, s, e, n) AS (VALUES {", ".join(map(str, SQUARES))}),
ed AS (SELECT polygon_id, w AS x1, s AS y1, e AS x2, s AS y2 FROM g UNION ALL SELECT polygon_id, e, s, (w + e) / 2, n FROM g UNION ALL SELECT polygon_id, (w + e) / 2, n, w, s FROM g)
SELECT point_id, polygon_id FROM p, ed WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (CASE WHEN y2 <> y1 THEN y2 - y1 END) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(spark, sf_dir):
    """Points in triangles."""
    k = F.col("s_suppkey")
    points = b.read(spark, sf_dir, "supplier").select(k.alias("point_id"), (-17.5 - (k % 97) * 0.4).alias("lat"), (-68.5 - (k % 13) * 0.37).alias("lon"))
    rings = [(i, [(float(w), float(s)), (float(e), float(s)), ((w + e) / 2, float(n))]) for i, w, s, e, n in SQUARES]
    polygons = spark.createDataFrame(rings, "polygon_id int, ring array<struct<lon:double,lat:double>>")
    return stations.inside(points, polygons, cell=2.0)


@query(f"""WITH {b.RASTER}, h AS (SELECT min(z) AS lo, max(z) AS hi FROM ras), l AS (SELECT unnest(range(24))::INTEGER AS level_no)
SELECT level_no, round(lo + level_no * (hi - lo) / 23, 4) AS level, (count(z) * 100)::DOUBLE AS area, round(coalesce(sum(lo + level_no * (hi - lo) / 23 - z), 0) * 100, 2) AS volume
FROM h, l LEFT JOIN ras ON z < lo + level_no * (hi - lo) / 23 GROUP BY level_no, lo, hi""")
def stage_volume(spark, sf_dir):
    c = terrain.storage_curve(b.part_raster(spark, sf_dir).withColumn("g", F.lit(1)), ["g"], 100.0)
    return c.select("level_no", F.round("level", 4).alias("level"), F.col("area").cast("double").alias("area"), F.round(F.abs("volume"), 2).alias("volume"))


@query("""WITH l AS (SELECT s_suppkey AS basin, 900.0 + s_suppkey % 500 AS line FROM supplier), p AS (SELECT p_size % 10 AS k, p_retailprice AS lo, p_retailprice + 50 AS hi, sum(p_size)::DOUBLE AS area FROM part GROUP BY 1, 2, 3)
SELECT basin, round(sum(area * least(1.0, greatest(0.0, (line - lo) / (hi - lo)))), 4) AS below, round(sum(area * (1 - least(1.0, greatest(0.0, (line - lo) / (hi - lo))))), 4) AS above FROM l, p WHERE basin % 10 = k GROUP BY basin""")
def hypsometric_split(spark, sf_dir):
    """Bands by the price and the last digit of the size of all parts; a basin has those of its last digit."""
    k = F.col("s_suppkey")
    lines = b.read(spark, sf_dir, "supplier").select(k.alias("basin"), (900.0 + k % 500).alias("line"), (k % 10).alias("k"))
    bands = b.read(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("bigint").alias("k"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 50).alias("hi"), F.col("p_size").cast("double").alias("area"))
    out = order.below_lines(bands, lines, ["k"])
    return out.select("basin", F.round("below", 4).alias("below"), F.round("above", 4).alias("above"))


@query(f"""WITH {b.RASTER}, p AS (SELECT s_suppkey AS point_id, (s_suppkey % 40) + 0.25 AS x, (s_suppkey % 3) + 0.75 AS y FROM supplier)
SELECT point_id, round(sum((CASE WHEN r.row > floor(y) THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN r.col > floor(x) THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * z), 5) AS z
FROM p JOIN ras r ON r.row IN (floor(y), floor(y) + 1) AND r.col IN (floor(x), floor(x) + 1) GROUP BY point_id HAVING count(*) = 4""")
def bilinear_elevation(spark, sf_dir):
    k = F.col("s_suppkey")
    points = b.read(spark, sf_dir, "supplier").select(k.alias("point_id"), ((k % 40) + 0.25).alias("x"), ((k % 3) + 0.75).alias("y"))
    return terrain.bilinear(points, b.part_raster(spark, sf_dir)).select("point_id", F.round("z", 5).alias("z"))


@query("""WITH d AS (SELECT p_partkey AS id, abs(10.0 + p_size) AS lat FROM part)
SELECT id, round(CASE WHEN lat <= 18 THEN 4000.0 WHEN lat <= 30 THEN 4000 + (lat - 18) / 12 * (-900.0) WHEN lat <= 45 THEN 3100 + (lat - 30) / 15 * (-1900.0) ELSE 1200.0 END, 4) AS snow_line FROM d""")
def snow_line_by_latitude(spark, sf_dir):
    """Knots are a stand-in; with a station's table they are a parameter."""
    p = b.read(spark, sf_dir, "part")
    line = interpolate.table(F.abs(10.0 + F.col("p_size")), (18, 30, 45), (4000.0, 3100.0, 1200.0))
    return p.select(F.col("p_partkey").alias("id"), F.round(line, 4).alias("snow_line"))


# Levels fall round by round: a cell takes the lowest of what its neighbours' levels, a thousandth higher, allow over its own ground.
@query(f"""WITH RECURSIVE {b.RASTER}, e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM ras), o(dr, dc) AS (VALUES (0, 0), {", ".join(map(str, terrain.N8))}),
f AS (SELECT 0 AS i, row, col, CASE WHEN row IN (r0, r1) OR col IN (c0, c1) THEN z::FLOAT ELSE 'inf'::FLOAT END AS f FROM ras, e
  UNION ALL SELECT f.i + 1, t.row, t.col, min(CASE WHEN dr = 0 AND dc = 0 THEN f.f ELSE greatest(t.z::FLOAT, (f.f::DOUBLE + 0.001)::FLOAT) END) FROM f JOIN o ON f.i < 150 JOIN ras t ON t.row = f.row + dr AND t.col = f.col + dc GROUP BY f.i, t.row, t.col)
SELECT row // 50 AS grid, row, col, f::DOUBLE AS z FROM f WHERE i = 150""")
def fill_sinks(spark, sf_dir):
    """All parts as one raster, filled in tiles; grid is the tile, fifty rows of fifty parts."""
    filled = terrain.fill_raster(b.part_raster(spark, sf_dir), tile=50)
    return filled.select(F.floor(F.col("row") / 50).alias("grid"), "row", "col", "z")
