"""Triangulations, rasters, outlines, basins and projections over parts, suppliers and nations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, river
from ..operators import channels, geometry, terrain
from ..tables import cut
from . import bindings as b
from .channel_queries import BASIN, CELL, FLOW
from .flow_queries import by_zone
from .registry import query

# A triangle per supplier: a corner and two others up to a dozen units away, with heights.
TRIANGLES = """tri AS (SELECT s_suppkey AS tri, s_nationkey AS mesh, (s_suppkey * 37 % 97)::DOUBLE AS x1, (s_suppkey * 91 % 59)::DOUBLE AS y1, (s_suppkey * 37 % 97 + 3 + s_suppkey % 9)::DOUBLE AS x2, (s_suppkey * 91 % 59 + s_suppkey % 4)::DOUBLE AS y2,
  (s_suppkey * 37 % 97 + s_suppkey % 5)::DOUBLE AS x3, (s_suppkey * 91 % 59 + 4 + s_suppkey % 7)::DOUBLE AS y3, (s_suppkey % 50)::DOUBLE AS z1, (s_suppkey % 31)::DOUBLE AS z2, (s_suppkey % 17)::DOUBLE AS z3,
  s_suppkey % 200 AS n1, 200 + s_suppkey % 150 AS n2, 350 + s_suppkey * 7 % 130 AS n3, 1.0::DOUBLE + s_suppkey % 7 AS area, s_acctbal::DOUBLE AS h FROM supplier)"""
BARY = "((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3))"


def triangles(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y, d = k * 37 % 97, k * 91 % 59, lambda c, n: c.cast("double").alias(n)
    return b.read(spark, sf_dir, "supplier").select(
        k.alias("tri"), F.col("s_nationkey").alias("mesh"), d(x, "x1"), d(y, "y1"), d(x + 3 + k % 9, "x2"), d(y + k % 4, "y2"), d(x + k % 5, "x3"), d(y + 4 + k % 7, "y3"), d(k % 50, "z1"), d(k % 31, "z2"), d(k % 17, "z3"),
        (k % 200).alias("n1"), (200 + k % 150).alias("n2"), (350 + k * 7 % 130).alias("n3"), (1.0 + k % 7).alias("area"), F.col("s_acctbal").cast("double").alias("h"),
    )


@query(f"""WITH {TRIANGLES}, c AS (SELECT tri.*, unnest(range(floor(least(y1, y2, y3))::BIGINT, floor(greatest(y1, y2, y3))::BIGINT + 1)) AS row FROM tri), g AS (SELECT c.*, unnest(range(floor(least(x1, x2, x3))::BIGINT, floor(greatest(x1, x2, x3))::BIGINT + 1)) AS col FROM c),
w AS (SELECT *, ((y2 - y3) * (col + 0.5 - x3) + (x3 - x2) * (row + 0.5 - y3)) / {BARY} AS a, ((y3 - y1) * (col + 0.5 - x3) + (x1 - x3) * (row + 0.5 - y3)) / {BARY} AS b FROM g WHERE {BARY} <> 0)
SELECT mesh, row::INTEGER AS row, col::INTEGER AS col, round(a * z1 + b * z2 + (1 - a - b) * z3, 6) AS z FROM w WHERE a >= -1e-6 AND b >= -1e-6 AND 1 - a - b >= -1e-6 QUALIFY row_number() OVER (PARTITION BY mesh, row, col ORDER BY tri DESC) = 1""")
def tin_grid(spark, sf_dir):
    """Heights of unit cells under each nation's triangles."""
    return geometry.rasterize_tin(triangles(spark, sf_dir), ["mesh"], 0.0, 0.0, 1.0).withColumn("z", F.round("z", 6))


@query(f"""WITH {TRIANGLES}, p AS (SELECT c_custkey AS point_id, (c_custkey * 53 % 9973)::DOUBLE / 100 AS x, (c_custkey * 17 % 6007)::DOUBLE / 100 AS y FROM customer),
w AS (SELECT point_id, tri, ((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / {BARY} AS a, ((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / {BARY} AS b FROM p JOIN tri ON x BETWEEN least(x1, x2, x3) - 1 AND greatest(x1, x2, x3) + 1 AND y BETWEEN least(y1, y2, y3) - 1 AND greatest(y1, y2, y3) + 1 WHERE {BARY} <> 0
  AND floor(x / 4) BETWEEN floor(least(x1, x2, x3) / 4) AND floor(greatest(x1, x2, x3) / 4) AND floor(y / 4) BETWEEN floor(least(y1, y2, y3) / 4) AND floor(greatest(y1, y2, y3) / 4))
SELECT point_id, tri, round(a, 6) AS a, round(b, 6) AS b, round(1 - a - b, 6) AS c FROM w WHERE least(a, b, 1 - a - b) >= -1e-3 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY tri) = 1""")
def located_points(spark, sf_dir):
    """Customers as points in suppliers' triangles, with their weights."""
    k = F.col("c_custkey")
    points = b.read(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 53 % 9973 / 100).alias("x"), (k * 17 % 6007 / 100).alias("y"))
    return geometry.locate(points, triangles(spark, sf_dir), 4.0).select("point_id", "tri", *[F.round(c, 6).alias(c) for c in "abc"])


@query(f"""WITH {TRIANGLES}, e AS (SELECT tri, unnest([{{'a': n1, 'b': n2}}, {{'a': n2, 'b': n3}}, {{'a': n1, 'b': n3}}]) AS e FROM tri)
SELECT e.a AS a, e.b AS b, min(tri) AS "left", CASE WHEN max(tri) <> min(tri) THEN max(tri) END AS "right" FROM e GROUP BY 1, 2""")
def mesh_edges(spark, sf_dir):
    return geometry.mesh_edges(triangles(spark, sf_dir))


@query(f"WITH {TRIANGLES}, n AS (SELECT unnest([n1, n2, n3]) AS node, h, area FROM tri) SELECT node, round(sum(h * area) / sum(area), 4) AS h FROM n GROUP BY node")
def node_means(spark, sf_dir):
    """A field on triangles at their nodes."""
    t = triangles(spark, sf_dir)
    return geometry.cells_to_nodes(t.select("tri", "h"), t, "h").withColumn("h", F.round("h", 4))


@query(f"""WITH p AS (SELECT s_suppkey AS section_id, -70.0 + (s_suppkey % 13) * 0.37 AS lon, -30.0 - (s_suppkey % 97) * 0.1 AS lat, (s_suppkey * 29 % 360)::DOUBLE AS bearing FROM supplier),
r AS (SELECT *, i, 200.0::DOUBLE * i / 8 AS s FROM p, range(9) g(i))
SELECT section_id, i::INTEGER AS i, round(s, 4) AS s, round(lon + (s - 100) * sin(radians(bearing + 90)) / ({geo.LON_M} * cos(radians(lat))), 9) AS lon, round(lat + (s - 100) * cos(radians(bearing + 90)) / {geo.LAT_M}, 9) AS lat FROM r""")
def cross_sections(spark, sf_dir):
    """Nine points across the bearing of every supplier."""
    k = F.col("s_suppkey")
    points = b.read(spark, sf_dir, "supplier").select(k.alias("section_id"), (-70.0 + (k % 13) * 0.37).alias("lon"), (-30.0 - (k % 97) * 0.1).alias("lat"), (k * 29 % 360).cast("double").alias("bearing"))
    out = geometry.cross_line(points, 200.0, 9)
    return out.select("section_id", "i", F.round("s", 4).alias("s"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(f"""WITH {b.VALLEY}, m AS (SELECT row, col FROM ras WHERE z < 2.0 * row + 25),
s(dr, dc, a, b, c, d) AS (VALUES (-1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 1, 1, 0, 1))
SELECT row + a AS r1, col + b AS c1, row + c AS r2, col + d AS c2 FROM m, s WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.row = m.row + dr AND x.col = m.col + dc)""")
def outline_edges(spark, sf_dir):
    """Sides of the valley's floor that have none of it beyond them."""
    return geometry.boundary_edges(b.valley(spark, sf_dir).filter(F.col("z") < 2.0 * F.col("row") + 25).select("row", "col"))


@query(f"""WITH RECURSIVE {FLOW}, {b.SUPPLIER_CELLS},
w AS (SELECT point_id, a.row, a.col, a.acc, (a.row - pts.row) ** 2 + (a.col - pts.col) ** 2 AS d2 FROM pts JOIN acc a ON abs(a.row - pts.row) <= 3 AND abs(a.col - pts.col) <= 3)
SELECT point_id, row, col FROM w QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (acc >= 6) DESC, CASE WHEN acc >= 6 THEN d2 ELSE -acc END, row, col) = 1""")
def snapped_outlets(spark, sf_dir):
    """Suppliers' cells moved to the nearest channel of six cells within three, or to the largest."""
    acc = terrain.accumulate(terrain.flow_directions(b.valley(spark, sf_dir)))
    return terrain.snap_outlet(acc, b.supplier_cells(spark, sf_dir), 3, 6)


@query(f"""WITH RECURSIVE {FLOW} SELECT d.row, d.col, d.tr AS to_row, d.tc AS to_col, a.acc FROM dir d JOIN acc a ON a.row = d.row AND a.col = d.col JOIN acc t ON t.row = d.tr AND t.col = d.tc WHERE a.acc >= 5 AND t.acc >= 5""")
def drainage_network(spark, sf_dir):
    directions = cut(terrain.flow_directions(b.valley(spark, sf_dir)))
    return terrain.drainage(terrain.accumulate(directions), directions, 5)


@query(f"""WITH RECURSIVE {FLOW}, {b.SUPPLIER_CELLS}, {BASIN},
x AS (SELECT point_id, bas.row, bas.col, z FROM bas JOIN ras ON ras.row = bas.row AND ras.col = bas.col),
s(dr, dc) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
pe AS (SELECT x.point_id, (count(*) * {CELL} / 1000)::DOUBLE AS per FROM x, s WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.point_id = x.point_id AND y.row = x.row + dr AND y.col = x.col + dc) GROUP BY 1),
a AS (SELECT point_id, (count(*) * {CELL * CELL / 1e6})::DOUBLE AS area, max(z) - min(z) AS relief, avg(row) AS row, avg(col) AS col FROM x GROUP BY 1)
SELECT point_id, round(area, 6) AS area_km2, round(relief, 5) AS relief_m, round(row, 6) AS row, round(col, 6) AS col, round(per, 5) AS perimeter_km, round(0.28 * per / sqrt(area), 5) AS compactness FROM a JOIN pe USING (point_id)""")
def basin_morphometry(spark, sf_dir):
    """Measures of each supplier's basin."""
    ground = cut(b.valley(spark, sf_dir)).withColumns({"r": F.col("row"), "c": F.col("col")})
    totals = channels.basin_totals(cut(terrain.flow_directions(ground)), b.supplier_cells(spark, sf_dir), ground, ["r", "c"], ["z"], ["z"], sides=True)
    m = channels.morphometry_of(totals, CELL)
    return m.select("point_id", F.round("area_km2", 6).alias("area_km2"), F.round("relief_m", 5).alias("relief_m"), F.round("row", 6).alias("row"), F.round("col", 6).alias("col"), F.round("perimeter_km", 5).alias("perimeter_km"), F.round("compactness", 5).alias("compactness"))


@query(f"""WITH p AS (SELECT s_suppkey AS id, -80.0::DOUBLE + (s_suppkey * 7 % 160) AS lat, -179.0::DOUBLE + (s_suppkey * 11 % 358) AS lon, 4 + s_suppkey % 12 AS zoom FROM supplier),
m AS (SELECT *, (lon + 180) / 360 * power(2.0, zoom) AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / {math.pi!r}) / 2 * power(2.0, zoom) AS y FROM p)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(x / power(2.0, zoom) * 360 - 180, 8) AS lon, round(degrees(atan(sinh({math.pi!r} * (1 - 2 * y / power(2.0, zoom))))), 8) AS lat FROM m""")
def web_mercator(spark, sf_dir):
    """Tiles of points and back."""
    k = F.col("s_suppkey")
    p = b.read(spark, sf_dir, "supplier").select(k.alias("id"), (-80.0 + k * 7 % 160).alias("lat"), (-179.0 + k * 11 % 358).alias("lon"), (4 + k % 12).alias("zoom"))
    m = p.select("id", "zoom", geo.mercator_x(F.col("lon"), F.col("zoom")).alias("x"), geo.mercator_y(F.col("lat"), F.col("zoom")).alias("y"))
    return m.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(geo.mercator_lon(F.col("x"), F.col("zoom")), 8).alias("lon"), F.round(geo.mercator_lat(F.col("y"), F.col("zoom")), 8).alias("lat"))


@query(f"""WITH p AS (SELECT p_partkey AS id, 1.0::DOUBLE + p_size AS l, 0.5::DOUBLE + p_size / 3.0 AS lg, 0.001::DOUBLE + p_retailprice / 100000 AS s, (10 + p_size * 5)::DOUBLE AS a, 1 + p_partkey % 3 AS zone FROM part), t AS (SELECT *, {by_zone(0, 'l * lg / sqrt(s)')} AS tp FROM p)
SELECT id, round(tp, 6) AS tp, round(tp / 5.5, 6) AS tu, round({by_zone(1, 'tp')}, 5) AS tb, round({by_zone(2, 'tp')}, 6) AS qp, round({by_zone(2, 'tp')} * a / 1000, 6) AS qpa FROM t""")
def unit_hydrograph_parameters(spark, sf_dir):
    size, price, k = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    h = river.unit_hydrograph(1.0 + size, 0.5 + size / 3.0, 0.001 + price / 100000, (10 + size * 5).cast("double"), 1 + k % 3)
    return b.read(spark, sf_dir, "part").select(k.alias("id"), *[F.round(h[c], n).alias(c) for c, n in (("tp", 6), ("tu", 6), ("tb", 5), ("qp", 6), ("qpa", 6))])
