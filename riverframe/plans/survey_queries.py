"""Survey frames and burnt contours, structures against sections, effective flows of reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import burn, order, structures
from . import bindings as b
from .registry import query

SHARE = 0.004


@query(f"""WITH p AS (SELECT l_linenumber AS survey, l_extendedprice::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY x) - 1 AS rx, row_number() OVER (PARTITION BY survey ORDER BY y) - 1 AS ry, count(*) OVER (PARTITION BY survey) - 1 AS m FROM p)
SELECT survey, max(CASE WHEN rx = floor({SHARE} * m + 0.5) THEN x END) AS min_x, max(CASE WHEN rx = floor({1 - SHARE} * m + 0.5) THEN x END) AS max_x,
  max(CASE WHEN ry = floor({SHARE} * m + 0.5) THEN y END) AS min_y, max(CASE WHEN ry = floor({1 - SHARE} * m + 0.5) THEN y END) AS max_y FROM r GROUP BY survey""")
def robust_box(spark, sf_dir):
    """Line items as points of one survey per line number."""
    points = b.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("survey"), F.col("l_extendedprice").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return order.robust_box(points, ["survey"], SHARE)


STEP, NODES = 8.0, 2500


@query(f"""WITH l AS (SELECT s_nationkey % 5 AS survey, s_nationkey AS line, s_suppkey AS v, (s_suppkey * 37 % 997)::DOUBLE AS x, (s_suppkey * 91 % 509)::DOUBLE AS y, s_acctbal::DOUBLE AS z FROM supplier),
p AS (SELECT c_nationkey % 5 AS survey, c_custkey AS point, (c_custkey * 53 % 997)::DOUBLE AS x, (c_custkey * 17 % 509)::DOUBLE AS y, c_acctbal::DOUBLE AS z FROM customer),
a AS (SELECT survey, x, y FROM l UNION ALL SELECT survey, x, y FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY x) - 1 AS rx, row_number() OVER (PARTITION BY survey ORDER BY y) - 1 AS ry, count(*) OVER (PARTITION BY survey) - 1 AS m FROM a),
bx AS (SELECT survey, max(CASE WHEN rx = floor({SHARE} * m + 0.5) THEN x END) AS x0, max(CASE WHEN rx = floor({1 - SHARE} * m + 0.5) THEN x END) AS x1, max(CASE WHEN ry = floor({SHARE} * m + 0.5) THEN y END) AS y0, max(CASE WHEN ry = floor({1 - SHARE} * m + 0.5) THEN y END) AS y1 FROM r GROUP BY survey),
st AS (SELECT bx.*, min({STEP}::DOUBLE * power(1.3::DOUBLE, i)) AS s FROM bx, range(201) g(i) WHERE ((x1 - x0) / ({STEP}::DOUBLE * power(1.3::DOUBLE, i)) + 1) * ((y1 - y0) / ({STEP}::DOUBLE * power(1.3::DOUBLE, i)) + 1) <= {NODES} GROUP BY ALL),
f0 AS (SELECT *, greatest(2, floor((x1 - x0) / s + 0.5) + 1)::INTEGER AS nx, greatest(2, floor((y1 - y0) / s + 0.5) + 1)::INTEGER AS ny FROM st),
f AS (SELECT survey, x0, y0, nx, ny, CASE WHEN x1 > x0 THEN (x1 - x0) / (nx - 1) ELSE 1 END AS dx, CASE WHEN y1 > y0 THEN (y1 - y0) / (ny - 1) ELSE 1 END AS dy FROM f0),
g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM l WINDOW w AS (PARTITION BY survey, line ORDER BY v)),
n AS (SELECT g.*, f.* EXCLUDE (survey), greatest(1, ceil(sqrt((x2 - x) ** 2 + (y2 - y) ** 2) / least(dx, dy)))::INTEGER AS n FROM g JOIN f USING (survey) WHERE x2 IS NOT NULL),
i AS (SELECT *, unnest(range(n + 1)) AS i FROM n),
s AS (SELECT *, floor((x + i::DOUBLE / n * (x2 - x) - x0) / dx + 0.5)::INTEGER AS col, floor((y + i::DOUBLE / n * (y2 - y) - y0) / dy + 0.5)::INTEGER AS row, z + i::DOUBLE / n * (z2 - z) AS zz FROM i),
h AS (SELECT survey, row, col, zz AS z FROM s WHERE row BETWEEN 0 AND ny - 1 AND col BETWEEN 0 AND nx - 1 QUALIFY row_number() OVER (PARTITION BY survey, row, col ORDER BY line DESC, v DESC, i DESC) = 1),
q AS (SELECT survey, point, floor((x - x0) / dx + 0.5)::INTEGER AS col, floor((y - y0) / dy + 0.5)::INTEGER AS row, z, nx, ny FROM p JOIN f USING (survey)),
o AS (SELECT survey, row, col, z FROM q WHERE row BETWEEN 0 AND ny - 1 AND col BETWEEN 0 AND nx - 1 QUALIFY row_number() OVER (PARTITION BY survey, row, col ORDER BY point) = 1)
SELECT survey, row, col, round(z, 8) AS z FROM h UNION ALL SELECT survey, row, col, round(z, 8) FROM o ANTI JOIN h USING (survey, row, col)""")
def burnt_contours(spark, sf_dir):
    """Suppliers as vertices of a line per nation, customers as points, burnt into five surveys' grids within a budget of nodes."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    lines = b.read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("survey"), F.col("s_nationkey").alias("line"), k.alias("v"), (k * 37 % 997).cast("double").alias("x"), (k * 91 % 509).cast("double").alias("y"), F.col("s_acctbal").cast("double").alias("z"))
    points = b.read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("survey"), c.alias("point"), (c * 53 % 997).cast("double").alias("x"), (c * 17 % 509).cast("double").alias("y"), F.col("c_acctbal").cast("double").alias("z"))
    frames = burn.frame(lines.select("survey", "x", "y").unionByName(points.select("survey", "x", "y")), ["survey"], STEP, NODES)
    return burn.burn(lines, points, frames, ["survey"]).select("survey", "row", "col", F.round("z", 8).alias("z"))


CELL = 10.0

PIERS = """st AS (SELECT s_suppkey AS structure_id, CASE WHEN s_suppkey % 7 = 0 THEN 'deck' ELSE 'pier' END AS kind, s_suppkey * 37 % 100 + 0.37::DOUBLE AS x, s_suppkey * 91 % 60 + 0.21::DOUBLE AS y, (2 + s_suppkey % 4 + CASE WHEN s_suppkey % 7 = 0 THEN 6 ELSE 0 END)::DOUBLE AS h, (2 + s_suppkey % 5)::DOUBLE AS soffit, CASE WHEN s_suppkey % 2 = 0 THEN 1.1::DOUBLE END AS thickness FROM supplier),
ed AS (SELECT structure_id, unnest([{'a': x - h, 'b': y, 'c': x, 'd': y - h}, {'a': x, 'b': y - h, 'c': x + h, 'd': y}, {'a': x + h, 'b': y, 'c': x, 'd': y + h}, {'a': x, 'b': y + h, 'c': x - h, 'd': y}]) AS e FROM st),
sv AS (SELECT n_nationkey AS section_id, v, (v * 25)::DOUBLE AS x, ((n_nationkey * 13 + v * v * 7) % 60)::DOUBLE AS y FROM nation, range(5) r(v)),
sg AS (SELECT section_id, v, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM sv WINDOW w AS (PARTITION BY section_id ORDER BY v)),
sl AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) OVER (PARTITION BY section_id ORDER BY v) AS s1 FROM sg WHERE x2 IS NOT NULL),
m AS (SELECT sl.*, structure_id, (e.c - e.a) * (y1 - e.b) - (e.d - e.b) * (x1 - e.a) AS pa, (e.c - e.a) * (y2 - e.b) - (e.d - e.b) * (x2 - e.a) AS pb, (x2 - x1) * (e.b - y1) - (y2 - y1) * (e.a - x1) AS pc, (x2 - x1) * (e.d - y1) - (y2 - y1) * (e.c - x1) AS pd FROM sl, ed),
hit AS (SELECT section_id, structure_id, s1 - len + pa / (pa - pb) * len AS s FROM m WHERE (pa > 0) <> (pb > 0) AND (pc > 0) <> (pd > 0)
  UNION ALL SELECT section_id, structure_id, 0 FROM sl, st WHERE v = 0 AND abs(x1 - x) + abs(y1 - y) < h),
pr AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS t FROM hit WINDOW w AS (PARTITION BY section_id, structure_id ORDER BY s)),
iv AS (SELECT section_id, structure_id, kind, soffit, thickness, s, coalesce(t, (SELECT max(s1) FROM sl WHERE sl.section_id = pr.section_id)) AS t FROM pr JOIN st USING (structure_id) WHERE k % 2 = 1)"""


@query(f"""WITH {PIERS},
up AS (SELECT *, max(t) OVER (PARTITION BY section_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv WHERE kind = 'pier'),
bl AS (SELECT section_id, sum(greatest(0, t - greatest(s, coalesce(upto, s)))) AS blocked, count(*) FILTER (WHERE upto IS NULL OR s > upto) AS n FROM up GROUP BY 1),
wi AS (SELECT section_id, structure_id, sum(t - s) AS w FROM iv WHERE kind = 'pier' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY round(w, 6) DESC, structure_id) = 1),
de AS (SELECT section_id, min(soffit) AS soffit, max(soffit + coalesce(thickness, 0.8)) AS crest FROM iv WHERE kind = 'deck' GROUP BY 1)
SELECT section_id, round(coalesce(blocked, 0), 5) AS blocked, coalesce(n, 0) AS n_pieces, round(w, 5) AS widest, soffit, round(crest, 5) AS crest,
  round(greatest(0.2 * 100.0, 100.0 - coalesce(blocked, 0)), 5) AS width_left, round(300.0 / greatest(250.0 * greatest(0.2 * 100.0, 100.0 - coalesce(blocked, 0)) / 100.0, 0.001), 6) AS velocity, 4.5 > soffit AS submerged
FROM (SELECT DISTINCT section_id FROM iv) LEFT JOIN bl USING (section_id) LEFT JOIN wi USING (section_id) LEFT JOIN de USING (section_id)""")
def section_obstructions(spark, sf_dir):
    """Suppliers as piers and decks across a section per nation; what is left of 100 m of water."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    x, y, h = k * 37 % 100 + 0.37, k * 91 % 60 + 0.21, (2 + k % 4 + F.when(k % 7 == 0, 6).otherwise(0)).cast("double")
    ring = F.array(F.struct((x - h).alias("lon"), y.alias("lat")), F.struct(x.alias("lon"), (y - h).alias("lat")), F.struct((x + h).alias("lon"), y.alias("lat")), F.struct(x.alias("lon"), (y + h).alias("lat")))
    given = b.read(spark, sf_dir, "supplier").select(k.alias("structure_id"), F.when(k % 7 == 0, "deck").otherwise("pier").alias("kind"), ring.alias("ring"), (2 + k % 5).cast("double").alias("soffit"), F.when(k % 2 == 0, 1.1).alias("thickness"))
    v = F.col("v")
    sections = b.read(spark, sf_dir, "nation").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(n.alias("section_id"), "v", (v * 25).cast("double").alias("x"), ((n * 13 + v * v * 7) % 60).cast("double").alias("y"))
    o = structures.obstructions(sections, given, CELL)
    left = structures.narrowed(F.lit(300.0), F.lit(250.0), F.lit(100.0), F.col("blocked"), F.lit(4.5), F.col("soffit"), F.col("crest"))
    return o.select("section_id", F.round("blocked", 5).alias("blocked"), "n_pieces", F.round("widest", 5).alias("widest"), "soffit", F.round("crest", 5).alias("crest"), F.round(left["width"], 5).alias("width_left"), F.round(left["velocity"], 6).alias("velocity"), left["submerged"].alias("submerged"))


@query("""WITH RECURSIVE j AS (SELECT s_suppkey // 2 AS reach, s_suppkey AS source FROM supplier WHERE s_suppkey > 1 UNION SELECT s_suppkey // 3, s_suppkey FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey % 17 = 0),
c AS (SELECT s_suppkey AS root, s_suppkey AS id FROM supplier UNION SELECT c.root, j.source FROM c JOIN j ON j.reach = c.id),
h AS (SELECT s_suppkey AS id, s_acctbal::DOUBLE AS q FROM supplier WHERE s_suppkey NOT IN (SELECT reach FROM j)),
s AS (SELECT root, sum(q) AS q, count(*) AS n FROM c JOIN h USING (id) GROUP BY root),
y AS (SELECT DISTINCT j.source AS reach FROM j JOIN c ON c.root = j.source AND c.id = j.reach)
SELECT s_suppkey AS reach, round(s.q, 4) AS q, coalesce(n, 0) AS sources, CASE WHEN s_suppkey IN (SELECT reach FROM y) THEN 'cycle' WHEN s_suppkey NOT IN (SELECT reach FROM j) THEN 'own' WHEN n IS NULL THEN 'fed by a cycle' ELSE 'sum' END AS state
FROM supplier LEFT JOIN s ON s.root = s_suppkey""")
def reach_flows(spark, sf_dir):
    """Suppliers as reaches of a net in which every fifth drains two ways and some lead back."""
    k = F.col("s_suppkey")
    s = b.read(spark, sf_dir, "supplier")
    half, third = F.floor(k / 2), F.floor(k / 3)
    joins = s.filter(k > 1).select(half.alias("reach"), k.alias("source")).union(s.filter(k % 5 == 0).select(third, k)).union(s.filter(k % 17 == 0).select(k, half))
    out = structures.effective_flows(s.select(k.alias("reach"), F.col("s_acctbal").cast("double").alias("q")), joins)
    return out.select("reach", F.round("q", 4).alias("q"), "sources", "state")
