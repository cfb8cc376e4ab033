"""Storm hydrographs and design flows by every method at suppliers as points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import river, stats
from ..operators import methods, stations, storms
from . import bindings as b
from . import hydrology_queries as h
from .registry import query

# --- storms ---------------------------------------------------------------------------------------------


def basins(spark, sf_dir):
    k = F.col("s_suppkey")
    return b.read(spark, sf_dir, "supplier").select(
        k.alias("basin"), (5.0 + k % 40).alias("length"), (2.0 + k % 17).alias("to_centroid"), (0.01 + (k % 9) / 100).alias("slope"), (20.0 + k * 7 % 400).alias("area"), (1 + k % 3).alias("zone"), (60.0 + k % 35).alias("cn"),
        (40.0 + k % 80).alias("total"), (6.0 + k % 18).alias("duration_h"), F.element_at(F.array(F.lit("alternating"), F.lit("triangular"), F.lit("uniform")), (k % 3 + 1).cast("int")).alias("pattern"), F.when(k % 2 == 1, 0.5).alias("dt_h"), ((k % 4) / 2).alias("base"),
    )


def by_zone(part: int, x: str) -> str:
    return "CASE zone " + " ".join(f"WHEN {z} THEN {rows[part][0]!r} * power({x}, {rows[part][1]!r})" for z, rows in river.UNIT_ZONES.items()) + " END"


STORM = f"""ba0 AS (SELECT s_suppkey AS basin, 5.0::DOUBLE + s_suppkey % 40 AS length, 2.0::DOUBLE + s_suppkey % 17 AS lg, 0.01::DOUBLE + (s_suppkey % 9)::DOUBLE / 100 AS slope, 20.0::DOUBLE + s_suppkey * 7 % 400 AS area, 1 + s_suppkey % 3 AS zone,
  60.0::DOUBLE + s_suppkey % 35 AS cn, 40.0::DOUBLE + s_suppkey % 80 AS total, 6.0::DOUBLE + s_suppkey % 18 AS dur, ['alternating', 'triangular', 'uniform'][s_suppkey % 3 + 1] AS pattern, CASE WHEN s_suppkey % 2 = 1 THEN 0.5::DOUBLE END AS dt, (s_suppkey % 4)::DOUBLE / 2 AS base FROM supplier),
ba1 AS (SELECT *, {by_zone(0, 'length * lg / sqrt(slope)')} AS tp FROM ba0),
ba AS (SELECT * REPLACE (coalesce(dt, tp / 5.5) AS dt), {by_zone(2, 'tp')} * area / 1000 AS qpa FROM ba1),
bl AS (SELECT *, greatest(1, floor(dur / dt + 0.5))::BIGINT AS n FROM ba),
st0 AS (SELECT *, unnest(range(n)) AS step, (n - 1) // 2 AS mid FROM bl),
st1 AS (SELECT *, CASE WHEN step <= mid THEN 2 * (mid - step) ELSE 2 * (step - mid) - 1 END AS r FROM st0),
st2 AS (SELECT *, CASE pattern WHEN 'alternating' THEN (power(r + 1, 0.3) - power(r, 0.3)) / power(n, 0.3) WHEN 'triangular' THEN greatest(0.01, 1 - abs(step - (n - 1)::DOUBLE / 2) / ((n - 1)::DOUBLE / 2 + 1)) ELSE 1.0 END::DOUBLE AS w FROM st1),
hy AS (SELECT basin, step, dt, cn, total * w / sum(w) OVER (PARTITION BY basin) AS p FROM st2),
ac AS (SELECT *, sum(p) OVER (PARTITION BY basin ORDER BY step) - 0.2 * (25400 / cn - 254) AS o FROM hy),
pa AS (SELECT *, CASE WHEN o > 0 THEN o * o / (o + (25400 / cn - 254)) ELSE 0 END AS acc FROM ac),
pe AS (SELECT basin, step, greatest(0, acc - coalesce(lag(acc) OVER (PARTITION BY basin ORDER BY step), 0)) AS pe FROM pa),
sh(i, a, v) AS (VALUES {", ".join(f"({i}, {a!r}::DOUBLE, {v!r}::DOUBLE)" for i, (a, v) in enumerate(river.UNIT_SHAPE))}),
k AS (SELECT basin, tp, qpa, area, dt, unnest(range(ceil(2.7 * tp / dt)::BIGINT + 1)) AS k FROM ba),
u0 AS (SELECT k.*, CASE WHEN k * dt <= 0 THEN 0.0 WHEN k * dt >= 2.7 * tp THEN 0.0 ELSE x.v * qpa + (k * dt - x.a * tp) / (y.a * tp - x.a * tp) * (y.v * qpa - x.v * qpa) END AS q
  FROM k JOIN sh x ON true JOIN sh y ON y.i = x.i + 1 WHERE CASE WHEN k * dt <= 0 THEN x.i = 0 WHEN k * dt >= 2.7 * tp THEN x.i = 0 ELSE k * dt > x.a * tp AND k * dt <= y.a * tp END),
u AS (SELECT basin, k, q * area * 1000 / (sum(q) OVER (PARTITION BY basin) * dt * 3600) AS u FROM u0),
hg AS (SELECT pe.basin, step + k AS step, sum(pe * u) AS q FROM pe JOIN u ON u.basin = pe.basin GROUP BY 1, 2)"""


@query(f"WITH {STORM} SELECT basin, step, round(step * dt * 3600, 3) AS t_s, round(q + base, 6) AS q FROM hg JOIN ba USING (basin)")
def storm_hydrograph(spark, sf_dir):
    """A design storm over every supplier's basin, with an own step for every second one."""
    q = storms.storm_hydrographs(basins(spark, sf_dir), ["basin"])
    return q.select("basin", "step", F.round("t_s", 3).alias("t_s"), F.round("q", 6).alias("q"))


@query(f"""WITH {STORM}, e AS (SELECT basin, sum(pe) AS pe FROM pe GROUP BY basin)
SELECT basin, round(max(q + base), 6) AS peak, round(sum(q) * dt * 3600 / 1000, 5) AS volume_dam3, true AS exact FROM hg JOIN ba USING (basin) JOIN e USING (basin) GROUP BY basin, dt, area, e.pe""")
def storm_summary(spark, sf_dir):
    """Peak and direct runoff, and whether that is the basin's area times its effective rain to 1e-9."""
    given = basins(spark, sf_dir)
    s = storms.summary(storms.storm_hydrographs(given, ["basin"]), given, ["basin"])
    rain = given.select("basin", "area", river.scs_runoff(F.col("total"), F.col("cn")).alias("pe"))
    exact = F.abs(F.col("volume") - F.col("area") * 1000 * F.col("pe")) <= 1e-9 * F.col("area") * 1000 * F.greatest("pe", F.lit(1.0))
    return s.join(rain, "basin").select("basin", F.round("peak", 6).alias("peak"), F.round(F.col("volume") / 1000, 5).alias("volume_dam3"), exact.alias("exact"))


@query(f"""WITH {b.FLOW}, s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY step) - 1 AS i, q FROM flow),
c AS (SELECT series, (i * i + 3 * i)::DOUBLE / 4 AS t, q FROM s), e AS (SELECT series, max(t) AS e FROM c GROUP BY series),
g AS (SELECT *, lead(t) OVER w AS t2, lead(q) OVER w AS q2 FROM c WINDOW w AS (PARTITION BY series ORDER BY t)),
k AS (SELECT series, e, unnest(range(greatest(2, floor(e / 1.25 + 0.5))::BIGINT + 1)) AS k FROM e)
SELECT k.series, k, k * 1.25::DOUBLE AS t, round(CASE WHEN k * 1.25 >= e OR t2 IS NULL OR k * 1.25 <= g.t THEN g.q ELSE g.q + (k * 1.25 - g.t) / (t2 - g.t) * (q2 - g.q) END, 5) AS q
FROM k JOIN g ON g.series = k.series AND CASE WHEN k * 1.25 >= e THEN t2 IS NULL WHEN k = 0 THEN g.t = 0 ELSE k * 1.25 > g.t AND k * 1.25 <= t2 END""")
def uniform_hydrograph(spark, sf_dir):
    """Daily flows as if at ever wider intervals, at uniform steps."""
    i = F.row_number().over(Window.partitionBy("series").orderBy("step")) - 1
    curves = b.daily_flow(spark, sf_dir).withColumn("i", i).select("series", ((F.col("i") * F.col("i") + 3 * F.col("i")) / 4).alias("t"), "q", F.lit(1.25).alias("dt"))
    return storms.uniform(curves, ["series"], least=2).select("series", F.col("step").cast("bigint").alias("k"), "t", F.round("q", 5).alias("q"))


# --- methods --------------------------------------------------------------------------------------------

CONTROL = "(100.0 + st * 10)"
DEFAULT_ZONE = "Z0"


def points(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    names = b.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    return b.read(spark, sf_dir, "supplier").join(names, "s_nationkey").select(
        k.alias("point_id"), (5.0 + k * 13 % 400).alias("area"), "region", F.when(k % 3 != 0, F.concat(F.lit("Z"), (k % 7).cast("string"))).alias("zone"), F.when(k % 5 == 0, 0.4).alias("c_rational"), F.lit(None).cast("double").alias("c_verni"), (1.0 + k % 6).alias("tc_h"),
        (5.0 + k % 40).alias("length"), (2.0 + k % 17).alias("to_centroid"), F.lit(0.01).alias("slope"), F.when(k % 11 != 0, 75.0).alias("cn"), (1 + k % 3).alias("unit_zone"), F.when(k % 4 != 0, n).alias("station_id"), (100.0 + n * 10).alias("control_area"),
    )


def dictionaries(spark, sf_dir):
    """Stand-ins for regional tables, with gaps: nations as regions, zones Z0 to Z5."""
    n, k = b.read(spark, sf_dir, "nation"), F.col("n_nationkey")
    region = F.col("n_name").alias("region")
    zone = spark.createDataFrame([(f"Z{i}", f"L{i % 3}", 1.2 + i / 10) for i in range(6)], "zone string, law string, alpha double")
    curves = spark.createDataFrame([(f"Z{i}", float(t), r * (1 + i / 20)) for i in range(5) for t, r in zip(h.CURVE_T, h.CURVE)], "zone string, t double, ratio double")
    laws = spark.createDataFrame([("L0", 2e-3, 0.973, 1.224), ("L1", 1e-3, 1.022, 1.3)], "law string, k double, exp_area double, exp_rain double")
    return {
        "rational": n.filter("n_regionkey <> 2").select(region, (0.3 + k / 100).alias("c10")), "verni": n.filter("n_regionkey <> 3").select(region, (0.02 + k / 1000).alias("c10")),
        "default_zones": n.filter("n_regionkey <> 1").select(region, F.concat(F.lit("Z"), (k % 6).cast("string")).alias("zone")), "zones": zone, "curves": curves, "laws": laws,
    }


def _override(spark, sf_dir):
    k = F.col("n_nationkey")
    return b.read(spark, sf_dir, "nation").select(k.alias("st"), F.when(k % 3 == 0, "lognormal").when(k % 7 == 1, "unheard of").when(k % 7 == 2, "auto").alias("dist"))


FITTED = ("normal", "gumbel", "lognormal")
CHOSEN = f"""bes AS (SELECT st, dist FROM ({h._chi2_sql()}) z QUALIFY row_number() OVER (PARTITION BY st ORDER BY accepted DESC, x2, CASE dist WHEN 'normal' THEN 1 ELSE 2 END) = 1),
cho AS (SELECT st, CASE WHEN st % 3 = 0 THEN 'lognormal' ELSE dist END AS dist, st % 3 = 0 AS chosen FROM bes)"""


def chosen(spark, sf_dir):
    best = h.best_distribution(spark, sf_dir)
    fitted = best.select("st", F.explode(F.array(*[F.lit(d) for d in FITTED])).alias("dist"))
    return methods.chosen_distribution(fitted, best, _override(spark, sf_dir), ["st"])


@query(f"WITH {CHOSEN} SELECT st, dist, chosen FROM cho")
def chosen_distribution(spark, sf_dir):
    return chosen(spark, sf_dir)


def all_methods(spark, sf_dir):
    given = points(spark, sf_dir)
    q = h.quantiles(spark, sf_dir, FITTED).withColumn("t", F.col("t").cast("double"))
    flows = q.join(chosen(spark, sf_dir), ["st", "dist"]).select(F.col("st").alias("station_id"), "t", (F.col("q") / 1000).alias("q"))
    donors = stations.nearest(h.point_table(spark, sf_dir), h.station_table(spark, sf_dir), 3).select("point_id", "station_id", "km", (100.0 + F.col("station_id") * 10).alias("control_area"))
    p24 = h.quantiles(spark, sf_dir, ("gumbel",)).select(F.col("st").alias("s_nationkey"), F.col("t").cast("double").alias("t"), (F.col("q") / 5000 * 1.10).alias("p24"))
    rain = b.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), "s_nationkey").join(p24, "s_nationkey").select("point_id", "t", "p24")
    by_rain = methods.rain_methods(given, rain, dictionaries(spark, sf_dir), h.FACTOR_T, h.FACTOR, DEFAULT_ZONE)
    by_flow = methods.flow_methods(given, flows, donors, [float(t) for t in h.PERIODS], F.lit(1.5))
    return by_rain.unionByName(by_flow)


def _sql_methods() -> str:
    zones = ", ".join(f"('Z{i}', 'L{i % 3}', {1.2 + i / 10!r}::DOUBLE, {i})" for i in range(6))
    ratio = f"(CASE WHEN __z.i < 5 THEN {h.sql_log_table('t', h.CURVE_T, h.CURVE, True)} * (1 + __z.i::DOUBLE / 20) END)"
    fra = "least(1.0, greatest(0.4, 1.1032 - 0.03474 * ln(greatest(1.0, area))))"
    unit = by_zone(2, f"({by_zone(0, 'length * lg / sqrt(0.01)')})")
    return f"""WITH {h.STATIONS}, {b.MOMENTS}, {h.sql_quantiles(FITTED)}, {CHOSEN},
    fl AS (SELECT qu.st, t, q / 1000 AS q FROM qu JOIN cho ON cho.st = qu.st AND cho.dist = qu.dist),
    gu AS (SELECT st, t, q / 5000 * 1.10 AS p24 FROM qu WHERE dist = 'gumbel'),
    po AS (SELECT s_suppkey AS point_id, 5.0::DOUBLE + s_suppkey * 13 % 400 AS area, n_nationkey AS st, n_regionkey AS rk, CASE WHEN s_suppkey % 3 <> 0 THEN 'Z' || (s_suppkey % 7) END AS zone_given, CASE WHEN s_suppkey % 5 = 0 THEN 0.4 WHEN n_regionkey <> 2 THEN 0.3::DOUBLE + n_nationkey::DOUBLE / 100 END AS c_r,
      CASE WHEN n_regionkey <> 3 THEN 0.02::DOUBLE + n_nationkey::DOUBLE / 1000 END AS c_v, 1.0::DOUBLE + s_suppkey % 6 AS tc, 5.0::DOUBLE + s_suppkey % 40 AS length, 2.0::DOUBLE + s_suppkey % 17 AS lg, s_suppkey % 11 <> 0 AS has_cn, 1 + s_suppkey % 3 AS zone, s_suppkey % 4 <> 0 AS has_station, 100.0::DOUBLE + n_nationkey * 10 AS control FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    zn(zone, law, alpha, i) AS (VALUES {zones}),
    pz AS (SELECT *, coalesce(zone_given, CASE WHEN rk <> 1 THEN 'Z' || (st % 6) END, '{DEFAULT_ZONE}') AS zn FROM po),
    ra AS (SELECT pz.*, gu.t, gu.p24 * {fra} AS p, g10.p24 * {fra} AS p10 FROM pz JOIN gu USING (st) JOIN gu g10 ON g10.st = pz.st AND g10.t = 10),
    rm AS (
      SELECT point_id, t, 'unit_hydrograph' AS method, area >= 10 AND area <= 4500 AND has_cn AS applies, CASE WHEN has_cn THEN {unit} * area / 1000 * CASE WHEN p - 0.2 * (25400.0 / 75 - 254) > 0 THEN power(p - 0.2 * (25400.0 / 75 - 254), 2) / (p + 0.8 * (25400.0 / 75 - 254)) ELSE 0 END END AS q,
        CASE WHEN NOT has_cn THEN 'no basin measures' END AS reason, false AS extrapolated FROM ra
      UNION ALL SELECT point_id, t, 'rational', area < 25 AND c_r IS NOT NULL, c_r * {h.sql_log_table('t', h.FACTOR_T, h.FACTOR)} * (p / 24 * sqrt(24 / tc)) * area / 3.6, CASE WHEN c_r IS NULL THEN 'no coefficient' END, false FROM ra
      UNION ALL SELECT point_id, t, 'verni_king', area >= 10 AND area <= 10000 AND c_v IS NOT NULL, c_v * {h.sql_log_table('t', h.FACTOR_T, h.FACTOR)} * 0.00618 * power(area, 0.88) * power(p, 1.24), CASE WHEN c_v IS NULL THEN 'no coefficient' END, false FROM ra
      UNION ALL SELECT point_id, t, 'zone_curve', area > 20 AND __z.law IN ('L0', 'L1') AND __z.i < 5, CASE __z.law WHEN 'L0' THEN 2e-3 * power(area, 0.973) * power(p10, 1.224) WHEN 'L1' THEN 1e-3 * power(area, 1.022) * power(p10, 1.3) END * {ratio} * __z.alpha,
        CASE WHEN __z.zone IS NULL THEN 'no zone' WHEN __z.law = 'L2' THEN 'no law' WHEN __z.i = 5 THEN 'no curve' END, coalesce(__z.i < 5 AND t > 100, false) FROM ra LEFT JOIN zn __z ON __z.zone = ra.zn),
    don AS (SELECT point_id, station_id, 1 / greatest(km, 1.0) AS w FROM rk WHERE rank <= 3),
    reg AS (SELECT don.point_id, t, sum(w * q * power(area / (100.0 + station_id * 10), 0.88)) / sum(w) AS q FROM don JOIN po USING (point_id) JOIN fl ON fl.st = station_id GROUP BY 1, 2),
    fm AS (
      SELECT point_id, t, 'direct' AS method, has_station AS applies, CASE WHEN has_station THEN q * 1.5 END AS q, CASE WHEN NOT has_station THEN 'no station' END AS reason, false AS extrapolated FROM po JOIN fl USING (st)
      UNION ALL SELECT point_id, t, 'transposition', has_station, CASE WHEN has_station THEN q * power(area / control, 0.88) END, CASE WHEN NOT has_station THEN 'no station' END, false FROM po JOIN fl USING (st)
      UNION ALL SELECT po.point_id, fl.t, 'regional', reg.q IS NOT NULL, reg.q, CASE WHEN reg.q IS NULL THEN 'no donors' END, false FROM po JOIN fl USING (st) LEFT JOIN reg ON reg.point_id = po.point_id AND reg.t = fl.t),
    am AS (SELECT * FROM rm UNION ALL SELECT * FROM fm)"""


@query(f"{_sql_methods()} SELECT point_id, t, method, coalesce(applies, false) AS applies, round(q, 4) AS q, reason, extrapolated FROM am")
def design_flow_methods(spark, sf_dir):
    """Seven methods for every supplier and return period, with what each lacks."""
    return all_methods(spark, sf_dir).withColumn("q", F.round("q", 4))


ORDER = "CASE method " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(methods.METHODS)) + " END"


@query(f"""{_sql_methods()}, ch AS (SELECT s_suppkey AS point_id, CASE s_suppkey % 5 WHEN 0 THEN 'rational' WHEN 1 THEN 'zone_curve' WHEN 2 THEN 'sorcery' END AS choice, s_suppkey % 2 = 0 AS arid FROM supplier),
r AS (SELECT am.*, choice, row_number() OVER (PARTITION BY point_id, t ORDER BY coalesce(method = choice, false) DESC, CASE WHEN choice IS NULL AND arid AND method IN ('direct', 'transposition') AND q IS NOT NULL THEN {ORDER} ELSE 99 END,
  (coalesce(applies, false) AND q IS NOT NULL) DESC, q DESC NULLS LAST, {ORDER}) AS r FROM am JOIN ch USING (point_id))
SELECT point_id, t, CASE WHEN method <> choice THEN choice ELSE method END AS method, CASE WHEN coalesce(method = choice, true) THEN round(q, 4) END AS q, CASE WHEN method <> choice THEN 'unknown method' ELSE reason END AS reason,
  CASE WHEN choice IS NULL THEN 'adopted' ELSE 'chosen' END AS how FROM r WHERE r = 1""")
def selected_flow(spark, sf_dir):
    """Each supplier's chosen method, among them one that does not exist, or the adopted one."""
    k = F.col("s_suppkey")
    choice = b.read(spark, sf_dir, "supplier").select(k.alias("point_id"), F.when(k % 5 == 0, "rational").when(k % 5 == 1, "zone_curve").when(k % 5 == 2, "sorcery").alias("method"), (k % 2 == 0).alias("arid"))
    return methods.select_method(all_methods(spark, sf_dir), choice, F.col("arid")).withColumn("q", F.round("q", 4))
