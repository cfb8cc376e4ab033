"""Probabilities, reductions, abutments, bridges, breaches and routings over line items, suppliers and daily flows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import river, stats
from ..operators import frequency, hydraulics, routing, stations
from . import bindings as b
from . import hydrology_queries as h
from .registry import query

ERF = "(" * 4 + f"{stats.ERF[0]!r} * t" + "".join(f" + ({c!r})) * t" for c in stats.ERF[1:])


@query(f"""WITH z AS (SELECT s_suppkey AS id, (s_suppkey % 81 - 40)::DOUBLE / 10 AS z FROM supplier), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z / sqrt(2.0))) AS t FROM z),
e AS (SELECT *, 1 - {ERF} * exp(-z / sqrt(2.0) * z / sqrt(2.0)) AS y FROM t)
SELECT id, round(0.5 * (1 + CASE WHEN z >= 0 THEN y ELSE -y END), 8) AS p, round({h.sql_norm_inv("(0.5 * (1 + CASE WHEN z >= 0 THEN y ELSE -y END))")}, 6) AS z FROM e""")
def normal_probabilities(spark, sf_dir):
    """Normal probabilities of standard values, and the values of these."""
    k = F.col("s_suppkey")
    p = stats.norm_cdf((k % 81 - 40) / 10)
    return b.read(spark, sf_dir, "supplier").select(k.alias("id"), F.round(p, 8).alias("p"), F.round(stats.norm_inv(p), 6).alias("z"))


@query("""WITH c AS (SELECT p_partkey AS id, (p_size * p_size * 4)::DOUBLE AS area, p_retailprice / 10 AS p FROM part), f AS (SELECT *, least(1.0, greatest(0.4, 1.1032 - 0.03474 * ln(greatest(1.0, area)))) AS f FROM c)
SELECT id, round(f, 8) AS factor, round(p * f, 6) AS reduced FROM f""")
def areal_reduction(spark, sf_dir):
    """Point rain over basins."""
    area = (F.col("p_size") * F.col("p_size") * 4).cast("double")
    f = river.areal_reduction(area)
    return b.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(f, 8).alias("factor"), F.round(F.col("p_retailprice") / 10 * f, 6).alias("reduced"))


@query(f"""WITH {h.STATIONS}, u AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, station_id) AS k FROM rk WHERE rank <= 8 AND n_years >= 12) SELECT point_id, station_id, n_years, round(km, 4) AS km FROM u WHERE k = 1""")
def first_usable_station(spark, sf_dir):
    """Of the eight nearest stations the first with twelve years; points without one are left out."""
    near = stations.nearest(h.point_table(spark, sf_dir), h.station_table(spark, sf_dir), 8)
    first = stations.first_usable(near, F.col("n_years") >= 12)
    return first.select("point_id", "station_id", "n_years", F.round("km", 4).alias("km"))


_K1, _K2, _FR = "CASE shape WHEN 'vertical' THEN 1.0 WHEN 'wing' THEN 0.82 ELSE 0.55 END", "power(greatest(angle, 1) / 90, 0.13)", "greatest(fr, 0.001)"


@query(f"""WITH {b.CASES}, a AS (SELECT l_orderkey, l_linenumber, h, v / sqrt(9.81 * h) AS fr, a * l_linenumber * 8 AS blocked, ['vertical', 'wing', 'spill'][l_linenumber % 3 + 1] AS shape, (60 + l_linenumber * 10)::DOUBLE AS angle FROM cas WHERE h > 0),
s AS (SELECT *, h * (2.27 * {_K1} * {_K2} * power(greatest(blocked, 0.01) / h, 0.43) * power({_FR}, 0.61) + 1) AS f, 4 * h * ({_K1} / 0.55) * {_K2} * power({_FR}, 0.33) AS hi FROM a)
SELECT l_orderkey, l_linenumber, round(f, 6) AS froehlich, round(hi, 6) AS hire, round(CASE WHEN blocked / h >= 25 THEN hi ELSE f END, 6) AS adopted FROM s""")
def abutment_scour(spark, sf_dir):
    c = b.flow_cases(spark, sf_dir).filter("h > 0")
    n, depth = F.col("l_linenumber"), F.col("h")
    shape = F.element_at(F.array(F.lit("vertical"), F.lit("wing"), F.lit("spill")), (n % 3 + 1).cast("int"))
    s = river.abutment_scour(depth, F.col("v") / F.sqrt(9.81 * depth), F.col("a") * n * 8, shape, (60 + n * 10).cast("double"))
    return c.select("l_orderkey", "l_linenumber", *[F.round(s[x], 6).alias(x) for x in ("froehlich", "hire", "adopted")])


_MID = "((lo + hi) / 2)"
_OVER = f"greatest(0, {_MID} - deck)"
_CARRIED = f"(0.8 * w * 3.0 * sqrt(19.62 * greatest(0, {_MID} - greatest(tail, 11.5))) + 1.7 * 40.0 * power({_OVER}, 1.5) * power(greatest(0, 1 - power(least(1, greatest(0, tail - deck) / CASE WHEN {_OVER} > 0 THEN {_OVER} ELSE 1 END), 1.5)), 0.385))"


@query(f"""WITH RECURSIVE c AS (SELECT s_suppkey AS id, 5.0::DOUBLE + s_suppkey % 12 AS w, 10.0::DOUBLE + (s_suppkey % 7)::DOUBLE / 2 AS tail, 14.2::DOUBLE AS deck, (20 + s_suppkey % 300)::DOUBLE AS q FROM supplier),
r AS (SELECT *, 0 AS i, greatest(tail, 13.0) AS lo, greatest(deck, tail) + 30.0 AS hi FROM c UNION ALL SELECT id, w, tail, deck, q, i + 1, CASE WHEN {_CARRIED} < q THEN {_MID} ELSE lo END, CASE WHEN {_CARRIED} < q THEN hi ELSE {_MID} END FROM r WHERE i < 80)
SELECT id, round({_MID}, 6) AS level FROM r WHERE i = 80""")
def bridge_levels(spark, sf_dir):
    """Upstream level at a bridge per supplier, under pressure and over the deck."""
    k = F.col("s_suppkey")
    level = hydraulics.bridge_level((20 + k % 300).cast("double"), 5.0 + k % 12, F.lit(13.0), F.lit(14.2), F.lit(40.0), F.lit(10.0), 10.0 + (k % 7) / 2)
    return b.read(spark, sf_dir, "supplier").select(k.alias("id"), F.round(level, 6).alias("level"))


@query("""WITH d AS (SELECT s_suppkey AS id, 1e5::DOUBLE + s_suppkey * 1e4 AS v, 5.0::DOUBLE + s_suppkey % 40 AS h FROM supplier),
p AS (SELECT *, 0.607 * power(v, 0.295) * power(h, 1.24) AS peak, 63.2 * sqrt(v / (9.81 * h * h)) AS f0 FROM d),
t AS (SELECT *, 2 * v / peak - f0 AS fall FROM p), u AS (SELECT *, CASE WHEN fall > 0 THEN f0 ELSE v / peak END AS tf, CASE WHEN fall > 0 THEN fall ELSE v / peak END AS td FROM t),
g AS (SELECT *, i, (tf + td) * i / 20 AS t FROM u, range(21) r(i))
SELECT id, i, round(t, 3) AS t, round(CASE WHEN t <= tf THEN peak * t / tf ELSE greatest(0, peak * (1 - (t - tf) / td)) END, 4) AS q FROM g""")
def breach_hydrographs(spark, sf_dir):
    """The flood of each supplier's dam in twenty steps."""
    k = F.col("s_suppkey")
    dams = b.read(spark, sf_dir, "supplier").select(k.alias("id"), (1e5 + k * 1e4).alias("volume"), (5.0 + k % 40).alias("height"), F.lit(None).cast("double").alias("head"), F.lit(False).alias("piping"))
    out = routing.breach_hydrograph(dams, ["id"], 20)
    i = F.row_number().over(Window.partitionBy("id").orderBy("t")) - 1
    return out.select("id", i.cast("bigint").alias("i"), F.round("t", 3).alias("t"), F.round("q", 4).alias("q"))


_DT = 86400.0


def _cunge(x: str) -> str:
    return f"(5.0 / 3 * {x} / (40.0 * power({x} * 0.035 / (40.0 * sqrt(0.001)), 0.6)))"


@query(f"""WITH RECURSIVE {b.FLOW}, m AS (SELECT series, max(q) AS top FROM flow GROUP BY series), k AS (SELECT series, 200000.0 / {_cunge('top')} AS k, 0.5 * (1 - top / (40.0 * 0.001 * {_cunge('top')} * 200000.0)) AS x FROM m),
c AS (SELECT series, (0.5 * {_DT} - k * x) / (k - k * x + 0.5 * {_DT}) AS c0, (0.5 * {_DT} + k * x) / (k - k * x + 0.5 * {_DT}) AS c1, (k - k * x - 0.5 * {_DT}) / (k - k * x + 0.5 * {_DT}) AS c2 FROM k),
s AS (SELECT f.series, step, q, c0, c1, c2, row_number() OVER w AS i, lag(q) OVER w AS before FROM flow f JOIN c USING (series) WINDOW w AS (PARTITION BY f.series ORDER BY step)),
r AS (SELECT series, i, q AS o FROM s WHERE i = 1 UNION ALL SELECT s.series, s.i, c0 * s.q + c1 * s.before + c2 * r.o FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1),
z AS (SELECT s.series, step, q, o FROM r JOIN s ON s.series = r.series AND s.i = r.i),
p AS (SELECT series, max(q) AS pi, max(o) AS po, arg_min(step, (-q, step)) AS si, arg_min(step, (-o, step)) AS so FROM z GROUP BY series)
SELECT series, round(pi, 4) AS peak_in, round(po, 4) AS peak_out, round((pi - po) / pi, 6) AS attenuation, round((so - si) * {_DT} / 3600, 3) AS lag_h FROM p""")
def muskingum_cunge_peaks(spark, sf_dir):
    """Daily flows through 200 km of river, with parameters from each series' largest flow: peaks before and after."""
    routed = routing.muskingum_cunge(b.daily_flow(spark, sf_dir), ["series"], 200_000.0, 0.001, 0.035, 40.0, _DT)
    m = routing.routing_metrics(routed, ["series"], _DT)
    return m.select("series", F.round("peak_in", 4).alias("peak_in"), F.round("peak_out", 4).alias("peak_out"), F.round("attenuation", 6).alias("attenuation"), F.round("lag_h", 3).alias("lag_h"))


@query(f"""WITH {b.SERIES}, t AS (SELECT st, value, 1e5::DOUBLE * (1 + st % 4) AS th FROM ser), a AS (SELECT st, 400.0::DOUBLE AS h, count(*) FILTER (WHERE value > th) AS z, count(*) FILTER (WHERE value <= th) AS l FROM t GROUP BY st),
w AS (SELECT st, log10(greatest(value, 1e-6)) AS v, CASE WHEN value > th THEN 1.0 ELSE (h - z) / l END AS w FROM t JOIN a USING (st)), s AS (SELECT st, sum(w) AS n, sum(w * v) / sum(w) AS m FROM w GROUP BY st)
SELECT st, round(n, 4) AS n_eff, round(m, 7) AS mean_log, round(sqrt(sum(w.w * power(v - m, 2)) / (n - 1)), 7) AS std_log FROM w JOIN s USING (st) GROUP BY st, n, m""")
def historical_moments(spark, sf_dir):
    """Moments of each station's series in 400 periods of which only values over a threshold are known."""
    s = b.series(spark, sf_dir)
    m = frequency.historical_moments(s, ["st"], 1e5 * (1 + F.col("st") % 4), F.lit(400))
    return m.select("st", F.round("n_eff", 4).alias("n_eff"), F.round("mean_log", 7).alias("mean_log"), F.round("std_log", 7).alias("std_log"))
