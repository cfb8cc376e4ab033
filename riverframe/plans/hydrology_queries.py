"""Series, frequency analysis, stations, rain, flows, hydrographs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, interpolate, river, stats
from ..operators import frequency, routing, stations
from . import bindings as b
from .registry import query

CLOSED = ("normal", "lognormal", "pearson3", "logpearson3", "gumbel")
PERIODS = (2, 5, 10, 25, 50, 100, 200)


def _horner(c, x):
    out = repr(c[0])
    for k in c[1:]:
        out = f"({out} * {x} + ({k!r}))"
    return out


def sql_norm_inv(p: str) -> str:
    lo, hi, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    tail = lambda q: f"({_horner(stats.ACKLAM_C, q)} / {_horner((*stats.ACKLAM_D, 1.0), q)})"
    r = f"({mid} * {mid})"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(lo)} WHEN {p} <= {1 - 0.02425!r} THEN {_horner(stats.ACKLAM_A, r)} * {mid} / {_horner((*stats.ACKLAM_B, 1.0), r)} ELSE -{tail(hi)} END)"


def sql_table(x: str, xs, ys) -> str:
    out = f"CASE WHEN {x} <= {xs[0]} THEN {ys[0]!r}"
    for i in range(len(xs) - 1):
        out += f" WHEN {x} <= {xs[i + 1]} THEN {float(ys[i])!r} + ({x} - {float(xs[i])!r}) / {float(xs[i + 1] - xs[i])!r} * {float(ys[i + 1] - ys[i])!r}"
    return f"({out} ELSE {ys[-1]!r} END)"


def sql_quantile(dist: str, p: str) -> str:
    z = sql_norm_inv(p)
    k = lambda s: f"(CASE WHEN abs({s}) < 1e-6 THEN {z} ELSE (2 / {s}) * (power(({z} - {s} / 6) * ({s} / 6) + 1, 3) - 1) END)"
    return {
        "normal": f"mean + {z} * std",
        "lognormal": f"exp(mean_ln + {z} * std_ln)",
        "pearson3": f"mean + {k('skew')} * std",
        "logpearson3": f"power(10.0, mean_log + {k('skew_log')} * std_log)",
        "gumbel": f"mean + std * (-ln(-ln({p})) - {sql_table('n', stats.GUMBEL_N, stats.GUMBEL_YN)}) / {sql_table('n', stats.GUMBEL_N, stats.GUMBEL_SN)}",
    }[dist]


def sql_quantiles(dists=CLOSED, periods=PERIODS) -> str:
    ts = ", ".join(f"({float(t)!r}::DOUBLE)" for t in periods)
    parts = [f"SELECT st, t, '{d}' AS dist, {sql_quantile(d, '(1 - 1 / t)')} AS q FROM mo, ts" for d in dists]
    return f"ts AS (SELECT t FROM (VALUES {ts}) v(t)), qu AS (" + " UNION ALL ".join(parts) + ")"


WITH = f"WITH {b.SERIES}, {b.MOMENTS}"


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.moments(b.series(spark, sf_dir), ["st"])


def quantiles(spark: SparkSession, sf_dir: str, dists=CLOSED, periods=PERIODS) -> DataFrame:
    return frequency.quantiles(fits(spark, sf_dir), ["st"], periods, dists)


@query(f"WITH {b.SERIES} SELECT st, period, value FROM ser")
def period_max_series(spark, sf_dir):
    return b.series(spark, sf_dir)


@query(f"{WITH} SELECT st, n, round(mean, 5) AS mean, round(std, 5) AS std, round(skew, 6) AS skew FROM mo")
def series_moments(spark, sf_dir):
    return fits(spark, sf_dir).select("st", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round("skew", 6).alias("skew"))


@query(f"{WITH} SELECT st, round(mean_ln, 6) AS mean_ln, round(std_ln, 6) AS std_ln, round(mean_log, 6) AS mean_log, round(std_log, 6) AS std_log, round(skew_log, 6) AS skew_log FROM mo")
def log_moments(spark, sf_dir):
    return fits(spark, sf_dir).select("st", *[F.round(c, 6).alias(c) for c in ("mean_ln", "std_ln", "mean_log", "std_log", "skew_log")])


@query(f"{WITH}, {sql_quantiles()} SELECT st, t, dist, round(q / 1000, 4) AS q_thousands FROM qu")
def quantiles_5dist(spark, sf_dir):
    return quantiles(spark, sf_dir).select("st", "t", "dist", F.round(F.col("q") / 1000, 4).alias("q_thousands"))


@query(f"WITH {b.SERIES} SELECT st, period, (row_number() OVER w)::INTEGER AS rank, round((row_number() OVER w)::DOUBLE / (count(*) OVER (PARTITION BY st) + 1), 9) AS p, round((count(*) OVER (PARTITION BY st) + 1)::DOUBLE / row_number() OVER w, 9) AS t_emp FROM ser WINDOW w AS (PARTITION BY st ORDER BY value DESC, period)")
def weibull_positions(spark, sf_dir):
    return frequency.weibull(b.series(spark, sf_dir), ["st"], ["period"]).select("st", "period", "rank", F.round("p", 9).alias("p"), F.round("t_emp", 9).alias("t_emp"))


def _r2_sql() -> str:
    parts = [f"SELECT st, '{d}' AS dist, value, mean, {sql_quantile(d, 'pp')} AS est FROM pos" for d in CLOSED]
    return f"""{WITH}, pos AS (SELECT ser.st, value, mo.*, 1 - 1 / (1 / (1 - (row_number() OVER (PARTITION BY ser.st ORDER BY value, period))::DOUBLE / (n + 1))) AS pp FROM ser JOIN mo ON ser.st = mo.st),
    e AS ({" UNION ALL ".join(parts).replace("SELECT st,", "SELECT st,")})
    SELECT st, dist, round(1 - sum(power(value - est, 2)) / sum(power(value - mean, 2)), 6) AS r2 FROM e GROUP BY st, dist"""


@query(_r2_sql().replace("SELECT ser.st, value, mo.*,", "SELECT mo.*, value,"))
def r2_fit(spark, sf_dir):
    s = b.series(spark, sf_dir)
    return frequency.r_squared(s, fits(spark, sf_dir), ["st"], CLOSED, ["period"]).withColumn("r2", F.round("r2", 6))


@query(f"""WITH {b.SERIES}, m AS (SELECT st, count(*) AS n, avg(log10(value)) AS m, stddev_samp(log10(value)) AS s FROM ser WHERE value > 0 GROUP BY st),
k AS (SELECT *, -3.62201 + 6.28446 * power(n, 0.25) - 2.49835 * sqrt(n) + 0.491436 * power(n, 0.75) - 0.037911 * n AS kn FROM m WHERE n >= 4),
l AS (SELECT st, power(10, m + kn * s) AS high, power(10, m - kn * s) AS low FROM k)
SELECT ser.st, round(high, 2) AS high, round(low, 2) AS low, count(*) FILTER (WHERE value > high) AS n_high, count(*) FILTER (WHERE value > 0 AND value < low) AS n_low
FROM ser JOIN l ON ser.st = l.st GROUP BY ALL""")
def grubbs_beck_flags(spark, sf_dir):
    g = frequency.grubbs_beck(b.series(spark, sf_dir), ["st"])
    return g.groupBy("st", F.round("high", 2).alias("high"), F.round("low", 2).alias("low")).agg(F.count(F.when(F.col("is_high"), 1)).alias("n_high"), F.count(F.when(F.col("is_low"), 1)).alias("n_low"))


def _gamma_halves(rows: str, steps: int, terms: int) -> str:
    """A recursion that halves the interval of each gamma quantile; the regularised function is the sum of its series, term by term."""
    return f"""SELECT st, t, power(mean / std, 2) AS s, std * std / mean AS scale, 1 - 1 / t AS p, 0.0::DOUBLE AS lo, power(mean / std, 2) + 15 * mean / std + 60 AS hi, 0 AS i FROM {rows}
  UNION ALL SELECT st, t, s, scale, p, CASE WHEN c < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < p THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(range({terms}), lambda k: exp((s + k) * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(s + k + 1)))) AS c FROM {"g" if terms > 1000 else "gah"} WHERE i < {steps})"""


def _chi2_sql(dists=("normal", "gumbel")) -> str:
    used = " ".join(f"WHEN dist = '{d}' THEN {n}" for d, n in frequency.PARAMETERS.items())
    parts = " UNION ALL ".join(f"SELECT mo.*, 'gamma' AS dist, gam.p, gam.x FROM mo JOIN gam USING (st)" if d == "gamma" else f"SELECT mo.*, '{d}' AS dist, 1 - 1 / t AS p, {sql_quantile(d, '(1 - 1 / t)')} AS x FROM mo, kn" for d in dists)
    gamma = ""
    if "gamma" in dists:
        gamma = f"""gah AS ({_gamma_halves("mo, kn", 60, 800)}), gam AS (SELECT st, p, (lo + hi) / 2 * scale AS x FROM gah WHERE i = 60),"""
    crit = ", ".join(map(repr, stats.CHI2_5))
    return f"""WITH RECURSIVE {b.SERIES}, {b.MOMENTS}, kn AS (SELECT 1.0001::DOUBLE AS t UNION ALL SELECT t * 1.15 FROM kn WHERE t * 1.15 <= 100000),
    {gamma} q AS ({parts}),
    tab AS (SELECT st, dist, n, mn, mx, greatest(5, least(20, floor(1.5 + 3.322 * log10(n))))::INTEGER AS k, list(x ORDER BY x, p) AS xs, list(p ORDER BY x, p) AS ps FROM q GROUP BY ALL),
    bins AS (SELECT *, (mx - mn) / k AS w, unnest(range(k))::INTEGER AS i FROM tab),
    edges AS (SELECT *, mn + w * i AS lo, CASE WHEN i = k - 1 THEN mx + 1e-9 ELSE mn + w * (i + 1) END AS hi FROM bins),
    pl AS (SELECT *, len(list_filter(xs, lambda v: v < lo)) AS jl, len(list_filter(xs, lambda v: v < hi)) AS jh FROM edges),
    c AS (SELECT *, CASE WHEN jl = 0 THEN greatest(0, ps[1] * 0.5) WHEN jl >= len(xs) THEN ps[len(xs)] ELSE ps[jl] + (lo - xs[jl]) / (xs[jl + 1] - xs[jl]) * (ps[jl + 1] - ps[jl]) END AS cl,
      CASE WHEN jh = 0 THEN greatest(0, ps[1] * 0.5) WHEN jh >= len(xs) THEN ps[len(xs)] ELSE ps[jh] + (hi - xs[jh]) / (xs[jh + 1] - xs[jh]) * (ps[jh + 1] - ps[jh]) END AS ch FROM pl),
    o AS (SELECT c.st, c.dist, c.i, c.k, n * (ch - cl) AS esp, (SELECT count(*) FROM ser WHERE ser.st = c.st AND ser.value >= c.lo AND ser.value < c.hi) AS obs FROM c),
    x AS (SELECT st, dist, k, sum(CASE WHEN esp > 0 THEN power(obs - esp, 2) / esp ELSE 0 END) AS x2 FROM o GROUP BY ALL),
    f AS (SELECT st, dist, x2, greatest(1, k - 1 - (CASE {used} END))::INTEGER AS df FROM x)
    SELECT st, dist, round(x2, 4) AS x2, df, coalesce([{crit}][df], 25.0)::DOUBLE AS critical, x2 <= coalesce([{crit}][df], 25.0) AS accepted FROM f"""


@query(_chi2_sql())
def chi2_sturges(spark, sf_dir):
    s = b.series(spark, sf_dir)
    return frequency.chi_square(s, fits(spark, sf_dir), ["st"], ("normal", "gumbel")).select("st", "dist", F.round("x2", 4).alias("x2"), "df", "critical", "accepted")


@query(f"SELECT st, dist, x2, accepted FROM ({_chi2_sql()}) z QUALIFY row_number() OVER (PARTITION BY st ORDER BY accepted DESC, x2, CASE dist WHEN 'normal' THEN 1 ELSE 2 END) = 1")
def best_distribution(spark, sf_dir):
    return frequency.best(chi2_sturges(spark, sf_dir), ["st"]).select("st", "dist", "x2", "accepted")


@query(f"""WITH RECURSIVE {b.SERIES}, {b.MOMENTS}, ts AS (SELECT t FROM (VALUES {", ".join(f"({float(t)!r}::DOUBLE)" for t in PERIODS)}) v(t)),
g AS ({_gamma_halves("mo, ts", 70, 2000)})
SELECT st, t, 'gamma' AS dist, round((lo + hi) / 2 * scale / 1000, 4) AS q_thousands FROM g WHERE i = 70""")
def gamma_quantiles(spark, sf_dir):
    return quantiles(spark, sf_dir, ("gamma",)).select("st", "t", "dist", F.round(F.col("q") / 1000, 4).alias("q_thousands"))


@query(f"""SELECT st, dist, x2, df, critical, accepted FROM ({_chi2_sql(stats.DISTRIBUTIONS)}) z
QUALIFY row_number() OVER (PARTITION BY st ORDER BY accepted DESC, x2, CASE dist {" ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(stats.DISTRIBUTIONS))} END) = 1""")
def best_of_six(spark, sf_dir):
    s = b.series(spark, sf_dir)
    return frequency.best(frequency.chi_square(s, fits(spark, sf_dir), ["st"]), ["st"]).select("st", "dist", F.round("x2", 4).alias("x2"), "df", "critical", "accepted")


def station_table(spark, sf_dir):
    n = F.count(F.lit(1))
    counts = b.series(spark, sf_dir).groupBy("st").agg(n.alias("n_years"))
    nat = b.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("st"))
    return nat.join(counts, "st").select(F.col("st").alias("station_id"), b.station_lat(F.col("st")).alias("lat"), b.station_lon(F.col("st")).alias("lon"), (F.col("n_years") % 30).cast("int").alias("n_years"))


def point_table(spark, sf_dir):
    s = b.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("point_id"), (-17.5 - (k % 97) * 0.4).alias("lat"), (-68.5 - (k % 13) * 0.37).alias("lon"))


STATIONS = f"""{b.SERIES}, sta AS (SELECT n_nationkey AS station_id, (-18.0 - (n_nationkey * 7 % 25) * 1.5)::DOUBLE AS lat, (-69.0 - (n_nationkey * 3 % 10) * 0.4)::DOUBLE AS lon, (c.n % 30)::INTEGER AS n_years
  FROM nation JOIN (SELECT st, count(*) AS n FROM ser GROUP BY st) c ON c.st = n_nationkey),
pts AS (SELECT s_suppkey AS point_id, (-17.5 - (s_suppkey % 97) * 0.4)::DOUBLE AS lat, (-68.5 - (s_suppkey % 13) * 0.37)::DOUBLE AS lon FROM supplier),
dis AS (SELECT point_id, station_id, n_years, 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - p.lon) / 2), 2)))) AS km FROM pts p, sta s),
rk AS (SELECT *, (row_number() OVER (PARTITION BY point_id ORDER BY km, station_id))::INTEGER AS rank FROM dis)"""


@query(f"WITH {STATIONS} SELECT point_id, station_id, rank, round(km, 4) AS km FROM rk WHERE rank <= 3")
def nearest_stations(spark, sf_dir):
    return stations.nearest(point_table(spark, sf_dir), station_table(spark, sf_dir), 3).select("point_id", "station_id", "rank", F.round("km", 4).alias("km"))


@query(f"WITH {STATIONS}, a AS (SELECT *, max((n_years >= 15)::INTEGER) OVER (PARTITION BY point_id) AS any_long FROM rk WHERE rank <= 12) SELECT point_id, station_id, n_years, round(km, 4) AS km FROM a WHERE any_long = 0 OR n_years >= 15 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n_years - km / 20 DESC, rank) = 1")
def recommended_station(spark, sf_dir):
    r = stations.recommended(stations.nearest(point_table(spark, sf_dir), station_table(spark, sf_dir), 12))
    return r.select("point_id", "station_id", "n_years", F.round("km", 4).alias("km"))


@query(f"WITH {STATIONS} SELECT point_id, station_id, round(km, 4) AS km FROM rk WHERE km <= 150")
def stations_within(spark, sf_dir):
    return stations.near(point_table(spark, sf_dir), station_table(spark, sf_dir), 150.0).select("point_id", "station_id", F.round("km", 4).alias("km"))


@query("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS price FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey % 10 <> 0")
def override_merge(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return stations.override(o, o.filter("o_custkey % 10 = 0").withColumn("price", F.col("price") * 2), ["o_custkey"])


# A basin for each station: area, control area, rain and control rain from its key.
def _basins(df):
    k = F.col("st")
    return df.withColumns({"area": 50.0 + k * 40, "control": 400.0 + k * 25, "rain": 60.0 + k * 3, "control_rain": 75.0 + k * 2})


BASIN = "(50.0 + st * 40)::DOUBLE AS area, (400.0 + st * 25)::DOUBLE AS control, (60.0 + st * 3)::DOUBLE AS rain, (75.0 + st * 2)::DOUBLE AS control_rain"


@query(f"{WITH}, {sql_quantiles(('lognormal',))}, ba AS (SELECT st, t, q, {BASIN} FROM qu) SELECT st, t, round(q * power(area / control, 0.88) * power(rain / control_rain, 1.24), 3) AS q FROM ba")
def transposed_flows(spark, sf_dir):
    q = _basins(quantiles(spark, sf_dir, ("lognormal",)))
    f = river.transposition_factor(*[F.col(c) for c in ("area", "control", "rain", "control_rain")])
    return q.select("st", "t", F.round(F.col("q") * f, 3).alias("q"))


@query(f"""{WITH}, {sql_quantiles(('gumbel',))}, {STATIONS.replace(b.SERIES + ", ", "")}, d AS (SELECT point_id, station_id, 1 / greatest(km, 1.0) AS w FROM rk WHERE rank <= 3)
SELECT point_id, t, round(sum(w * q) / sum(w), 3) AS q FROM d JOIN qu ON d.station_id = qu.st GROUP BY point_id, t""")
def regional_weighted(spark, sf_dir):
    donors = stations.nearest(point_table(spark, sf_dir), station_table(spark, sf_dir), 3).select("point_id", F.col("station_id").alias("st"), (1 / F.greatest("km", F.lit(1.0))).alias("w"))
    joined = donors.join(quantiles(spark, sf_dir, ("gumbel",)), "st")
    return joined.groupBy("point_id", "t").agg(F.round(F.sum(F.col("w") * F.col("q")) / F.sum("w"), 3).alias("q"))


FACTOR_T, FACTOR = (2, 5, 10, 25, 50, 100, 150, 200), (0.90, 0.95, 1.0, 1.14, 1.23, 1.32, 1.35, 1.38)
CURVE_T, CURVE = (2, 5, 10, 20, 25, 50, 75, 100), (0.160, 0.521, 1.000, 1.690, 1.973, 3.084, 3.914, 4.595)


def sql_log_table(x: str, xs, ys, extend=False) -> str:
    seg = lambda i: f"{float(ys[i])!r} + (ln({x}) - ln({float(xs[i])!r})) / (ln({float(xs[i + 1])!r}) - ln({float(xs[i])!r})) * {float(ys[i + 1] - ys[i])!r}"
    out = f"CASE WHEN {x} <= {xs[0]} THEN {float(ys[0])!r}"
    for i in range(len(xs) - 1):
        out += f" WHEN {x} <= {xs[i + 1]} THEN {seg(i)}"
    return f"({out} ELSE {seg(len(xs) - 2) if extend else repr(float(ys[-1]))} END)"


GOVERNING = f"""{WITH}, {sql_quantiles(('gumbel', 'lognormal'))}, ba AS (SELECT st, t, dist, q, {BASIN} FROM qu),
me AS (
  SELECT st, t, 'transposition' AS method, 1 AS ord, true AS applies, q / 1000 * power(area / control, 0.88) * power(rain / control_rain, 1.24) AS q FROM ba WHERE dist = 'lognormal'
  UNION ALL SELECT st, t, 'rational', 2, area < 25, 0.5 * {sql_log_table('t', FACTOR_T, FACTOR)} * (rain / 24 * sqrt(24 / (0.3 * power(area, 0.5)))) * area / 3.6 FROM ba WHERE dist = 'gumbel'
  UNION ALL SELECT st, t, 'verni_king', 3, area >= 10 AND area <= 10000, 0.027 * 0.00618 * {sql_log_table('t', FACTOR_T, FACTOR)} * power(area, 0.88) * power(rain, 1.24) FROM ba WHERE dist = 'gumbel'
  UNION ALL SELECT st, t, 'regional', 4, area > 20, 2e-3 * power(area, 0.973) * power(rain, 1.224) * 1.67 * {sql_log_table('t', CURVE_T, CURVE, True)} FROM ba WHERE dist = 'gumbel')"""


def methods(spark, sf_dir) -> DataFrame:
    """Design flows by four methods as rows (st, t, method, ord, applies, q); a method that does not apply stays, flagged."""
    q = _basins(quantiles(spark, sf_dir, ("lognormal",)))
    t, area, rain = F.col("t"), F.col("area"), F.col("rain")
    factor = interpolate.table(t, FACTOR_T, FACTOR, log_x=True)
    rows = F.array(
        F.struct(F.lit("transposition").alias("method"), F.lit(1).alias("ord"), F.lit(True).alias("applies"), (F.col("q") / 1000 * river.transposition_factor(area, F.col("control"), rain, F.col("control_rain"))).alias("q")),
        F.struct(F.lit("rational").alias("method"), F.lit(2).alias("ord"), (area < 25).alias("applies"), (0.5 * factor * river.grunsky(rain, 0.3 * F.sqrt(area)) * area / 3.6).alias("q")),
        F.struct(F.lit("verni_king").alias("method"), F.lit(3).alias("ord"), area.between(10, 10000).alias("applies"), (0.027 * 0.00618 * factor * river.power(area, 0.88) * river.power(rain, 1.24)).alias("q")),
        F.struct(F.lit("regional").alias("method"), F.lit(4).alias("ord"), (area > 20).alias("applies"), (2e-3 * river.power(area, 0.973) * river.power(rain, 1.224) * 1.67 * interpolate.table(t, CURVE_T, CURVE, log_x=True, extend=True)).alias("q")),
    )
    return q.select("st", "t", F.explode(rows).alias("m")).select("st", "t", "m.*")


def adopt(rows: DataFrame, keys, arid=None) -> DataFrame:
    """Governing method per key: in arid zones the direct one (ord 1), else the largest that applies; first of equals."""
    first = F.when(arid, F.col("ord") == 1).otherwise(F.lit(False)) if arid is not None else F.lit(False)
    w = Window.partitionBy(*keys).orderBy(first.desc(), F.col("applies").desc(), F.col("q").desc_nulls_last(), "ord")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


@query(f"{GOVERNING} SELECT st, t, method, round(q, 4) AS q FROM me QUALIFY row_number() OVER (PARTITION BY st, t ORDER BY (st % 2 = 0 AND ord = 1) DESC, applies DESC, q DESC, ord) = 1")
def governing_flow(spark, sf_dir):
    return adopt(methods(spark, sf_dir), ["st", "t"], F.col("st") % 2 == 0).select("st", "t", "method", F.round("q", 4).alias("q"))


CD = ((60, 0.440), (120, 0.619), (360, 0.80), (720, 0.92), (1440, 1.0))
DURATIONS = (15, 60, 90, 180, 480, 1440)


@query(f"""{WITH}, {sql_quantiles(('pearson3',))}, du AS (SELECT unnest([{', '.join(map(str, DURATIONS))}])::DOUBLE AS dur)
SELECT st, t, dur, round(q / 5000 * 1.10 * {sql_table('dur', [x for x, _ in CD], [y for _, y in CD])} / (dur / 60), 4) AS intensity FROM qu, du""")
def design_rain_idf(spark, sf_dir):
    q = quantiles(spark, sf_dir, ("pearson3",)).withColumn("dur", F.explode(F.array(*[F.lit(float(d)) for d in DURATIONS])))
    cd = interpolate.table(F.col("dur"), [x for x, _ in CD], [y for _, y in CD])
    return q.select("st", "t", "dur", F.round(river.intensity(F.col("q") / 5000 * 1.10, cd, F.col("dur")), 4).alias("intensity"))


@query("""WITH m AS (SELECT p_partkey AS id, (1 + p_size)::DOUBLE AS l, 0.001 + p_retailprice / 100000 AS s, (p_size * p_size)::DOUBLE AS a, p_retailprice AS h, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice / 2 END AS hm,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE (60 + p_size % 30)::DOUBLE END AS cn FROM part),
t AS (SELECT id, 'kirpich' AS method, 0.0195 * power(l * 1000, 0.77) * power(s, -0.385) / 60 AS tc, true AS applies FROM m
  UNION ALL SELECT id, 'california', 0.95 * power(power(l, 3) / h, 0.385), a <= 250 FROM m
  UNION ALL SELECT id, 'giandotti', CASE WHEN hm > 0 THEN (4 * sqrt(a) + 1.5 * l) / (0.8 * sqrt(hm)) END, coalesce(hm > 0, false) FROM m
  UNION ALL SELECT id, 'mountain', 0.3 * power(l / power(s, 0.25), 0.76), true FROM m
  UNION ALL SELECT id, 'scs', CASE WHEN cn > 0 THEN power(3280 * l, 0.8) * power(1000.0 / cn - 9, 0.7) / (1140 * sqrt(s * 100)) END, coalesce(cn > 0, false) FROM m)
SELECT id, round(max(tc), 5) AS adopted, round(avg(tc), 5) AS mean, round(min(tc), 5) AS least, count(*) AS n_methods FROM t WHERE applies AND tc > 0 GROUP BY id""")
def tc_methods(spark, sf_dir):
    p = b.read(spark, sf_dir, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    m = p.select(F.col("p_partkey").alias("id"), (1 + size).cast("double").alias("l"), (0.001 + price / 100000).alias("s"), (size * size).cast("double").alias("a"), price.alias("h"), F.when(size % 3 != 0, price / 2).alias("hm"), F.when(size % 5 != 0, (60 + size % 30).cast("double")).alias("cn"))
    c = {x: F.col(x) for x in ("l", "s", "a", "h", "hm", "cn")}
    tc = F.array(
        F.struct(river.tc_kirpich(c["l"], c["s"]).alias("tc"), F.lit(True).alias("ok")), F.struct(river.tc_california(c["l"], c["h"]).alias("tc"), (c["a"] <= 250).alias("ok")),
        F.struct(river.tc_giandotti(c["a"], c["l"], c["hm"]).alias("tc"), (c["hm"] > 0).alias("ok")), F.struct(river.tc_mountain(c["l"], c["s"]).alias("tc"), F.lit(True).alias("ok")),
        F.struct(river.tc_scs(c["l"], c["s"], c["cn"]).alias("tc"), (c["cn"] > 0).alias("ok")),
    )
    rows = m.select("id", F.explode(tc).alias("m")).filter("m.ok and m.tc > 0")
    return rows.groupBy("id").agg(F.round(F.max("m.tc"), 5).alias("adopted"), F.round(F.avg("m.tc"), 5).alias("mean"), F.round(F.min("m.tc"), 5).alias("least"), F.count(F.lit(1)).alias("n_methods"))


@query(f"""WITH {b.RAIN}, a AS (SELECT *, sum(p) OVER (PARTITION BY day ORDER BY step) AS acc FROM rain),
e AS (SELECT *, CASE WHEN acc > 0.2 * (25400.0 / 80 - 254) THEN power(acc - 0.2 * (25400.0 / 80 - 254), 2) / (acc + 0.8 * (25400.0 / 80 - 254)) ELSE 0 END AS pe_acc FROM a)
SELECT day, step, round(greatest(0, pe_acc - coalesce(lag(pe_acc) OVER (PARTITION BY day ORDER BY step), 0)), 6) AS pe FROM e""")
def scs_incremental(spark, sf_dir):
    return routing.scs_increments(b.hourly_rain(spark, sf_dir), ["day"], 80.0).select("day", "step", F.round("pe", 6).alias("pe"))


@query(f"""WITH {b.RAIN}, n AS (SELECT day, step, p, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY step) - 1 AS i FROM rain),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p DESC, i) AS a, row_number() OVER (PARTITION BY day ORDER BY 2 * abs(i - floor(0.5 + 0.5 * (n - 1))) - (i > floor(0.5 + 0.5 * (n - 1)))::INTEGER) AS z FROM n)
SELECT x.day, x.i::INTEGER AS i, round(y.p, 6) AS mm FROM r x JOIN r y ON x.day = y.day AND x.z = y.a""")
def alternating_blocks(spark, sf_dir):
    w = Window.partitionBy("day")
    rain = b.hourly_rain(spark, sf_dir).select("day", F.col("p").alias("mm"), (F.row_number().over(w.orderBy("step")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return routing.alternating_blocks(rain, ["day"]).select("day", "i", F.round("mm", 6).alias("mm"))


UNIT = (0.0, 0.2, 0.6, 1.0, 0.7, 0.4, 0.2, 0.1)


@query(f"WITH {b.RAIN}, u AS (SELECT unnest(range({len(UNIT)})) AS k, unnest([{', '.join(map(str, UNIT))}])::DOUBLE AS u) SELECT day, (step + k)::INTEGER AS step, round(sum(p * u), 5) AS q FROM rain, u GROUP BY 1, 2")
def unit_hydrograph_convolution(spark, sf_dir):
    unit = spark.createDataFrame(list(enumerate(UNIT)), "k int, u double")
    return routing.convolve(b.hourly_rain(spark, sf_dir), unit, ["day"], pe="p").select("day", "step", F.round("q", 5).alias("q"))


def _fold_sql(first: str, then: str) -> str:
    return f"""WITH RECURSIVE {b.FLOW}, s AS (SELECT series, step, q, row_number() OVER (PARTITION BY series ORDER BY step) AS i, lag(q) OVER (PARTITION BY series ORDER BY step) AS before FROM flow),
    r AS (SELECT series, i, {first} AS o FROM s WHERE i = 1 UNION ALL SELECT s.series, s.i, {then} FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1)
    SELECT s.series, s.step, round(r.o, 4) AS outflow FROM r JOIN s ON s.series = r.series AND s.i = r.i"""


C0, C1, C2 = routing.muskingum_weights(2.0, 0.2, 1.0)


@query(_fold_sql("q", f"{C0!r} * s.q + {C1!r} * s.before + {C2!r} * r.o"))
def muskingum_route(spark, sf_dir):
    return routing.muskingum(b.daily_flow(spark, sf_dir), ["series"], 2.0, 0.2, 1.0).select("series", "step", F.round("outflow", 4).alias("outflow"))


A = 86400.0 / (48 * 3600 + 0.5 * 86400.0)


@query(_fold_sql("0.0::DOUBLE", f"{A!r} * s.q + {1 - A!r} * r.o"))
def linear_reservoir(spark, sf_dir):
    return routing.linear_reservoir(b.daily_flow(spark, sf_dir), ["series"], 48.0, 86400.0).select("series", "step", F.round("outflow", 4).alias("outflow"))


def _forcing(spark, sf_dir):
    return b.daily_flow(spark, sf_dir).select("series", F.col("step").alias("day"), (F.col("q") / 1000).alias("p"), (5 - 10 * F.cos(2 * 3.141592653589793 * F.col("step") / 30)).alias("temp"))


@query(f"""WITH RECURSIVE {b.FLOW}, f AS (SELECT series, step AS day, q / 1000 AS p, 5 - 10 * cos(2 * 3.141592653589793 * step / 30) AS t, row_number() OVER (PARTITION BY series ORDER BY step) AS i FROM flow),
r AS (SELECT series, 0::BIGINT AS i, 0::BIGINT AS day, 0.0::DOUBLE AS swe, 40.0::DOUBLE AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS q FROM (SELECT DISTINCT series FROM f)
  UNION ALL
  SELECT series, i, day, swe + CASE WHEN t <= 0 THEN p ELSE 0 END - m, least(s3, 100), g2 - 0.03 * g2, (greatest(0, s3 - 100) + 0.03 * g2) * 300 / 86.4
  FROM (SELECT *, s2 - 0.06 * s2 AS s3, g + 0.06 * s2 AS g2 FROM (SELECT *, s1 - least(s1, 2.0 * greatest(0, t) / 10) AS s2 FROM (
    SELECT *, s + CASE WHEN t > 0 THEN p ELSE 0 END + m AS s1 FROM (SELECT r.series, f.i, f.day, r.swe, r.s, r.g, f.p, f.t, CASE WHEN f.t > 0 THEN least(r.swe, 4.0 * f.t) ELSE 0 END AS m FROM r JOIN f ON f.series = r.series AND f.i = r.i + 1)))))
SELECT series, day, round(swe, 3) AS swe, round(q, 3) AS q FROM r WHERE i > 0""")
def degree_day_bucket(spark, sf_dir):
    out = routing.simulate(_forcing(spark, sf_dir), ["series"], rounded=False)
    return out.select("series", "day", F.round("swe", 3).alias("swe"), F.round("q", 3).alias("q"))


@query()
def calibrate_bucket(spark, sf_dir):
    f = _forcing(spark, sf_dir)
    twin = routing.simulate(f, ["series"], melt=5.0, k_base=0.05).select("series", "day", F.col("q").alias("obs"))
    return routing.calibrate(f.join(twin, ["series", "day"]), ["series"])


_HELD = "(CASE WHEN {z} <= 110 THEN ({z} - 100) / 10 * 5e6 ELSE 5e6 + ({z} - 110) / 10 * 1.5e7 END)"
_SPILL = "(2.0 * 20.0 * power(greatest(0, {z} - 115), 1.5))"
_HALF = "((a.lo + a.hi) / 2)"
# Half of the interval, fifty times: a fold over a list whose first element is the interval itself.
_LEVEL = f"""list_reduce([{{'lo': 100.0::DOUBLE, 'hi': 128.0::DOUBLE}}] || list_transform(range(50), lambda i: {{'lo': known, 'hi': known}}),
  lambda a, k: CASE WHEN {_HELD.format(z=_HALF)} + 43200.0 * {_SPILL.format(z=_HALF)} < k.lo THEN {{'lo': {_HALF}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {_HALF}}} END)"""


@query(f"""WITH RECURSIVE {b.FLOW}, s0 AS (SELECT series, row_number() OVER w - 1 AS i, q / 100 AS q, min(step) OVER (PARTITION BY series) AS first FROM flow WINDOW w AS (PARTITION BY series ORDER BY step)),
n AS (SELECT series, min(first) AS first, ceil(count(*) * 1.5)::BIGINT AS n FROM s0 GROUP BY series), g AS (SELECT series, first, unnest(range(n)) AS i FROM n),
s AS (SELECT g.series, g.first + g.i AS step, g.i, coalesce(q, 0) AS q, coalesce(lag(q) OVER (PARTITION BY g.series ORDER BY g.i), 0) AS before FROM g LEFT JOIN s0 ON s0.series = g.series AND s0.i = g.i),
r AS (SELECT series, 0::BIGINT AS i, 115.0::DOUBLE AS z FROM n UNION ALL
  SELECT series, i, (x.lo + x.hi) / 2 FROM (SELECT series, i, {_LEVEL} AS x FROM (SELECT r.series, s.i, {_HELD.format(z='r.z')} + 86400.0 * (s.before + s.q) / 2 - 86400.0 * {_SPILL.format(z='r.z')} / 2 AS known FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1)))
SELECT s.series, s.step, round(s.q, 5) AS inflow, round({_SPILL.format(z='r.z')}, 5) AS outflow, round(r.z, 7) AS level FROM s JOIN r ON r.series = s.series AND r.i = s.i""")
def reservoir_route(spark, sf_dir):
    flow = b.daily_flow(spark, sf_dir).withColumn("q", F.col("q") / 100)
    out = routing.reservoir(flow, ["series"], [(100.0, 0.0), (110.0, 5e6), (120.0, 2e7)], 115.0, 20.0, dt=86400.0)
    return out.select("series", "step", F.round("inflow", 5).alias("inflow"), F.round("outflow", 5).alias("outflow"), F.round("level", 7).alias("level"))


@query("""WITH d AS (SELECT s_suppkey AS id, 1e5 + s_suppkey * 1e4 AS w, 5.0 + s_suppkey % 40 AS h, s_suppkey % 2 = 0 AS piping FROM supplier)
SELECT id, round(0.27 * (CASE WHEN piping THEN 1.0 ELSE 1.3 END) * power(w, 0.32) * power(h, 0.04), 5) AS width, round(63.2 * sqrt(w / (9.81 * h * h)), 4) AS formation_s,
  round(0.607 * power(w, 0.295) * power(h, 1.24), 4) AS peak_froehlich, round(1.154 * power(w * h, 0.412), 4) AS peak_mlm FROM d""")
def breach_parameters(spark, sf_dir):
    k = F.col("s_suppkey")
    d = b.read(spark, sf_dir, "supplier").select(k.alias("id"), (1e5 + k * 1e4).alias("w"), (5.0 + k % 40).alias("h"), (k % 2 == 0).alias("piping"))
    r = river.breach(F.col("w"), F.col("h"), F.lit(None).cast("double"), F.col("piping"))
    return d.select("id", F.round(r["width"], 5).alias("width"), F.round(r["formation_s"], 4).alias("formation_s"), F.round(r["peak_froehlich"], 4).alias("peak_froehlich"), F.round(r["peak_mlm"], 4).alias("peak_mlm"))


@query(f"{WITH}, {sql_quantiles(('gumbel',))} SELECT qu.st, round(mx, 2) AS top, min(CASE WHEN q >= mx THEN t END) AS covering_t FROM qu JOIN mo ON qu.st = mo.st GROUP BY qu.st, mx")
def covering_period(spark, sf_dir):
    return frequency.covering_period(quantiles(spark, sf_dir, ("gumbel",)), b.series(spark, sf_dir), ["st"]).withColumn("top", F.round("top", 2))


@query("SELECT n_nationkey AS id, round(power(10, 3) * 2 * 6371.0 * asin(sqrt(power(sin(radians(1.0) / 2), 2) * power(cos(radians(n_nationkey * 2.0)), 2))), 3) AS m_per_degree FROM nation")
def metres_per_degree(spark, sf_dir):
    k = F.col("n_nationkey")
    lat = k * 2.0
    return b.read(spark, sf_dir, "nation").select(k.alias("id"), F.round(1000 * geo.haversine_km(lat, F.lit(0.0), lat, F.lit(1.0)), 3).alias("m_per_degree"))
