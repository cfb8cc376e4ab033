"""Published values, hand values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverframe.functions import interpolate, river, stats
from riverframe.operators import frequency, routing


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_adopted_flows_of_the_golden_case(spark):
    control = {2: 16.5, 5: 40.0, 10: 63.5, 25: 103.8, 50: 142.7, 100: 189.9, 200: 246.7}
    want = {2: 8.5464, 5: 20.7184, 10: 32.8905, 25: 53.7644, 50: 73.9130, 100: 98.3608, 200: 127.7810}
    df = spark.createDataFrame(list(control.items()), "t int, q double")
    one = F.lit(1.0)
    got = df.select("t", (F.col("q") * river.transposition_factor(F.lit(951.30), F.lit(2009.0), one, one)).alias("q")).collect()
    for r in got:
        assert abs(r.q / want[r.t] - 1) < 1e-3


@pytest.mark.parametrize("dist,want,tol", [("normal", (12.6, 28.1, 36.2, 44.9, 50.5, 55.5, 60.1), 0.4), ("lognormal", (7.1, 17.5, 28.0, 46.3, 64.0, 85.6, 111.8), 0.6), ("gumbel", (9.8, 28.5, 40.9, 56.6, 68.2, 79.7, 91.2), 0.4), ("gamma", (5.4, 20.6, 34.6, 54.6, 70.4, 86.7, 103.3), 0.4)])
def test_published_quantiles(spark, dist, want, tol):
    m = {k: F.lit(v) for k, v in {"mean": 12.61, "std": 18.42, "mean_ln": 1.96, "std_ln": 1.07, "yn": 0.54, "sn": 1.12}.items()}
    for t, q in zip((2, 5, 10, 25, 50, 100, 200), want):
        assert abs(value(spark, stats.quantile(dist, F.lit(float(t)), m)) - q) <= tol


SERIES = [2, 2, 4, 26, 3, 23, 35, 0, 6.7, 95.5, 4, 5.5, 1.5, 0.5, 4, 16, 18.5, 0, 15, 7, 10, 15, 5, 7, 5, 4, 4, 9, 0, 2, 33, 48, 13.6, 5.2, 6.5, 0, 0.7, 2.5, 10.5]


def test_worked_example(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(SERIES)], "k string, year int, value double")
    m = frequency.moments(s, ["k"])
    r = m.first()
    assert (r.n, r.n_zero) == (39, 4)
    for got, want in ((r["mean"], 11.543590), (r["std"], 17.527014), (r["skew"], 3.352082), (r["mean_ln"], 0.302588), (r["std_ln"], 4.956905), (r["skew_log"], -2.479914)):
        assert abs(got - want) < 1e-5
    tests = {x.dist: x for x in frequency.chi_square(s, m, ["k"]).collect()}
    want = {"normal": (646.538, 3, False), "lognormal": (5.459, 3, True), "pearson3": (4.882, 2, True), "logpearson3": (17.273, 2, False), "gumbel": (28.988, 3, False), "gamma": (3.535, 3, True)}
    for d, (x2, df, ok) in want.items():
        assert abs(tests[d].x2 - x2) < 0.02 * max(1, x2 / 100) and (tests[d].df, tests[d].accepted) == (df, ok), d
    assert frequency.best(frequency.chi_square(s, m, ["k"]), ["k"]).first().dist == "gamma"
    fit = {x.dist: x.r2 for x in frequency.r_squared(s, m, ["k"], tie=["year"]).collect()}
    assert abs(fit["gamma"] - 0.8970) < 1e-3 and abs(fit["gumbel"] - 0.7219) < 1e-3
    q = {(x.dist, int(x.t)): x.q for x in frequency.quantiles(m, ["k"]).collect()}
    for d, t, v in (("gamma", 100, 82.79), ("pearson3", 100, 83.19), ("gumbel", 200, 84.70), ("logpearson3", 50, 73.72)):
        assert abs(q[d, t] - v) < 0.02
    g = frequency.grubbs_beck(s, ["k"])
    assert abs(g.first().high - 141.0706) < 1e-3 and abs(g.first().low - 0.327230) < 1e-5 and g.filter("is_high or is_low").count() == 0


@pytest.mark.parametrize("shape", [3000.0, 20_000.0, 200_000.0])
def test_gamma_of_narrow_series(shape):
    """Large shapes need more terms than a fixed number; the sum of all terms of the series is the measure."""
    x = shape + np.array([-2.0, 0.0, 0.5, 2.5]) * math.sqrt(shape)
    lg = np.array([math.lgamma(shape + k + 1) for k in range(int(20 * math.sqrt(shape)))])
    want = [np.exp((shape + np.arange(len(lg))) * math.log(v) - v - lg).sum() for v in x]
    assert np.allclose(stats.np_gamma_p(np.full(4, shape), x), want, atol=1e-8)
    assert np.allclose(stats.np_gamma_inv(np.full(4, shape), np.array(want)), x, rtol=1e-8)


def test_normal_and_gamma_functions(spark):
    for p, z in ((0.5, 0.0), (0.9, 1.2816), (0.001, -3.0902), (0.999, 3.0902)):
        assert abs(value(spark, stats.norm_inv(F.lit(p))) - z) < 1e-4
        assert abs(value(spark, stats.norm_cdf(stats.norm_inv(F.lit(p)))) - p) < 1e-4
    assert value(spark, stats.norm_inv(F.lit(1.0))) is None
    for x in (0.3, 0.5, 1.0, 4.5, 30.0):
        assert abs(value(spark, stats.ln_gamma(F.lit(x))) - math.lgamma(x)) < 1e-9
    s, p = np.meshgrid([0.3, 1.0, 7.5, 80.0], [0.01, 0.5, 0.99])
    assert np.allclose(stats.np_gamma_p(s, stats.np_gamma_inv(s, p)), p, atol=1e-9)
    assert abs(stats.np_gamma_p(np.array([1.0]), np.array([2.0]))[0] - (1 - math.exp(-2))) < 1e-12


def test_interpolation(spark):
    xs, ys = (1.0, 2.0, 4.0), (10.0, 20.0, 0.0)
    for x, y in ((0.5, 10), (1.5, 15), (2, 20), (3, 10), (9, 0)):
        assert abs(value(spark, interpolate.table(F.lit(float(x)), xs, ys)) - y) < 1e-12
    assert abs(value(spark, interpolate.table(F.lit(8.0), xs, ys, log_x=True, extend=True)) + 20) < 1e-9
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(xs, ys)])
    for x, mode, y in ((0.0, "hold", 10.0), (3.0, "hold", 10.0), (9.0, "zero", 0.0), (5.0, "extend", -10.0)):
        assert abs(value(spark, interpolate.curve(F.lit(x), knots, after=mode)) - y) < 1e-12


def test_times_and_unit_hydrograph(spark):
    length, slope = F.lit(108.86), F.lit(0.03)
    assert abs(value(spark, river.tc_kirpich(length, slope)) - 9.54) < 0.2
    assert abs(value(spark, river.tc_mountain(length, slope)) - 20.70) < 0.2
    assert value(spark, river.tc_giandotti(F.lit(10.0), length, F.lit(None).cast("double"))) is None
    u = river.unit_hydrograph(length, F.lit(46.8), slope, F.lit(951.30), F.lit(1))
    for name, want, tol in (("tp", 24.83, 0.6), ("tu", 4.51, 0.15), ("tb", 71.36, 1.5), ("qp", 11.18, 0.3), ("qpa", 10.63, 0.3)):
        assert abs(value(spark, u[name]) - want) <= tol
    assert abs(value(spark, river.scs_runoff(F.lit(100.0), F.lit(80.0))) - 50.539) < 0.01
    assert value(spark, river.snow_line_by_temperature(F.lit(1000.0), F.lit(15.5), F.lit(0.5), F.lit(1.0))) == 3900


def test_routing(spark):
    flow = [0, 5, 15, 30, 45, 30, 18, 10, 5, 2, 0]
    assert abs(sum(routing.muskingum_weights(3600, 0.2, 1800)) - 1) < 1e-12
    s = spark.createDataFrame([(k, i, float(q)) for k in "ab" for i, q in enumerate(flow)], "k string, step bigint, q double")
    out = routing.muskingum(s, ["k"], 3600, 0.2, 1800)
    total = out.groupBy("k").agg(F.sum("inflow").alias("i"), F.sum("outflow").alias("o"), F.max("outflow").alias("p")).collect()
    assert len(total) == 2 and all(r.p < 45 and abs(r.o / r.i - 1) < 0.15 for r in total)
    m = routing.routing_metrics(out, ["k"], 1800).first()
    assert m.peak_in == 45 and 0 < m.attenuation < 1 and m.lag_h > 0
    unit = spark.createDataFrame(list(enumerate([0.0, 1.0, 2.0, 1.0, 0.0])), "k int, u double")
    rain = spark.createDataFrame([("x", i, float(p)) for i, p in enumerate([2, 5, 3])], "s string, step int, pe double")
    q = routing.convolve(rain, unit, ["s"]).orderBy("step").collect()
    assert [r.q for r in q] == list(np.convolve([2, 5, 3], [0, 1, 2, 1, 0])) and len(q) == 7
    steady = routing.network(
        spark.createDataFrame([("n", "s1", "subbasin", "r1", 0.0, 0.0), ("n", "r1", "reach", "o", 3600.0, 0.2), ("n", "o", "outlet", None, 0.0, 0.0)], "network_id string, id string, kind string, downstream string, k double, x double"),
        spark.createDataFrame([("n", "s1", i, 7.0) for i in range(20)], "network_id string, id string, step int, q double"), dt=1800.0,
    )
    assert all(abs(r.q - 7) < 1e-9 for r in steady.filter("id = 'o' and step < 20").collect())


def test_reservoir_holds_mass():
    q = np.concatenate((np.linspace(0, 100, 10), np.linspace(100, 0, 20), np.zeros(200)))
    level, volume = np.array([100.0, 110.0]), np.array([0.0, 1e6])
    out, z = routing.storage_route(q, level, volume, 100.0, 10.0, 2.0, 3600.0, tail=1.0)
    stored = np.interp(z, level, volume) + np.maximum(0, z - 110) * 1e5
    assert out.max() < 100 and abs(q.sum() * 3600 - out.sum() * 3600 - stored[-1]) < 0.02 * q.sum() * 3600


def test_blocks_and_breach(spark):
    blocks = spark.createDataFrame([("d", i, float(p), 24) for i, p in enumerate(range(24, 0, -1))], "k string, i int, mm double, n int")
    got = {r.i: r.mm for r in routing.alternating_blocks(blocks, ["k"]).collect()}
    assert sum(got.values()) == 300 and max(got, key=got.get) == 12 and got[13] == 23 and got[11] == 22
    dams = spark.createDataFrame([(1, 1e6, 20.0, None, False)], "id int, volume double, height double, head double, piping boolean")
    h = routing.breach_hydrograph(dams, ["id"], 400).orderBy("t").collect()
    volume = sum((a.q + b.q) / 2 * (b.t - a.t) for a, b in zip(h, h[1:]))
    assert abs(volume / 1e6 - 1) < 0.01


def test_calibration_finds_its_twin(spark):
    from riverframe.sources.stations import synthetic_forcing

    f = synthetic_forcing(spark, 400, 2)
    obs = routing.simulate(f, ["basin_id"], melt=5.5, k_base=0.05).select("basin_id", "day", F.col("q").alias("obs"))
    got = routing.calibrate(f.join(obs, ["basin_id", "day"]), ["basin_id"]).collect()
    assert len(got) == 2 and all(r.nse > 0.98 and r.nse >= r.nse0 for r in got)


def test_time_area_and_modclark(spark):
    assert abs(routing.time_area(20).sum() - 1) < 1e-3
    rain = spark.createDataFrame([("b", i, 5.0) for i in range(6)], "k string, step bigint, pe double")
    out = routing.modclark(rain, ["k"], 2.0, 1.0, 50.0, 600.0).toPandas()
    assert abs(out.inflow.sum() * 600 / (30 * 50 * 1e3) - 1) < 1e-3 and out.outflow.max() < out.inflow.max()


def test_historical_moments_and_periods(spark):
    s = spark.createDataFrame([("a", v) for v in (10.0, 20.0, 30.0, 500.0)], "k string, value double")
    r = frequency.historical_moments(s, ["k"], F.lit(100.0), F.lit(100)).first()
    assert abs(r.n_eff - 100) < 1e-9 and r.mean_log < 1.4
    m = {"mean": F.lit(10.0), "std": F.lit(4.0)}
    q = stats.quantile("normal", F.lit(50.0), m)
    assert abs(value(spark, frequency.return_period_of(q, "normal", m)) - 50) < 1e-6
