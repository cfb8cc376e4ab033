"""Storm hydrographs against plain loops, coefficient dictionaries and the choice of methods."""

import math

import pytest
from pyspark.sql import functions as F

from riverframe.functions import river
from riverframe.operators import methods, storms


def test_hyetographs(spark):
    rows = [(i, 50.0 + i, d, dt, p) for i, (d, dt, p) in enumerate([(6.0, 1.0, "alternating"), (5.0, 1.0, "alternating"), (24.0, 0.5, "triangular"), (3.0, 0.7, "uniform"), (0.1, 1.0, "alternating"), (2.0, 1.0, None)])]
    storm = spark.createDataFrame(rows + [(90, None, 1.0, 1.0, "uniform"), (91, 5.0, None, 1.0, "uniform"), (92, 5.0, 1.0, 0.0, "uniform")], "k int, total double, duration_h double, dt_h double, pattern string")
    got = {}
    for r in storms.hyetograph(storm, ["k"]).collect():
        got.setdefault(r.k, {})[r.step] = r.p
    assert set(got) == {0, 1, 2, 3, 4, 5}
    for i, total, d, dt, pattern in rows:
        n = max(1, math.floor(d / dt + 0.5))
        p = [got[i][s] for s in range(n)]
        assert len(got[i]) == n and sum(p) == pytest.approx(total, rel=1e-12)
        if pattern == "alternating":
            falls = [((k + 1) ** 0.3 - k**0.3) for k in range(n)]
            w, left, right = [0.0] * n, (n - 1) // 2, (n - 1) // 2 + 1
            for k, v in enumerate(falls):
                if k % 2 == 0:
                    w[left], left = v, left - 1
                else:
                    w[right], right = v, right + 1
        elif pattern == "triangular":
            w = [max(0.01, 1 - abs(k - (n - 1) / 2) / ((n - 1) / 2 + 1)) for k in range(n)]
        else:
            w = [1.0] * n
        assert p == pytest.approx([total * x / sum(w) for x in w])
    rising = {r.step: r.p for r in storms.hyetograph(storm.filter("k = 0"), ["k"], exponent=-0.5).collect()}
    assert max(rising, key=rising.get) == 2 and sum(rising.values()) == pytest.approx(50.0)


CURVES = {1: ([(0.0, 1.0), (0.3, 5.0), (2.0, 2.0), (2.9, 8.0)], 0.5), 2: ([(1.0, 4.0)], 0.25), 3: ([(0.7, 3.0), (0.7, 9.0), (5.2, 1.0)], 1.0), 4: ([(0.0, 0.0), (0.01, 7.0), (0.02, 3.0)], 1.0), 5: ([(0.5 * i, float(i * i)) for i in range(9)], 0.5)}


@pytest.mark.parametrize("last,least,up", [("hold", 2, False), ("zero", 0, True)])
def test_uniform_steps(spark, last, least, up):
    rows = [(k, t, q, dt) for k, (points, dt) in CURVES.items() for t, q in points]
    got = {}
    for r in storms.uniform(spark.createDataFrame(rows + [(9, None, 1.0, 1.0)], "k int, t double, q double, dt double").repartition(3), ["k"], last, least, up).collect():
        assert r.step not in got.setdefault(r.k, {})
        got[r.k][r.step] = r.q
    for k, (points, dt) in CURVES.items():
        end = points[-1][0]
        n = max(least, math.ceil(end / dt) if up else math.floor(end / dt + 0.5))

        def value(t):
            if t <= points[0][0]:
                return points[0][1]
            if t >= end:
                return 0.0 if last == "zero" else points[-1][1]
            for a, b in zip(points, points[1:]):
                if a[0] < t <= b[0]:
                    return a[1] + (t - a[0]) / (b[0] - a[0]) * (b[1] - a[1])

        assert got[k] == {i: pytest.approx(value(i * dt)) for i in range(n + 1)}
    assert 9 not in got


def test_storm_keeps_its_mass(spark):
    cols = "k string, length double, to_centroid double, slope double, area double, zone int, cn double, total double, duration_h double, pattern string, dt_h double, base double"
    rows = [("a", 40.0, 18.0, 0.02, 300.0, 1, 78.0, 90.0, 24.0, "alternating", None, 2.0), ("b", 12.0, 5.0, 0.05, 45.0, 2, 85.0, 60.0, 6.0, "triangular", 0.25, None), ("c", 80.0, 30.0, 0.01, 2000.0, 3, 60.0, 150.0, 48.0, "uniform", 1.0, 10.0), ("d", 80.0, 30.0, 0.01, None, 3, 60.0, 150.0, 48.0, "uniform", 1.0, 10.0)]
    given = spark.createDataFrame(rows, cols)
    q = storms.storm_hydrographs(given, ["k"])
    s = {r.k: r for r in storms.summary(q, given, ["k"]).collect()}
    assert set(s) == {"a", "b", "c"}
    for r in rows[:3]:
        retained = 25400 / r[6] - 254
        effective = (r[7] - 0.2 * retained) ** 2 / (r[7] + 0.8 * retained)
        assert s[r[0]].volume == pytest.approx(r[4] * 1000 * effective, rel=1e-9)
    flow = q.filter("k = 'c'").collect()
    assert min(x.q for x in flow) == pytest.approx(10.0) and max(x.q for x in flow) == s["c"].peak
    assert [x.step for x in sorted(flow, key=lambda x: x.step)] == list(range(len(flow)))
    fall = spark.range(3).select(storms.base_flow(F.col("id"), F.lit(8.0), F.lit(0.5), F.lit(1.0)).alias("q")).collect()
    assert [x.q for x in fall] == pytest.approx([8.0, 8 * math.exp(-0.5), 8 * math.exp(-1.0)])


def test_dictionaries_are_checked(spark):
    dim = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 1.0), ("b", None), ("c", -1.0)], "k string, v double")
    assert {tuple(r) for r in methods.problems(dim, ["k"], ["v"], ["v"]).collect()} == {("a", "repeated key"), (None, "null key"), ("b", "no v"), ("c", "v is not above 0")}
    with pytest.raises(ValueError, match="repeated key"):
        methods.checked(dim, ["k"])
    assert methods.checked(dim.filter("k = 'c'"), ["k"], ["v"]).count() == 1


@pytest.mark.parametrize("most", [methods.BROADCAST_MOST, -1])
def test_lookup_and_as_of_keep_every_row(spark, most, monkeypatch):
    monkeypatch.setattr(methods, "BROADCAST_MOST", most)
    dim = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    rows = spark.createDataFrame([(1, "x", "y"), (2, None, "y"), (3, "q", None), (4, "q", "x"), (4, "q", "x")], "id int, own string, other string")
    got = methods.lookup(rows, dim, "k", ["v"], [F.col("own"), F.col("other")], "how").collect()
    assert sorted((r.id, r.v, r.how) for r in got if r.v) == [(1, 1.0, 1), (2, 2.0, 2), (4, 1.0, 2), (4, 1.0, 2)] and [r.how for r in got if r.id == 3] == [None]
    dated = spark.createDataFrame([("x", 10, "old"), ("x", 20, "new"), ("x", None, "never")], "k string, t int, v string")
    asked = spark.createDataFrame([("x", 5), ("x", 10), ("x", 19), ("x", 99), ("x", None), ("z", 50), (None, 1)], "k string, t int")
    got = {(r.k, r.t): r.v for r in methods.as_of(asked, dated, ["k"], "t", ["v"]).collect()}
    assert got == {("x", 5): None, ("x", 10): "old", ("x", 19): "old", ("x", 99): "new", ("x", None): None, ("z", 50): None, (None, 1): None}


def test_chosen_distribution(spark):
    best = spark.createDataFrame([(i, "gumbel") for i in range(5)], "st int, dist string")
    fitted = spark.createDataFrame([(i, d) for i in range(5) for d in ("gumbel", "normal")], "st int, dist string")
    own = spark.createDataFrame([(0, "normal"), (1, "auto"), (2, "weibull"), (3, None), (9, "normal")], "st int, dist string")
    assert {r.st: (r.dist, r.chosen) for r in methods.chosen_distribution(fitted, best, own, ["st"]).collect()} == {0: ("normal", True), **{i: ("gumbel", False) for i in range(1, 5)}}


PERIODS = [2.0, 10.0, 100.0, 200.0]


@pytest.fixture()
def dims(spark):
    return {
        "rational": spark.createDataFrame([("III", 0.4)], "region string, c10 double"), "verni": spark.createDataFrame([("III", 0.03), ("V", 0.2)], "region string, c10 double"),
        "default_zones": spark.createDataFrame([("V", "Q")], "region string, zone string"), "zones": spark.createDataFrame([("Q", "L", 1.5), ("R", "none", 1.0), ("S", "L", 1.0)], "zone string, law string, alpha double"),
        "curves": spark.createDataFrame([(z, t, r) for z in "QR" for t, r in ((2.0, 0.2), (10.0, 1.0), (100.0, 3.0))], "zone string, t double, ratio double"), "laws": spark.createDataFrame([("L", 0.002, 0.97, 1.22)], "law string, k double, exp_area double, exp_rain double"),
    }


def test_methods_keep_every_point(spark, dims):
    cols = "point_id int, area double, region string, zone string, c_rational double, c_verni double, tc_h double, length double, to_centroid double, slope double, cn double, unit_zone int"
    whole = (10.0, 4.0, 0.02, 80.0, 1)
    pts = [(1, 20.0, "III", "Q", None, None, 3.0, *whole), (2, 50.0, "V", None, None, None, 3.0, *whole), (3, 50.0, "nowhere", None, None, None, None, *whole), (4, 50.0, "V", "R", 0.5, 0.1, 3.0, None, 1.0, 1.0, 80.0, 1), (5, 50.0, None, "S", None, None, 3.0, *whole[:-1], 9)]
    points = spark.createDataFrame(pts, cols)
    rain = spark.createDataFrame([(i, t, 30.0 + t / 10) for i in range(1, 6) for t in PERIODS], "point_id int, t double, p24 double")
    rows = methods.rain_methods(points, rain, dims, (2, 100), (0.9, 1.32), "Q").collect()
    got = {(r.point_id, r.t, r.method): r for r in rows}
    assert len(rows) == len(got) == 5 * 4 * 4
    assert {(i, m): got[i, 10.0, m].reason for i in range(1, 6) for m in ("rational", "verni_king", "zone_curve", "unit_hydrograph") if got[i, 10.0, m].reason} == {
        (2, "rational"): "no coefficient", (3, "rational"): "no coefficient", (3, "verni_king"): "no coefficient", (4, "zone_curve"): "no law", (4, "unit_hydrograph"): "no basin measures",
        (5, "rational"): "no coefficient", (5, "verni_king"): "no coefficient", (5, "zone_curve"): "no curve", (5, "unit_hydrograph"): "no basin measures",
    }
    assert all((r.q is None) == (r.reason is not None) and not (r.applies and r.reason) for r in rows)
    assert [got[2, t, "zone_curve"].extrapolated for t in PERIODS] == [False, False, False, True]
    fra = min(1.0, max(0.4, 1.1032 - 0.03474 * math.log(50)))
    base = 0.002 * 50**0.97 * (31.0 * fra) ** 1.22 * 1.5
    beyond = 3.0 + 2.0 / (math.log(100) - math.log(10)) * (math.log(200) - math.log(100))
    assert [got[2, t, "zone_curve"].q for t in PERIODS] == pytest.approx([0.2 * base, base, 3 * base, beyond * base])
    assert got[1, 10.0, "rational"].applies and not got[4, 10.0, "rational"].applies and got[4, 10.0, "rational"].q > 0 and not got[1, 2.0, "zone_curve"].applies
    plain = {(r.point_id, r.t, r.method): r.q for r in methods.rain_methods(points, rain, dims, (2, 100), (0.9, 1.32), "Q", areal_reduction=False).collect()}
    assert plain[2, 10.0, "zone_curve"] == pytest.approx(base / fra**1.22) and plain[4, 2.0, "verni_king"] > got[4, 2.0, "verni_king"].q
    with pytest.raises(ValueError):
        methods.rain_methods(points, rain, {**dims, "zones": dims["zones"].union(dims["zones"])}, (2, 100), (0.9, 1.32), "Q")


def test_flows_from_records_and_the_choice(spark):
    points = spark.createDataFrame([(1, 100.0, 7, 50.0), (2, 100.0, None, None), (3, 100.0, 8, None)], "point_id int, area double, station_id int, control_area double")
    flows = spark.createDataFrame([(7, 2.0, 10.0), (7, 10.0, 30.0), (6, 2.0, 4.0)], "station_id int, t double, q double")
    donors = spark.createDataFrame([(1, 7, 0.2, 50.0), (1, 6, 4.0, 25.0), (2, 6, 3.0, None)], "point_id int, station_id int, km double, control_area double")
    rows = methods.flow_methods(points, flows, donors, [2.0, 10.0], F.lit(1.5))
    got = {(r.point_id, r.t, r.method): (r.q, r.reason) for r in rows.collect()}
    assert len(got) == 3 * 2 * 3
    assert got[1, 2.0, "direct"] == (15.0, None) and got[1, 2.0, "transposition"][0] == pytest.approx(10 * 2**0.88)
    assert got[1, 2.0, "regional"][0] == pytest.approx((10 * 2**0.88 + 0.25 * 4 * 4**0.88) / 1.25)
    assert got[2, 2.0, "direct"] == (None, "no station") and got[2, 2.0, "regional"] == (None, "no donors") and got[3, 2.0, "direct"] == (None, "no record")
    choice = spark.createDataFrame([(1, "direct", False), (2, None, True), (3, "magic", False)], "point_id int, method string, arid boolean")
    picked = {(r.point_id, r.t): (r.method, r.q, r.reason, r.how) for r in methods.select_method(rows, choice, F.col("arid")).collect()}
    assert picked[1, 2.0] == ("direct", 15.0, None, "chosen") and picked[3, 2.0] == ("magic", None, "unknown method", "chosen") and picked[2, 2.0][1:] == (None, "no station", "adopted")
    both = rows.filter("point_id = 1").unionByName(spark.createDataFrame([(1, 2.0, "verni_king", True, 99.0, None, False)], rows.schema))
    adopt = lambda arid: {r.t: (r.method, r.q) for r in methods.select_method(both, spark.createDataFrame([(1, None, arid)], "point_id int, method string, arid boolean"), F.col("arid")).collect()}
    assert adopt(True)[2.0] == ("direct", 15.0) and adopt(False)[2.0] == ("verni_king", 99.0)
    assert river.UNIT_ZONES
