import math

from pyspark.sql import functions as F

from riverframe.operators import scour

LAYERS = "array<struct<d50_mm:double,thickness:double>>"


def neill(q, h, layers, d50, rock=math.inf):
    ds = h
    for _ in range(25):
        d, acc = (layers[-1][0] if layers else d50), 0.0
        for size, thickness in layers:
            acc += thickness
            if ds - h <= acc:
                d = size
                break
        d = max(d, 0.1) / 1000
        new = (q / (1.58 * math.sqrt(1.65 * 9.81 * d) * d ** (-1 / 6))) ** (6 / 7)
        stop, ds = abs(new - ds) < 0.005, new
        if stop:
            break
    return max(0.0, min(ds, h + rock) - h)


def test_layered_scour(spark):
    rows = [(1, 8.0, 2.0, [], None), (2, 8.0, 2.0, [(5.0, 0.5), (80.0, 3.0)], None), (3, 8.0, 2.0, [(0.5, 10.0)], 1.0), (4, 0.5, 2.0, [(50.0, 1.0)], None)]
    df = spark.createDataFrame(rows, f"id int, q double, h double, layers {LAYERS}, rock double")
    got = {r.id: r.s for r in df.select("id", scour.neill_layered(F.col("q"), F.col("h"), F.lit(20.0), F.col("layers"), F.col("rock")).alias("s")).collect()}
    for i, q, h, layers, rock in rows:
        assert abs(got[i] - neill(q, h, layers, 20.0, math.inf if rock is None else rock)) < 1e-9
    assert got[3] == 1.0 and got[4] == 0.0


def test_strips(spark):
    points = spark.createDataFrame([("a", float(s), float(z)) for s, z in ((0, 6), (5, 0), (15, 0), (20, 6))], "k string, s double, z double")
    wet = scour.strips(points, ["k"], F.lit(3.0)).orderBy("mid").collect()
    assert [(r.mid, r.w, r.h) for r in wet] == [(3.75, 2.5, 1.5), (10.0, 10.0, 3.0), (16.25, 2.5, 1.5)]
    section = spark.createDataFrame([("a", 3.0, 100.0, 37.5, 15.0, 20.0, [], None, 100.0)], f"k string, level double, flow double, area double, width double, d50 double, layers {LAYERS}, rock double, t double")
    got = scour.by_strips(points, section, ["k"]).collect()
    assert abs(sum(r.v * r.h * r.w for r in got) - 100.0) < 1e-9
    assert all(r.scour == max(r.neill, r.lischtvan) for r in got) and max(got, key=lambda r: r.v).h == 3.0
    free = scour.freeboard(spark.createDataFrame([(3.0, 3.4, 1.0)], "level double, soffit double, required double")).first()
    assert not free.ok and abs(free.deficit - 0.6) < 1e-12


def section_row(k, flow, pier):
    return (k, 3.0, flow, 37.5, 15.0, flow / 37.5, 0.4, 20.0, 100.0, [], None, pier, "circular", None, None, None)


def test_combined_scour(spark):
    points = spark.createDataFrame([(k, float(s), float(z)) for k in "abd" for s, z in ((0, 6), (5, 0), (15, 0), (20, 6))] + [("c", 0.0, 9.0), ("c", 5.0, 2.0)], "k string, s double, z double")
    cols = f"k string, level double, flow double, area double, width double, v double, froude double, d50 double, t double, layers {LAYERS}, rock double, pier_width double, pier_shape string, pier_angle double, pier_length double, k3 double"
    sections = spark.createDataFrame([section_row("a", 300.0, 1.5), section_row("b", 300.0, None), section_row("c", 300.0, 1.5), section_row("d", 10.0, 1.5)], cols)
    got = {r.k: r for r in scour.combined(points, sections, ["k"]).collect()}
    a, hm, be = got["a"], 2.5, 10.0
    beta, x = 0.7929 + 0.0973 * 2, 0.32
    hs = (300 / (hm ** (5 / 3) * be) * 3.0 ** (5 / 3) / (0.68 * beta * 20**0.28)) ** (1 / (1 + x))
    assert math.isclose(a.general_lischtvan, hs - 3.0) and math.isclose(a.scoured_bed, 3.0 - hs)
    assert math.isclose(a.general_neill, neill(300 / be, hm, [], 20.0), abs_tol=1e-9)
    strips = scour.by_strips(points.filter("k = 'a'"), sections.filter("k = 'a'"), ["k"]).collect()
    assert a.general_strips == max(r.scour for r in strips) and a.general == max(a.general_lischtvan, a.general_neill, a.general_strips)
    csu = 2 * 1.1 * 3.0 * (1.5 / 3.0) ** 0.65 * 0.4**0.43
    assert math.isclose(a.local_csu, csu) and a.local >= a.local_csu and math.isclose(a.total, a.general + a.local) and math.isclose(a.total_csu, a.general_lischtvan + csu)
    assert got["b"].local == 0 and got["b"].total == got["b"].general == a.general
    # One wet point is no section but has a strip; a small flow scours nothing but the pier's foot, and the bed lies still.
    c = got["c"]
    assert (c.general_lischtvan, c.general_neill, c.local, c.scoured_bed, c.live_bed) == (0, 0, 0, None, False) and c.total == c.general_strips > 0
    assert got["d"].general == 0 and got["d"].local > 0 and not got["d"].live_bed and a.live_bed


def test_section_report(spark):
    row = {"section": "S1", "station": 12.5, "level": 3.0, "critical_level": None, "energy": float("inf"), "depth": 2.0, "area": 30.0, "width": 15.0, "radius": 1.8, "v": 3.0, "fr": 1.2, "slope": 0.01, "d50": 20.0, "scour_general": 1.25, "scour_local": None, "scoured_bed": -0.5}
    kinds = ", ".join(f"{k} {'string' if k == 'section' else 'double'}" for k in row)
    rows = scour.report(spark.createDataFrame([tuple(row.values())], kinds))
    r = rows.first()
    assert rows.columns == list(scour.REPORT) and r.regime == "supercritical" and r.moves == "yes" and r.scour_total == 1.25
    assert math.isclose(r.shear, 1000 * 9.81 * 1.8 * 0.01) and math.isclose(r.power, r.shear * 3.0) and math.isclose(r.shields, 2.0 * 0.01 / (1.65 * 0.02))
    assert math.isclose(r.bed_load_kg_s, 8 * (r.shields - 0.047) ** 1.5 * math.sqrt(1.65 * 9.81 * 0.02**3) * 15.0 * 2650)
    line = scour.report_lines(rows).first().line.split(",")
    assert len(line) == len(scour.REPORT) == len(scour.report_header().split(",")) == 24
    assert line[:6] == ["S1", "12.50", "3.000", "", "", "2.000"] and line[11] == "0.010000" and line[-4:] == ["1.250", "", "1.250", "-0.500"]
