"""Culverts against a loop of the same published equations, and values in closed form."""

import math

import pytest
from pyspark.sql import functions as F

from riverframe.operators import culverts

G = 9.81
COLS = "id int, kind string, height double, width double, length double, slope double, n double, tailwater double, flow double, barrels double"


def plain_barrel(box, y, d, w):
    y = max(0.0, min(y, d))
    if box:
        return w * y, w, w + 2 * y
    r = d / 2
    a = 2 * math.acos(max(-1.0, min(1.0, (r - y) / r)))
    return r * r / 2 * (a - math.sin(a)), 2 * r * math.sin(a / 2) or 1e-6, r * a or 1e-6


def halve(lo, hi, small):
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if small(mid) else (lo, mid)
    return (lo + hi) / 2


def plain(kind, d, w, length, s, n, tw, flow, barrels):
    shape, k, m, c, y, ke, n0, mitered = culverts.TYPES.get(kind, culverts.TYPES["concrete_square"])
    box = shape == "box"
    w, n, q = (w or d) if box else d, n if n is not None else n0, flow / max(1, math.floor((barrels or 1) + 0.5))
    full, radius = (w * d, w * d / (2 * (w + d))) if box else (math.pi * d * d / 4, d / 4)
    geo = lambda at: plain_barrel(box, at, d, w)
    dc = 0.0 if q <= 0 else min(d, (q * q / w / w / G) ** (1 / 3)) if box else halve(1e-4, d, lambda at: geo(at)[0] ** 3 / geo(at)[1] < q * q / G)
    carried = lambda at: geo(at)[0] * (geo(at)[0] / geo(at)[2]) ** (2 / 3) * math.sqrt(s) / n
    dn = 0.0 if q <= 0 or s <= 0 else d if carried(d) < q else halve(1e-4, d, lambda at: carried(at) < q)
    vc = q / geo(min(dc, 0.999 * d))[0] if dc > 0 else 0.0
    x = 1.811 * q / (full * math.sqrt(d))
    fall = 0.7 * s if mitered else -0.5 * s
    free, drowned = (dc + vc * vc / (2 * G)) / d + k * x**m + fall, c * x * x + y + fall
    t = min(1.0, max(0.0, (x - 3.5) / 0.5))
    inlet = max(0.0, free * (1 - t) + drowned * t) * d
    v = q / full
    outlet = max(tw or 0.0, (min(dc, d) + d) / 2) + (1 + ke + 2 * G * n * n * length / radius ** (4 / 3)) * v * v / (2 * G) - s * length
    control = "inlet" if inlet >= outlet else "outlet"
    out = v if control == "outlet" else q / geo(min(dn, 0.999 * d))[0] if dn > 0 else 0.0
    return dc, dn, inlet, outlet, control, max(0.0, inlet, outlet), out


def test_every_type_against_the_equations(spark):
    rows = []
    for kind in [*culverts.TYPES, "unheard of"]:
        for j, (d, w, length, s, n, tw, flow, barrels) in enumerate([(1.2, None, 20.0, 0.02, None, None, 2.0, None), (0.8, 2.0, 35.0, 0.0, 0.02, 1.5, 6.0, 2.0), (1.5, 1.0, 12.0, 0.001, None, 0.4, 0.0, 1.0), (2.0, 3.0, 60.0, 0.05, 0.03, 0.0, 30.0, 2.6)]):
            rows.append((len(rows), kind, d, w, length, s, n, tw, flow, barrels))
    got = {r.id: r for r in culverts.design(spark.createDataFrame(rows, COLS)).collect()}
    for i, *given in rows:
        r = got[i]
        dc, dn, inlet, outlet, control, head, out = plain(*given)
        assert (r.dc, r.dn, r.inlet, r.outlet, r.headwater, r.v_out) == pytest.approx((dc, dn, inlet, outlet, head, out), rel=1e-9, abs=1e-9)
        assert r.control == control and r.submerged == (head / given[1] > 1.2)
    # More flow needs more head, more barrels need less.
    one = spark.createDataFrame([(i, "concrete_square", 1.2, None, 20.0, 0.02, None, None, q, b) for i, (q, b) in enumerate([(2.0, 1.0), (4.0, 1.0), (4.0, 2.0)])], COLS)
    h = {r.id: r.headwater for r in culverts.design(one).collect()}
    assert h[1] > h[0] and h[2] < h[1]


def test_barrels_in_closed_form(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in zip("atp", culverts.barrel(F.lit(True), F.lit(0.8), F.lit(1.5), F.lit(2.0)))], culverts.critical_depth(F.lit(True), F.lit(8.0), F.lit(3.0), F.lit(2.0)).alias("yc"), *[c.alias(f"c{n}") for n, c in zip("atp", culverts.barrel(F.lit(False), F.lit(1.0), F.lit(2.0), F.lit(2.0)))]).first()
    assert (r.a, r.t, r.p) == pytest.approx((1.6, 2.0, 3.6)) and r.yc == pytest.approx((16 / G) ** (1 / 3))
    assert (r.ca, r.ct, r.cp) == pytest.approx((math.pi / 2, 2.0, math.pi))


def test_rating_and_choice_of_size(spark):
    one = spark.createDataFrame([(1, "box_parallel", 1.0, 2.0, 20.0, 0.01, None, None, None, 2.0)], COLS)
    r = culverts.rating(one, ["id"], 5).orderBy("i").collect()
    assert [x.flow for x in r] == pytest.approx([2 * 2.5 * 2.0 * math.sqrt(G) * i / 5 for i in range(1, 6)]) and [x.headwater for x in r] == sorted(x.headwater for x in r)
    given = spark.createDataFrame([(1, "concrete_square", None, None, 20.0, 0.02, None, None, 2.0, 1.0, 1.6), (2, "concrete_square", None, None, 20.0, 0.02, None, None, 200.0, 1.0, 1.6)], COLS + ", allowed double")
    sizes = spark.createDataFrame([(3, 2.0, None), (1, 0.8, None), (2, 1.2, None)], "size int, height double, width double")
    got = {x.id: x for x in culverts.smallest(given, sizes, ["id"]).collect()}
    assert got[1].height == 1.2 and got[1].headwater <= 1.6 and got[2].height is None and got[2].headwater is None
    assert plain("concrete_square", 0.8, None, 20.0, 0.02, None, None, 2.0, 1.0)[5] > 1.6
