"""Order statistics, running sums, burnt lines, obstructions and reach flows against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riverframe.operators import burn, order, structures, terrain


@pytest.mark.parametrize("keys", [["k"], []])
def test_order_statistics(spark, keys):
    rng = random.Random(2)
    values = {"a": [rng.choice([3.0, 3.0, 3.0, rng.random() * 9]) for _ in range(1500)], "b": [7.0], "c": [float(i) for i in range(250)]}
    rows = [(k, v) for k, x in values.items() for v in x] + [("a", None), ("d", None), ("a", float("nan"))]
    shares = [0.0, 0.004, 0.5, 0.996, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r.k if keys else None, r.share): (r.n, r.v) for r in order.order_statistics(df, keys, "v", shares).collect()}
    groups = values if keys else {None: [v for x in values.values() for v in x]}
    want = {(k, s): (len(x), sorted(x)[math.floor(s * (len(x) - 1) + 0.5)]) for k, x in groups.items() for s in shares}
    assert got == want
    assert order.order_statistics(df.limit(0), keys, "v", shares).collect() == []


def test_only_ranges_with_a_rank_are_put_in_order(spark, monkeypatch):
    """The last join reads no more than the ranges that hold an asked rank."""
    kept = []
    real = order.cut
    monkeypatch.setattr(order, "cut", lambda df: kept.append(real(df)) or kept[-1])
    monkeypatch.setattr(order, "drop", lambda *t: None)
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share one range
    try:
        found = order.order_statistics(df, [], "v", [0.004, 0.996]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.share: r.v for r in found} == {0.004: 80.0, 0.996: 19919.0}
    placed, wanted = kept[0], kept[1]
    assert placed.select("__part").distinct().count() > 2 and wanted.select("__part").distinct().count() <= 2


def test_robust_box(spark):
    points = [("a", float(i), float(-i)) for i in range(1000)] + [("a", 1e12, 5.0), ("a", None, 3.0), ("a", float("inf"), 3.0), ("b", 2.0, 3.0)]
    got = {r.k: (r.min_x, r.max_x, r.min_y, r.max_y) for r in order.robust_box(spark.createDataFrame(points, "k string, x double, y double"), ["k"]).collect()}
    ys = sorted([float(-i) for i in range(1000)] + [5.0])
    assert got == {"a": (4.0, 996.0, ys[4], ys[996]), "b": (2.0, 2.0, 3.0, 3.0)}


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, float(rng.randint(0, 9))) for i in range(500)]
    rng.shuffle(rows)
    got = {(r.k, r.i): r.run_w for r in order.running_sums(spark.createDataFrame(rows, "k string, i int, w double"), ["k"], ["i"], ["w"]).collect()}
    assert got == {(k, i): sum(w for q, j, w in rows if q == k and j <= i) for k, i, _ in rows}


def test_bands_below_lines(spark):
    rng = random.Random(5)
    bands = [(rng.choice("ab"), lo := rng.randint(0, 50) * 1.0, lo + rng.choice([5.0, 20.0]), rng.random()) for _ in range(200)] + [("a", 3.0, 3.0, 9.0)]
    lines = [(rng.choice("ab"), i, rng.uniform(-5, 80)) for i in range(60)] + [("b", 60, 20.0), ("b", 61, 20.0)]
    b, x = spark.createDataFrame(bands, "k string, lo double, hi double, area double"), spark.createDataFrame(lines, "k string, basin int, line double")
    got = {r.basin: (r.below, r.above) for r in order.below_lines(b, x, ["k"]).collect()}
    pairs = b.filter("hi > lo").join(x, "k")
    want = {r.basin: (r.below, r.above) for r in terrain.hypsometric_split(pairs, F.col("line"), ["basin"]).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def plain_burn(lines, points, f):
    grid, hard = {}, set()

    def node(x, y):
        r, c = math.floor((y - f["y0"]) / f["dy"] + 0.5), math.floor((x - f["x0"]) / f["dx"] + 0.5)
        return (r, c) if 0 <= r < f["ny"] and 0 <= c < f["nx"] else None

    for line in lines:
        for a, b in zip(line, line[1:]):
            n = max(1, math.ceil(math.hypot(b[0] - a[0], b[1] - a[1]) / min(f["dx"], f["dy"])))
            for i in range(n + 1):
                t = i / n
                p = node(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                if p:
                    grid[p] = a[2] + t * (b[2] - a[2])
                    hard.add(p)
    for x, y, z in points:
        p = node(x, y)
        if p and p not in grid:
            grid[p] = z
    return grid


def test_burning_against_a_loop(spark):
    rng = random.Random(9)
    lines = [[(rng.uniform(0, 60), rng.uniform(0, 40), rng.random()) for _ in range(6)] for _ in range(5)] + [[(1.0, 1.0, 5.0)] * 2, [(3.0, 3.0, 1.0)]]
    points = [(rng.uniform(-20, 80), rng.uniform(-5, 45), rng.random()) for _ in range(150)]
    L = spark.createDataFrame([("g", i, v, *p) for i, line in enumerate(lines) for v, p in enumerate(line)], "k string, line int, v int, x double, y double, z double").repartition(3)
    P = spark.createDataFrame([("g", i, *p) for i, p in enumerate(points)], "k string, point int, x double, y double, z double").repartition(2)
    frames = burn.frame(L.select("k", "x", "y").unionByName(P.select("k", "x", "y")), ["k"], 1.0, 700)
    f = frames.first().asDict()
    assert f["nx"] * f["ny"] <= 800 and f["dx"] > 1.3
    got = {(r.row, r.col): r.z for r in burn.burn(L, P, frames, ["k"]).collect()}
    want = plain_burn(lines, points, f)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    grid = {(r.row, r.col): r.z for r in burn.survey_grid(L, P, "k", 1.0, 700).collect()}
    assert len(grid) == f["nx"] * f["ny"] and all(grid[p] == pytest.approx(want[p]) for p in want)
    assert all(z is not None and min(want.values()) - 1e-6 <= z <= max(want.values()) + 1e-6 for z in grid.values())
    default = burn.frame(L, ["k"]).first()
    assert default.nx * default.ny < 500_000 and default.dx == pytest.approx(0.5, rel=0.05)


def inside(p, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [3.0, 17.0, 500.0])
def test_obstructions_against_fine_samples(spark, cell):
    rng = random.Random(1)
    rings = {}
    for i in range(14):
        x, y, r = rng.uniform(0, 100), rng.uniform(0, 40), rng.uniform(2, 9)
        rings[i] = [(x + r * math.cos(a), y + r * math.sin(a)) for a in (0.1, 1.4, 2.2, 3.9, 5.2)]
    rings[14] = list(rings[0])  # twice the same pier
    lines = {s: [(25.0 * v + rng.random(), rng.uniform(5, 35)) for v in range(5)] for s in range(6)}
    lines[6] = [(rings[1][0][0] * 0.5 + rings[1][2][0] * 0.5, rings[1][0][1] * 0.5 + rings[1][2][1] * 0.5), (300.0, 20.0)]  # begins inside
    lines[7] = [(500.0, 500.0), (600.0, 600.0)]
    kinds = {i: "deck" if i % 5 == 3 else "pier" for i in rings}
    S = spark.createDataFrame([(s, v, *p) for s, line in lines.items() for v, p in enumerate(line)], "section_id int, v int, x double, y double")
    T = spark.createDataFrame([(i, kinds[i], [{"lon": x, "lat": y} for x, y in ring], 2.0 + i, None if i % 2 else 1.5) for i, ring in rings.items()], "structure_id int, kind string, ring array<struct<lon:double,lat:double>>, soffit double, thickness double")
    got = {r.section_id: r for r in structures.obstructions(S, T, cell).collect()}
    assert 7 not in got
    for s, line in lines.items():
        step, at, met = 0.004, 0.0, {i: 0.0 for i in rings}
        together = 0.0
        for a, b in zip(line, line[1:]):
            n = max(1, int(math.hypot(b[0] - a[0], b[1] - a[1]) / step))
            d = math.hypot(b[0] - a[0], b[1] - a[1]) / n
            for k in range(n) if s < 7 and len(line) < 9 else []:
                t = (k + 0.5) / n
                hit = [i for i in rings if abs(a[0] + t * (b[0] - a[0]) - rings[i][0][0]) < 30 and inside((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])), rings[i])]
                for i in hit:
                    met[i] += d
                together += d if any(kinds[i] == "pier" for i in hit) else 0.0
            at += d * n
        if s in got:
            r = got[s]
            assert r.blocked == pytest.approx(together, abs=0.1)
            piers = {i: m for i, m in met.items() if kinds[i] == "pier" and m > 0}
            if piers:
                assert r.widest == pytest.approx(max(piers.values()), abs=0.05)
            decks = [i for i, m in met.items() if kinds[i] == "deck" and m > 0.02]
            if decks:
                assert r.soffit == min(2.0 + i for i in decks) and r.crest == max(2.0 + i + (0.8 if i % 2 else 1.5) for i in decks)
        else:
            assert together < 0.02


def test_overlapping_piers_count_once(spark):
    rows = [("a", 0.0, 4.0), ("a", 2.0, 3.0), ("a", 3.0, 7.0), ("a", 9.0, 10.0), ("b", 1.0, 1.5), ("b", 1.0, 1.5), ("c", 0.0, 2.0), ("c", 2.0, 3.0)]
    got = {r.section_id: (r.blocked, r.n) for r in structures.blocked(spark.createDataFrame(rows, "section_id string, s_from double, s_to double")).collect()}
    assert got == {"a": (8.0, 2), "b": (0.5, 1), "c": (3.0, 1)}
    x = {k: F.lit(v) for k, v in {"flow": 100.0, "area": 50.0, "width": 20.0, "blocked_width": 18.0, "level": 3.0, "soffit": 2.5, "crest": 2.0}.items()}
    r = spark.range(1).select(*[c.alias(n) for n, c in structures.narrowed(**x).items()]).first()
    assert (r.width, r.velocity, r.submerged, r.z_low, r.z_crest) == (4.0, 10.0, True, 2.5, 3.3)


def test_deck_over_pieces(spark):
    decks = spark.createDataFrame([(2, [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0))]), (1, [{"lon": x, "lat": y} for x, y in ((5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0))])], "structure_id int, ring array<struct<lon:double,lat:double>>")
    pieces = spark.createDataFrame([(10, 1.0, 1.0), (11, 7.0, 7.0), (12, 30.0, 1.0)], "piece_id int, x double, y double")
    assert {r.piece_id: r.structure_id for r in structures.deck_over(pieces, decks, 4.0).collect()} == {10: 2, 11: 1}


def test_effective_flows(spark):
    reaches = spark.createDataFrame([("h1", 1.0), ("h2", 2.0), ("h3", None), ("m", 50.0), ("n", 60.0), ("out", 70.0), ("c1", 5.0), ("c2", 6.0), ("below", 7.0), ("mixed", 8.0), ("loop", 9.0), ("alone", 4.0)], "reach string, q double")
    # A diamond, a headwater without flow, a cycle with nothing above it, a cycle that a headwater feeds, a loop of one.
    joins = [("m", "h1"), ("m", "h2"), ("n", "h2"), ("n", "h3"), ("out", "m"), ("out", "n"), ("c1", "c2"), ("c2", "c1"), ("below", "c1"), ("mixed", "h1"), ("mixed", "loop"), ("loop", "loop"), ("out", "unknown"), ("out", "m")]
    got = {r.reach: (r.q, r.sources, r.state) for r in structures.effective_flows(reaches, spark.createDataFrame(joins, "reach string, source string"), default=10.0).collect()}
    assert got == {"h1": (1.0, 1, "own"), "h2": (2.0, 1, "own"), "h3": (10.0, 1, "own"), "m": (3.0, 2, "sum"), "n": (12.0, 2, "sum"), "out": (13.0, 3, "sum"), "c1": (None, 0, "cycle"), "c2": (None, 0, "cycle"), "below": (None, 0, "fed by a cycle"), "mixed": (1.0, 1, "sum"), "loop": (None, 0, "cycle"), "alone": (4.0, 1, "own")}
