"""Channel hydraulics, scour, sediment and works over line items as flow cases."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import river
from ..operators import culverts, hydraulics, scour
from . import bindings as b
from .registry import query

KEY = ("l_orderkey", "l_linenumber")
KEYS = "l_orderkey, l_linenumber"


@query(f"""WITH {b.CASES}, c AS (SELECT *, CASE WHEN h * v <= 0.30 AND h <= 0.30 AND v <= 2.0 THEN 'H1' WHEN h * v <= 0.60 AND h <= 0.50 AND v <= 2.0 THEN 'H2' WHEN h * v <= 0.60 AND h <= 1.20 AND v <= 2.0 THEN 'H3'
  WHEN h * v <= 1.00 AND h <= 2.00 AND v <= 2.0 THEN 'H4' WHEN h * v <= 4.00 AND h <= 4.00 AND v <= 4.0 THEN 'H5' ELSE 'H6' END AS class FROM cas)
SELECT class, count(*) AS n, round(max(h * v), 6) AS worst FROM c WHERE h > 0.02 GROUP BY class""")
def hazard_classes(spark, sf_dir):
    c = b.flow_cases(spark, sf_dir).filter("h > 0.02")
    return c.groupBy(river.hazard_class(F.col("h"), F.col("v")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("h") * F.col("v")), 6).alias("worst"))


@query(f"""WITH {b.CASES}, f AS (SELECT *, v / sqrt(9.81 * h) AS fr FROM cas),
m AS (SELECT {KEYS}, 2 * 1.0 * 1.1 * h * power(a / h, 0.65) * power(fr, 0.43) AS csu, 0.32 * power(a, 0.62) * power(h, 0.47) * power(greatest(fr, 1e-3), 0.22) * power(greatest(d50, 0.2) / 1000, -0.09) AS fro,
  1.35 * power(a, 0.7) * power(h, 0.3) AS lau, 1.5 * a * tanh(h / a) AS bre, 1.05 * power(a, 0.75) AS lar FROM f)
SELECT {KEYS}, round(greatest(csu, fro, lau, bre, lar), 5) AS envelope, round((csu + fro + lau + bre + lar) / 5, 5) AS mean FROM m""")
def scour_envelope(spark, sf_dir):
    c = b.flow_cases(spark, sf_dir)
    zero = F.lit(0.0)
    s = river.pier_scour(F.col("a"), F.col("h"), F.col("v") / F.sqrt(river.G * F.col("h")), F.col("d50"), F.lit("circular"), zero, zero, F.lit(1.1))
    return c.select(*KEY, F.round(s["envelope"], 5).alias("envelope"), F.round(s["mean"], 5).alias("mean"))


@query(f"""WITH {b.CASES}, n AS (SELECT {KEYS}, h, q / b AS qu, d50 / 1000 AS d FROM cas)
SELECT {KEYS}, round(greatest(0, power(qu / (1.58 * sqrt(1.65 * 9.81 * d) * power(d, -1.0 / 6)), 6.0 / 7) - h), 4) AS scour FROM n""")
def general_scour_neill(spark, sf_dir):
    c = b.flow_cases(spark, sf_dir)
    return c.select(*KEY, F.round(F.greatest(F.lit(0.0), river.neill_depth(F.col("q") / F.col("b"), F.col("d50")) - F.col("h")), 4).alias("scour"))


@query(f"""WITH {b.CASES}, s AS (SELECT {KEYS}, h, v, j, d50 / 1000 AS d, 1000 * 9.81 * h * j AS tau FROM cas),
t AS (SELECT *, tau / (1.65 * 1000 * 9.81 * d) AS th FROM s)
SELECT {KEYS}, round(tau, 4) AS tau, round(th, 6) AS shields, th > 0.047 AS moves, round(CASE WHEN th > 0.047 THEN 8 * power(th - 0.047, 1.5) * sqrt(1.65 * 9.81 * power(d, 3)) ELSE 0 END, 8) AS bed_load,
  round(0.1 * power(th, 2.5) / (2 * 9.81 * h * j / (v * v)) * sqrt(1.65 * 9.81 * power(d, 3)), 8) AS total_load, round(1.1 * sqrt(1.65 * 9.81 * d) / (0.4 * sqrt(9.81 * h * j)), 5) AS rouse FROM t""")
def sediment_transport(spark, sf_dir):
    h, v, j, d = F.col("h"), F.col("v"), F.col("j"), F.col("d50") / 1000
    tau = river.bed_shear(h, j)
    th = river.shields(tau, d)
    return b.flow_cases(spark, sf_dir).select(
        *KEY, F.round(tau, 4).alias("tau"), F.round(th, 6).alias("shields"), (th > 0.047).alias("moves"), F.round(river.meyer_peter_muller(h, j, d), 8).alias("bed_load"),
        F.round(river.engelund_hansen(h, v, j, d), 8).alias("total_load"), F.round(river.rouse_number(river.fall_velocity(d), F.sqrt(river.G * h * j)), 5).alias("rouse"),
    )


@query(f"""WITH RECURSIVE {b.CASES}, c AS (SELECT {KEYS}, q / 10 AS q, b, j FROM cas),
r AS (SELECT *, 0 AS i, 0.0::DOUBLE AS lo, 200.0::DOUBLE AS hi FROM c UNION ALL
  SELECT {KEYS}, q, b, j, i + 1, CASE WHEN small THEN mid ELSE lo END, CASE WHEN small THEN hi ELSE mid END FROM (SELECT *, (lo + hi) / 2 AS mid,
    b * ((lo + hi) / 2) * power(b * ((lo + hi) / 2) / (b + 2 * ((lo + hi) / 2)), 2.0 / 3) * sqrt(j) / 0.035 < q AS small FROM r WHERE i < 80))
SELECT {KEYS}, round((lo + hi) / 2, 6) AS depth FROM r WHERE i = 80""")
def rectangular_normal_depth(spark, sf_dir):
    c = b.flow_cases(spark, sf_dir)
    return c.select(*KEY, F.round(river.rectangular_normal_depth(F.col("q") / 10, F.col("b"), F.lit(0.035), F.col("j")), 6).alias("depth"))


@query(f"WITH {b.CASES} SELECT {KEYS}, round(cbrt(q * q / (b * b * 9.81)), 6) AS depth FROM cas")
def critical_depth_box(spark, sf_dir):
    return b.flow_cases(spark, sf_dir).select(*KEY, F.round(river.critical_depth_box(F.col("q"), F.col("b")), 6).alias("depth"))


@query(f"""WITH {b.SECTIONS}, s AS (SELECT {KEYS}, b, h * j / (1.65 * d50 / 1000) AS th, d50 / 1000 AS d FROM sec),
q AS (SELECT {KEYS}, b, CASE WHEN th > 0.047 THEN 8 * power(th - 0.047, 1.5) * sqrt(1.65 * 9.81 * power(d, 3)) ELSE 0 END AS qs FROM s),
g AS (SELECT *, coalesce((qs - lag(qs) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) / nullif((l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) * 100.0, 0), 0) AS grad FROM q)
SELECT {KEYS}, round(grad, 9) + 0.0 AS grad, round(-1 / 0.6 / b * grad * 86400, 6) + 0.0 AS mm_day FROM g""")
def transport_gradient(spark, sf_dir):
    return hydraulics.transport_gradient(b.sections(spark, sf_dir), ["l_orderkey"], "l_linenumber").select(*KEY, (F.round("grad", 9) + 0.0).alias("grad"), (F.round(F.col("dzdt") * 86400, 6) + 0.0).alias("mm_day"))


@query(f"""WITH {b.CASES}, c AS (SELECT *, greatest(d50, 0.1) / 1000 AS d FROM cas),
s AS (SELECT {KEYS}, h, j, b, d, h * j / (1.65 * d) AS th, (j - j * power(0.5, 1 / 1.5)) * 1000 AS dz, 2 * (h * j / (0.047 * 1.65)) * (1 / 0.1 - 1) AS arm FROM c),
m AS (SELECT *, CASE WHEN th > 0.047 THEN 8 * power(th - 0.047, 1.5) * sqrt(1.65 * 9.81 * power(d, 3)) ELSE 0 END * b AS cap FROM s)
SELECT {KEYS}, round(CASE WHEN dz > 1e-3 AND cap > 1e-6 THEN least(dz, arm) ELSE 0 END, 6) AS degradation FROM m""")
def long_term_degradation(spark, sf_dir):
    r = river.long_term_degradation(F.col("h"), F.col("j"), F.col("b"), F.col("d50"), F.lit(1000.0), F.lit(0.5), F.lit(0.1))
    return b.flow_cases(spark, sf_dir).select(*KEY, F.round(r["degradation"], 6).alias("degradation"))


@query(f"""WITH {b.CASES}, k AS (SELECT {KEYS}, h, v, v / sqrt(9.81 * greatest(h, 1e-3)) AS fr, sqrt(1 - power(sin(atan2(1.0, 2.0)) / sin(radians(40.0)), 2)) AS k1 FROM cas)
SELECT {KEYS}, round(v * v / (0.86 * 0.86 * 19.62 * 1.65), 6) AS isbash, round(1.2 * 1.1 * 0.30 * h * power(v / sqrt(k1 * 1.65 * 9.81 * h), 2.5), 6) AS maynord,
  round(0.692 * power(1.5 * v, 2) / (1.65 * 19.62), 6) AS pier, round((CASE WHEN fr <= 0.8 THEN 0.89 * fr * fr ELSE 0.61 * power(fr, 0.14) END) / 1.65 * h, 6) AS abutment FROM k""")
def riprap_sizes(spark, sf_dir):
    h, v, no = F.col("h"), F.col("v"), F.lit(False)
    return b.flow_cases(spark, sf_dir).select(*KEY, F.round(river.riprap_isbash(v), 6).alias("isbash"), F.round(river.riprap_maynord(v, h, F.lit(2.0)), 6).alias("maynord"), F.round(river.riprap_pier(v, no), 6).alias("pier"), F.round(river.riprap_abutment(v, h, no), 6).alias("abutment"))


def _mo(psi: str) -> str:
    return f"(power(cos(f - {psi}), 2) / (cos({psi}) * cos(d + {psi}) * power(1 + sqrt(greatest(0, sin(f + d) * sin(f - {psi}) / cos(d + {psi}))), 2)))"


@query(f"""WITH w AS (SELECT s_suppkey AS id, 3.0 + s_suppkey % 6 AS h, radians(30.0 + s_suppkey % 8) AS f, radians((30.0 + s_suppkey % 8) / 2) AS d, atan(0.1 + (s_suppkey % 3) * 0.05) AS p FROM supplier)
SELECT id, round({_mo("0.0")}, 6) AS ka, round({_mo("p")}, 6) AS kae, round(0.5 * 19 * h * h * {_mo("0.0")}, 4) AS thrust FROM w""")
def wall_thrust(spark, sf_dir):
    k = F.col("s_suppkey")
    phi, kh = 30.0 + k % 8, 0.1 + (k % 3) * 0.05
    w = river.wall_check(3.0 + k % 6, F.lit(19.0), phi, phi / 2, kh, F.lit(300.0), F.lit(3.0))
    return b.read(spark, sf_dir, "supplier").select(k.alias("id"), F.round(w["ka"], 6).alias("ka"), F.round(w["kae"], 6).alias("kae"), F.round(w["static"], 4).alias("thrust"))


@query(f"""WITH {b.SECTIONS}, p AS (SELECT l_orderkey, l_linenumber * 10.0 AS s, 20.0 - 2 * h AS z, lead(l_linenumber * 10.0) OVER o AS s2, lead(20.0 - 2 * h) OVER o AS z2 FROM sec WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
c AS (SELECT l_orderkey, s2 - s AS ds, 15.0 - z AS a, 15.0 - z2 AS c FROM p WHERE s2 IS NOT NULL),
w AS (SELECT l_orderkey, greatest(a, 0) AS ha, greatest(c, 0) AS hc, CASE WHEN a > 0 AND c > 0 THEN ds WHEN a <= 0 AND c <= 0 THEN 0 ELSE ds * greatest(a, c) / abs(a - c) END AS wet, CASE WHEN a > 0 OR c > 0 THEN 1 ELSE 0 END AS k FROM c)
SELECT l_orderkey, round(sum((ha + hc) / 2 * wet), 5) AS area, round(sum(CASE WHEN k = 1 THEN sqrt(wet * wet + (ha - hc) * (ha - hc)) ELSE 0 END), 5) AS perimeter, round(sum(wet), 5) AS width FROM w GROUP BY l_orderkey""")
def section_properties(spark, sf_dir):
    c = b.sections(spark, sf_dir).select("l_orderkey", (F.col("l_linenumber") * 10.0).alias("s"), (20.0 - 2 * F.col("h")).alias("z"))
    p = hydraulics.section_properties(c, ["l_orderkey"], F.lit(15.0))
    return p.select("l_orderkey", *[F.round(x, 5).alias(x) for x in ("area", "perimeter", "width")])


# The backwater query's section, 20 wide with walls of 30 to 1, at a depth y; n 0.035, flow 50.
def _bw_area(y: str) -> str:
    return f"(20 * {y} + {y} * {y} / 30)"


def _bw_friction(y: str) -> str:
    return f"power(50.0 * 0.035 / ({_bw_area(y)} * power({_bw_area(y)} / (20 + 2 * {y} * sqrt(1 + 1.0 / 900)), 2.0 / 3)), 2)"


def _bw_head(y: str) -> str:
    return f"(power(50.0 / {_bw_area(y)}, 2) / 19.62)"


def _halved(lo: str, hi: str, below: str, steps: int, extra: str = "") -> str:
    """A fold that halves an interval; below is a condition on (a.lo + a.hi) / 2. extra: further fields, the same in every element."""
    first = f"{{'lo': ({lo})::DOUBLE, 'hi': ({hi})::DOUBLE{extra}}}"
    keep = "".join(f", {name}: a.{name}" for name in re.findall(r", (\w+):", extra))
    m = "((a.lo + a.hi) / 2)"
    return f"list_reduce([{first}] || list_transform(range({steps}), lambda i: {first}), lambda a, k: CASE WHEN {below} THEN {{lo: {m}, hi: a.hi{keep}}} ELSE {{lo: a.lo, hi: {m}{keep}}} END)"


_M = "((a.lo + a.hi) / 2)"
_Y = f"({_M} - a.zb)"
_MISS = f"{_M} + {_bw_head(_Y)} - (a.e0 + (a.s0 + {_bw_friction(_Y)}) / 2 * 100 + CASE WHEN a.v0 > {_bw_head(_Y)} THEN 0.1 ELSE 0.3 END * abs(a.v0 - {_bw_head(_Y)})) < 0"
_AT = "zb + yc"


@query(f"""WITH RECURSIVE {b.SECTIONS}, n AS (SELECT (x.lo + x.hi) / 2 AS yn FROM (SELECT {_halved("0", "4", f"{_bw_area(_M)} * power({_bw_area(_M)} / (20 + 2 * {_M} * sqrt(1 + 1.0 / 900)), 2.0 / 3) * sqrt(0.002) / 0.035 < 50", 80)} AS x)),
c AS (SELECT (x.lo + x.hi) / 2 AS yc FROM (SELECT {_halved("1e-6", "100", f"2500 * (20 + {_M} / 15) / (9.81 * power({_bw_area(_M)}, 3)) > 1", 90)} AS x)),
o AS (SELECT l_orderkey AS k, l_linenumber, 10.0::DOUBLE - l_linenumber * 0.2::DOUBLE AS zb, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS i, yn, yc FROM sec, n, c),
r AS (SELECT k, i, zb, zb + greatest(yn, yc) AS w FROM o WHERE i = 1 UNION ALL
  SELECT k, i, zb, CASE WHEN {_AT} + {_bw_head("yc")} - (e0 + (s0 + {_bw_friction("yc")}) / 2 * 100 * gap + CASE WHEN v0 > {_bw_head("yc")} THEN 0.1 ELSE 0.3 END * abs(v0 - {_bw_head("yc")})) < 0 THEN (x.lo + x.hi) / 2 ELSE {_AT} END
  FROM (SELECT *, {_halved(_AT, f"{_AT} + 100", _MISS.replace("* 100 +", "* 100 * a.gap +"), 80, ", zb: zb, e0: e0, v0: v0, s0: s0, gap: gap")} AS x
    FROM (SELECT o.k, o.i, o.zb, o.yc, (r.zb - o.zb) / -0.2 AS gap, r.w + {_bw_head("(r.w - r.zb)")} AS e0, {_bw_head("(r.w - r.zb)")} AS v0, {_bw_friction("(r.w - r.zb)")} AS s0 FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1))),
f AS (SELECT o.k AS reach, o.l_linenumber * 100.0::DOUBLE AS station, w, w - o.zb AS y FROM r JOIN o ON o.k = r.k AND o.i = r.i)
SELECT reach, station, round(w, 5) AS level, round(y, 5) AS depth, round({_bw_area("y")}, 4) AS area, round(20 + y / 15, 5) AS width, round(50 / {_bw_area("y")}, 6) AS v, round(50 / {_bw_area("y")} / sqrt(9.81 * {_bw_area("y")} / (20 + y / 15)), 6) AS fr, round(w + {_bw_head("y")}, 5) AS energy FROM f""")
def backwater_profile(spark, sf_dir):
    """A reach per order, its line items as sections a hundred metres apart."""
    c = b.sections(spark, sf_dir)
    z = 10.0 - F.col("l_linenumber") * 0.2
    pts = F.array(*[F.struct(F.lit(float(s)).alias("s"), (z + dz).alias("z")) for s, dz in ((0, 30), (1, 0), (21, 0), (22, 30))])
    out = hydraulics.backwater(c.select(F.col("l_orderkey").alias("reach"), (F.col("l_linenumber") * 100.0).alias("station"), pts.alias("pts")), "reach", flow=50.0)
    return out.select("reach", F.col("station").cast("double").alias("station"), *[F.round(x, n).alias(x) for x, n in (("level", 5), ("depth", 5), ("area", 4), ("width", 5), ("v", 6), ("fr", 6), ("energy", 5))])


@query("""WITH c AS (SELECT s_suppkey AS id, 1.0::DOUBLE + s_suppkey % 3 AS w, 1.5::DOUBLE AS d FROM supplier),
q AS (SELECT *, w * d * sqrt(2 * 9.81 * d) * i / 24 AS q FROM c, range(1, 25) r(i)),
y AS (SELECT *, 1.811 * q / (w * d * sqrt(d)) AS x, least(d, cbrt(q * q / (w * w * 9.81))) AS yc FROM q),
e AS (SELECT *, d * ((yc + power(q / (w * yc), 2) / 19.62) / d + 0.0098 * power(x, 2) - 0.5 * 0.01) AS fr, d * (0.0398 * x * x + 0.67 - 0.5 * 0.01) AS fu,
  (yc + d) / 2 + power(q / (w * d), 2) / 19.62 * (1 + 0.5 + 19.62 * 0.013 * 0.013 * 20 / power(w * d / (2 * (w + d)), 4.0 / 3)) - 0.01 * 20 AS o FROM y),
h AS (SELECT *, CASE WHEN x <= 3.5 THEN fr WHEN x >= 4.0 THEN fu ELSE fr + (fu - fr) * ((x - 3.5) / 0.5) END AS ic FROM e)
SELECT id, round(q, 6) AS q, round(ic, 6) AS inlet, round(o, 6) AS outlet, round(greatest(ic, o), 6) AS headwater FROM h""")
def culvert_rating(spark, sf_dir):
    c = b.read(spark, sf_dir, "supplier")
    rated = hydraulics.culvert_rating(c.select(F.col("s_suppkey").alias("id"), (1.0 + F.col("s_suppkey") % 3).cast("double").alias("width"), F.lit(1.5).alias("height"), F.lit(20.0).alias("length"), F.lit(0.01).alias("slope"), F.lit(0.013).alias("n")), ["id"])
    return rated.select("id", *[F.round(x, 6).alias(x) for x in ("q", "inlet", "outlet", "headwater")])


@query()
def swe2d_dambreak(spark, sf_dir):
    """One dam break per nation, by its own upstream depth."""
    n = b.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scenario"), (1.0 + F.col("n_nationkey") % 5).alias("depth"))
    return hydraulics.dam_break(n, "scenario", cells=100, dx=10.0, seconds=30.0)


@query(f"WITH {b.CASES} SELECT l_orderkey, (sum(q))::DOUBLE AS total, count(*) AS n FROM (SELECT l_orderkey, round(q, 2) AS q FROM cas) z GROUP BY 1 QUALIFY row_number() OVER (ORDER BY sum(q) DESC, l_orderkey) <= 10")
def largest_reaches(spark, sf_dir):
    c = b.flow_cases(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(F.round("q", 2)).alias("total"), F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("total").desc(), "l_orderkey").limit(10)


@query(f"""WITH {b.CASES}, k AS (SELECT {KEYS}, power(h, 5.0 / 3) * b AS k FROM cas)
SELECT {KEYS}, round(k / sum(k) OVER (PARTITION BY l_orderkey), 8) AS share FROM k""")
def conveyance_shares(spark, sf_dir):
    k = river.power(F.col("h"), 5 / 3) * F.col("b")
    return b.flow_cases(spark, sf_dir).select(*KEY, F.round(k / F.sum(k).over(Window.partitionBy("l_orderkey")), 8).alias("share"))


def _culverts(spark, sf_dir):
    k = F.col("s_suppkey")
    return b.read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, culverts.TYPES)), (k % 9 + 1).cast("int")).alias("kind"), (0.8 + (k % 5) * 0.3).alias("height"), F.when(k % 2 == 0, 1.0 + k % 3).alias("width"), (20.0 + k % 30).alias("length"),
        ((k % 5) * 0.005).alias("slope"), F.when(k % 7 == 0, 0.02).alias("n"), F.when(k % 3 > 0, (k % 3) * 0.5).alias("tailwater"), (0.5 + (k % 40) / 4).alias("flow"), (1 + k % 3).alias("barrels"),
    )


def _kinds(field: str) -> str:
    i = culverts.FIELDS.index(field)
    return "CASE kind " + " ".join(f"WHEN '{name}' THEN {row[i]!r}" for name, row in culverts.TYPES.items()) + " END"


_TH = "(2 * acos(greatest(-1, least(1, (d / 2 - {y}) / (d / 2)))))"


def _area(y: str) -> str:
    y = f"greatest(0, least({y}, d))"
    th = _TH.format(y=y)
    return f"(CASE WHEN box THEN w * {y} ELSE d * d / 8 * ({th} - sin({th})) END)"


def _carried(y: str) -> str:
    inner = f"greatest(0, least({y}, d))"
    wet = f"(CASE WHEN box THEN w + 2 * {inner} ELSE CASE WHEN {_TH.format(y=inner)} = 0 THEN 1e-6 ELSE d / 2 * {_TH.format(y=inner)} END END)"
    return f"({_area(y)} * power({_area(y)} / {wet}, 2.0 / 3) * sqrt(s) / n)"


_MID = "((lo + hi) / 2)"
_CUBE = f"power({_area(_MID).replace('CASE WHEN box THEN', 'CASE WHEN false THEN')}, 3) / (CASE WHEN sin({_TH.format(y=_MID)} / 2) = 0 THEN 1e-6 ELSE d * sin({_TH.format(y=_MID)} / 2) END)"


@query(f"""WITH RECURSIVE c0 AS (SELECT s_suppkey AS id, {list(culverts.TYPES)!r}[s_suppkey % 9 + 1] AS kind, 0.8::DOUBLE + (s_suppkey % 5) * 0.3::DOUBLE AS d, CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE + s_suppkey % 3 END AS w0, 20.0::DOUBLE + s_suppkey % 30 AS l, (s_suppkey % 5) * 0.005::DOUBLE AS s,
  CASE WHEN s_suppkey % 7 = 0 THEN 0.02::DOUBLE END AS n0, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 3) * 0.5::DOUBLE END, 0) AS tw, 0.5::DOUBLE + (s_suppkey % 40)::DOUBLE / 4 AS flow, 1 + s_suppkey % 3 AS barrels FROM supplier),
c AS (SELECT *, {_kinds('shape')} = 'box' AS box, coalesce(n0, {_kinds('n')})::DOUBLE AS n, CASE WHEN {_kinds('shape')} = 'box' THEN coalesce(w0, d) ELSE d END AS w, flow / barrels AS q FROM c0),
kc AS (SELECT id, 0 AS i, d, w, false AS box, q, 1e-4::DOUBLE AS lo, d AS hi FROM c UNION ALL SELECT id, i + 1, d, w, box, q, CASE WHEN {_CUBE} < q * q / 9.81 THEN {_MID} ELSE lo END, CASE WHEN {_CUBE} < q * q / 9.81 THEN hi ELSE {_MID} END FROM kc WHERE i < 60),
kn AS (SELECT id, 0 AS i, d, w, box, q, s, n, 1e-4::DOUBLE AS lo, d AS hi FROM c UNION ALL SELECT id, i + 1, d, w, box, q, s, n, CASE WHEN {_carried(_MID)} < q THEN {_MID} ELSE lo END, CASE WHEN {_carried(_MID)} < q THEN hi ELSE {_MID} END FROM kn WHERE i < 60),
e AS (SELECT c.*, CASE WHEN c.box THEN least(c.d, cbrt(c.q * c.q / (c.w * c.w * 9.81))) ELSE (kc.lo + kc.hi) / 2 END AS dc, CASE WHEN c.s <= 0 THEN 0 WHEN {_carried('c.d').replace('box', 'c.box').replace(' d)', ' c.d)').replace('w *', 'c.w *').replace('w +', 'c.w +').replace('d * d', 'c.d * c.d').replace('d / 2', 'c.d / 2').replace('sqrt(s) / n', 'sqrt(c.s) / c.n')} < c.q THEN c.d ELSE (kn.lo + kn.hi) / 2 END AS dn
  FROM c JOIN kc ON kc.id = c.id AND kc.i = 60 JOIN kn ON kn.id = c.id AND kn.i = 60),
f AS (SELECT *, CASE WHEN box THEN w * d ELSE pi() * d * d / 4 END AS af, CASE WHEN box THEN w * d / (2 * (w + d)) ELSE d / 4 END AS rf, CASE WHEN {_kinds('mitered')} THEN 0.7 * s ELSE -0.5 * s END AS sc, q / {_area('least(dc, d * 0.999)')} AS vc FROM e),
g AS (SELECT *, 1.811::DOUBLE * q / (af * sqrt(d)) AS x, q / af AS v FROM f),
h AS (SELECT *, (dc + vc * vc / 19.62) / d + {_kinds('k')} * power(x, {_kinds('m')}) + sc AS fr, {_kinds('c')} * x * x + {_kinds('y')} + sc AS dr FROM g),
j AS (SELECT *, greatest(0, CASE WHEN x <= 3.5 THEN fr WHEN x >= 4.0 THEN dr ELSE fr * (1 - (x - 3.5) / 0.5) + dr * ((x - 3.5) / 0.5) END) * d AS inlet, greatest(tw, (least(dc, d) + d) / 2) + (1 + {_kinds('ke')} + 19.62 * n * n * l / power(rf, 4.0 / 3)) * v * v / 19.62 - s * l AS outlet FROM h)
SELECT id, round(dc, 6) AS dc, round(dn, 6) AS dn, round(inlet, 6) AS inlet, round(outlet, 6) AS outlet, CASE WHEN inlet >= outlet THEN 'inlet' ELSE 'outlet' END AS control, round(greatest(0, inlet, outlet), 6) AS headwater, greatest(0, inlet, outlet) / d > 1.2 AS submerged,
  round(CASE WHEN inlet < outlet THEN v WHEN dn > 0 THEN q / {_area('least(dn, d * 0.999)')} ELSE 0 END, 5) AS v_out FROM j""")
def culvert_design(spark, sf_dir):
    """A culvert of one of nine types per supplier."""
    r = culverts.design(_culverts(spark, sf_dir))
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("dc", "dn", "inlet", "outlet")], "control", F.round("headwater", 6).alias("headwater"), "submerged", F.round("v_out", 5).alias("v_out"))


_D, _T, _Q, _LEVEL, _PIER = 20.0, 100.0, 200.0, 19.0, 1.2
_BETA = "(0.7929 + 0.0973 * log10(100.0))"
_COEF = f"(0.68 * {_BETA} * power({_D}, 0.28))"
_NEILL = f"(1.58 * sqrt(1.65 * 9.81 * {_D / 1000}) * power({_D / 1000}, -1.0 / 6))"


def _scour_sections(spark, sf_dir):
    """(profiles, sections): a profile per order of more than one line, a pier in every third."""
    points = b.sections(spark, sf_dir).select("l_orderkey", (F.col("l_linenumber") * 10.0).alias("s"), (20.0 - 2 * F.col("h")).alias("z"))
    p = hydraulics.section_properties(points, ["l_orderkey"], F.lit(_LEVEL)).filter("area > 0 and width > 0")
    v = _Q / F.col("area")
    none = F.lit(None).cast("double")
    return points, p.select(
        "l_orderkey", F.lit(_LEVEL).alias("level"), F.lit(_Q).alias("flow"), "area", "width", v.alias("v"), (v / F.sqrt(9.81 * F.col("area") / F.col("width"))).alias("froude"), F.lit(_D).alias("d50"), F.lit(_T).alias("t"),
        F.lit(None).cast("array<struct<d50_mm:double,thickness:double>>").alias("layers"), none.alias("rock"), F.when(F.col("l_orderkey") % 3 == 0, _PIER).alias("pier_width"), F.lit("circular").alias("pier_shape"), none.alias("pier_angle"), none.alias("pier_length"), none.alias("k3"),
    )


@query(f"""WITH {b.SECTIONS}, p AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE AS s, 20.0::DOUBLE - 2 * h AS z FROM sec),
g AS (SELECT k, s, z, lead(s) OVER w AS s2, lead(z) OVER w AS z2 FROM p WINDOW w AS (PARTITION BY k ORDER BY s)),
c AS (SELECT k, s, s2, s2 - s AS ds, {_LEVEL} - z AS a, {_LEVEL} - z2 AS c FROM g WHERE s2 IS NOT NULL),
w AS (SELECT *, greatest(a, 0) AS ha, greatest(c, 0) AS hc, CASE WHEN a > 0 AND c > 0 THEN ds WHEN a <= 0 AND c <= 0 THEN 0 ELSE ds * greatest(a, c) / abs(a - c) END AS wet FROM c),
m AS (SELECT k, sum((ha + hc) / 2 * wet) AS area, sum(wet) AS width FROM w GROUP BY k HAVING area > 0 AND width > 0),
v AS (SELECT k, count(*) AS n, max(s) - min(s) AS be, max({_LEVEL} - z) AS h1 FROM p WHERE z < {_LEVEL} GROUP BY k HAVING n > 1),
ll AS (SELECT k, max(greatest(0, hs - h)) AS ll, min({_LEVEL} - hs) AS bed FROM (SELECT p.k, {_LEVEL} - z AS h, power({_Q} / (power(area / width, 5.0 / 3) * be) * power({_LEVEL} - z, 5.0 / 3) / {_COEF}, 1 / 1.32) AS hs FROM p JOIN m USING (k) JOIN v USING (k) WHERE z < {_LEVEL}) GROUP BY k),
st AS (SELECT k, CASE WHEN c < 0 THEN s + a / (a - c) * (s2 - s) ELSE s2 END - CASE WHEN a < 0 THEN s + a / (a - c) * (s2 - s) ELSE s END AS w, (ha + hc) / 2 AS h FROM w WHERE a > 0 OR c > 0),
su AS (SELECT k, h, {_Q} * power(h, 5.0 / 3) / sum(power(h, 5.0 / 3) * w) OVER (PARTITION BY k) AS u FROM st WHERE w > 0 AND h > 0.001),
fr AS (SELECT k, max(greatest(0, power(u / {_NEILL}, 6.0 / 7) - h, power({_Q} / (power(area / width, 5.0 / 3) * width) * power(h, 5.0 / 3) / {_COEF}, 1 / 1.32) - h)) AS fr FROM su JOIN m USING (k) GROUP BY k),
q AS (SELECT m.k, coalesce(ll, 0) AS ll, bed, CASE WHEN h1 IS NULL THEN 0 ELSE greatest(0, power({_Q} / be / {_NEILL}, 6.0 / 7) - area / width) END AS ne, coalesce(fr, 0) AS fr, h1, {_Q} / area AS v, {_Q} / area / sqrt(9.81 * area / width) AS f FROM m LEFT JOIN v USING (k) LEFT JOIN ll USING (k) LEFT JOIN fr USING (k)),
o AS (SELECT *, CASE WHEN k % 3 = 0 AND h1 IS NOT NULL THEN 2 * 1.1 * h1 * power({_PIER} / h1, 0.65) * power(f, 0.43) ELSE 0 END AS csu, CASE WHEN k % 3 = 0 AND h1 IS NOT NULL THEN greatest(2 * 1.1 * h1 * power({_PIER} / h1, 0.65) * power(f, 0.43), 0.32 * power({_PIER}, 0.62) * power(h1, 0.47) * power(greatest(f, 0.001), 0.22) * power(0.02, -0.09), 1.35 * power({_PIER}, 0.7) * power(h1, 0.3),
  1.5 * {_PIER} * tanh(h1 / {_PIER}), 1.05 * power({_PIER}, 0.75)) ELSE 0 END AS loc FROM q)
SELECT k AS l_orderkey, round(ll, 5) AS general_lischtvan, round(ne, 5) AS general_neill, round(fr, 5) AS general_strips, round(greatest(ll, ne, fr), 5) AS general, round(csu, 5) AS local_csu, round(loc, 5) AS "local", round(greatest(ll, ne, fr) + loc, 5) AS total, round(ll + csu, 5) AS total_csu,
  coalesce(v > 1.58 * sqrt(1.65 * 9.81 * {_D / 1000}) * power(h1 / {_D / 1000}, 1.0 / 6), false) AS live_bed, round(bed, 5) AS scoured_bed FROM o""")
def combined_scour(spark, sf_dir):
    """General and local scour of a section per order."""
    points, sections = _scour_sections(spark, sf_dir)
    r = scour.combined(points, sections, ["l_orderkey"])
    return r.select("l_orderkey", *[F.round(c, 5).alias(c) for c in ("general_lischtvan", "general_neill", "general_strips", "general", "local_csu", "local", "total", "total_csu")], "live_bed", F.round("scoured_bed", 5).alias("scoured_bed"))
