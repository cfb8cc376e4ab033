"""Closed forms of hydrology, hydraulics, sediment and works as Column expressions.

Units: lengths of channels km, areas km2, slopes m/m, times h, rain mm, flows m3/s, grain sizes mm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import interpolate

G, RHO, SEDIMENT = 9.81, 1000.0, 2.65


def power(base: Column, exponent: float) -> Column:
    return F.pow(base, F.lit(float(exponent)))


# --- rain ---------------------------------------------------------------------------------------


def areal_reduction(area: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.4), F.lit(1.1032) - F.lit(0.03474) * F.log(F.greatest(F.lit(1.0), area))))


def grunsky(rain24: Column, tc: Column) -> Column:
    """Intensity in mm/h over tc hours."""
    return rain24 / 24 * F.sqrt(24 / tc)


def intensity(rain24: Column, coefficient: Column, minutes: Column) -> Column:
    return rain24 * coefficient / (minutes / 60)


def scs_retention(cn: Column) -> Column:
    return F.lit(25400.0) / cn - 254


def scs_runoff(rain: Column, cn: Column) -> Column:
    s = scs_retention(cn)
    over = rain - 0.2 * s
    return F.when(over > 0, over * over / (over + s)).otherwise(0.0)


# --- concentration times ----------------------------------------------------------------------------


def tc_kirpich(length: Column, slope: Column) -> Column:
    return F.lit(0.0195) * power(length * 1000, 0.77) * power(slope, -0.385) / 60


def tc_california(length: Column, drop: Column) -> Column:
    return F.lit(0.95) * power(power(length, 3) / drop, 0.385)


def tc_giandotti(area: Column, length: Column, mean_drop: Column) -> Column:
    return F.when(mean_drop > 0, (4 * F.sqrt(area) + 1.5 * length) / (0.8 * F.sqrt(F.when(mean_drop > 0, mean_drop))))


def tc_mountain(length: Column, slope: Column) -> Column:
    return F.lit(0.3) * power(length / power(slope, 0.25), 0.76)


def tc_scs(length: Column, slope: Column, cn: Column) -> Column:
    """Rural basins by curve number; null without one."""
    return F.when(cn > 0, power(3280 * length, 0.8) * power(F.lit(1000.0) / F.when(cn > 0, cn) - 9, 0.7) / (1140 * F.sqrt(slope * 100)))


# --- snow -----------------------------------------------------------------------------------------------


def snow_line_by_temperature(height: Column, temperature: Column, lapse_100m: Column, snow_temperature: Column) -> Column:
    return height + (temperature - snow_temperature) / lapse_100m * 100


# --- transposition, unit hydrograph ----------------------------------------------------------------------


def transposition_factor(area: Column, control_area: Column, rain: Column, control_rain: Column, area_exponent: float = 0.88, rain_exponent: float = 1.24) -> Column:
    return power(area / control_area, area_exponent) * power(rain / control_rain, rain_exponent)


# Coefficients of the synthetic unit hydrograph by zone (time to peak, base time, peak), and its shape.
UNIT_ZONES = {1: ((0.323, 0.422), (5.377, 0.805), (144.141, -0.796)), 2: ((0.584, 0.327), (1.822, 1.412), (522.514, -1.511)), 3: ((1.351, 0.237), (5.428, 0.717), (172.775, -0.835))}
UNIT_SHAPE = ((0.00, 0.0), (0.30, 0.2), (0.50, 0.4), (0.60, 0.6), (0.75, 0.8), (1.00, 1.0), (1.30, 0.8), (1.50, 0.6), (1.80, 0.4), (2.30, 0.2), (2.70, 0.1))


def unit_hydrograph(length: Column, to_centroid: Column, slope: Column, area: Column, zone: Column) -> dict[str, Column]:
    """tp, tu, tb in h; qp in l/s/mm/km2; qpa in m3/s for a millimetre over the basin."""

    def by_zone(part: int, base: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for z, rows in UNIT_ZONES.items():
            out = out.when(zone == z, F.lit(rows[part][0]) * power(base, rows[part][1]))
        return out

    tp = by_zone(0, length * to_centroid / F.sqrt(slope))
    qp = by_zone(2, tp)
    return {"tp": tp, "tu": tp / 5.5, "tb": by_zone(1, tp), "qp": qp, "qpa": qp * area / 1000}


# --- dam breach -----------------------------------------------------------------------------------------


def breach(volume: Column, height: Column, head: Column, piping: Column) -> dict[str, Column]:
    """Froehlich's mean width, formation time and peak, and the peak of MacDonald and Langridge-Monopolis; null unless volume and height are positive."""
    ok = (volume > 0) & (height > 0)
    w, b = F.when(ok, volume), F.when(ok, height)
    hw = F.when(head > 0, head).otherwise(b)
    ko = F.when(piping, F.lit(1.0)).otherwise(1.3)
    qf, qm = F.lit(0.607) * power(w, 0.295) * power(hw, 1.24), F.lit(1.154) * power(w * hw, 0.412)
    return {"width": F.lit(0.27) * ko * power(w, 0.32) * power(b, 0.04), "formation_s": F.lit(63.2) * F.sqrt(w / (F.lit(G) * b * b)), "peak_froehlich": qf, "peak_mlm": qm, "peak": F.greatest(qf, qm)}


# --- open channel ---------------------------------------------------------------------------------------


def manning(area: Column, radius: Column, n: Column, slope: Column) -> Column:
    return area * power(radius, 2 / 3) * F.sqrt(slope) / n


def bisect(low: Column, high: Column, below, steps: int = 80) -> Column:
    """Root by bisection inside an expression; below(x) is true while x is too small."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        small = below(mid)
        return F.struct(F.when(small, mid).otherwise(s["lo"]).alias("lo"), F.when(small, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi")), step, lambda s: (s["lo"] + s["hi"]) / 2)


def rectangular_normal_depth(flow: Column, width: Column, n: Column, slope: Column, highest: float = 200.0, steps: int = 80) -> Column:
    """Depth at which a rectangular channel carries a flow.

    With r = 2 c / width, c = (flow n / (width sqrt(slope)))^0.6 and v = (1 + 2 y / width)^0.2 the depth is y = c v^2 where
    v^5 = r v^2 + 1. Newton's steps from (1 + r)^(1/3), which lies above the root, come down to it; six reach the last digit.
    Values for which that does not hold, and depths beyond `highest`, are left to bisection."""
    start = F.struct(F.pow(flow * n / (width * F.sqrt(slope)), F.lit(0.6)).alias("c"), width.cast("double").alias("w"))

    def solve(s: Column) -> Column:
        r = 2 * s["c"] / s["w"]
        first = F.struct(r.alias("r"), F.cbrt(1 + r).alias("v"))

        def step(a: Column, _: Column) -> Column:
            v2 = a["v"] * a["v"]
            return F.struct(a["r"].alias("r"), ((4 * v2 * v2 * a["v"] - a["r"] * v2 + 1) / (5 * v2 * v2 - 2 * a["r"] * a["v"])).alias("v"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), first, step, lambda a: s["c"] * a["v"] * a["v"])

    regular = (flow > 0) & (width > 0) & (n > 0) & (slope > 0)
    fast = F.when(regular, F.transform(F.array(start), solve)[0])
    bisected = bisect(F.lit(0.0), F.lit(highest), lambda y: manning(width * y, width * y / (width + 2 * y), n, slope) < flow, steps)
    return F.transform(F.array(fast), lambda y: F.when((y > 0) & (y < highest), y).otherwise(bisected))[0]


def critical_depth_box(flow: Column, width: Column) -> Column:
    return F.cbrt(flow * flow / (width * width * G))


# Flood hazard classes, (class, most depth x velocity, most depth, most velocity).
HAZARD = (("H1", 0.30, 0.30, 2.0), ("H2", 0.60, 0.50, 2.0), ("H3", 0.60, 1.20, 2.0), ("H4", 1.00, 2.00, 2.0), ("H5", 4.00, 4.00, 4.0))


def hazard_class(depth: Column, velocity: Column) -> Column:
    out = F.when(depth.isNull() | velocity.isNull(), F.lit(None).cast("string"))
    for name, dv, d, v in HAZARD:
        out = out.when((depth * velocity <= dv) & (depth <= d) & (velocity <= v), name)
    return out.otherwise("H6")


# --- scour -----------------------------------------------------------------------------------------------


def frequency_beta(t: Column) -> Column:
    return F.greatest(F.lit(0.77), F.least(F.lit(1.07), F.lit(0.7929) + F.lit(0.0973) * F.log10(F.greatest(F.lit(1.0), t))))


def competent_velocity(depth: Column, d50: Column) -> Column:
    d = d50 / 1000
    return F.lit(1.58) * F.sqrt(F.lit((SEDIMENT - 1) * G) * d) * power(depth / d, 1 / 6)


def neill_depth(unit_flow: Column, d50: Column) -> Column:
    """Depth at which the mean velocity falls to the competent one."""
    d = F.greatest(d50, F.lit(0.1)) / 1000
    return power(unit_flow / (F.lit(1.58) * F.sqrt(F.lit((SEDIMENT - 1) * G) * d) * power(d, -1 / 6)), 6 / 7)

# Exponents by grain size in mm and by dry unit weight in t/m3; they fall by 0.01 from knot to knot.
X_GRAIN = (0.05, 0.15, 0.50, 1.0, 1.5, 2.5, 4, 6, 8, 10, 15, 20, 25, 40, 60, 90, 140, 190, 250, 310, 370, 450, 570, 750, 1000)
X_WEIGHT = (0.80, 0.83, 0.86, 0.88, 0.90, 0.93, 0.96, 0.98, 1.00, 1.04, 1.08, 1.12, 1.16, 1.20, 1.24, 1.28, 1.34, 1.40, 1.46, 1.52, 1.58, 1.64, 1.71, 1.80, 1.89)


def exponent_granular(d50: Column) -> Column:
    return interpolate.table(d50, X_GRAIN, [round(0.43 - 0.01 * i, 2) for i in range(len(X_GRAIN))], log_x=True)


def exponent_cohesive(gamma_s: Column) -> Column:
    return interpolate.table(gamma_s, X_WEIGHT, [round(0.52 - 0.01 * i, 2) for i in range(len(X_WEIGHT))], log_x=True)


def lischtvan_depth(alpha: Column, depth: Column, beta: Column, x: Column, d50: Column) -> Column:
    """Granular bed: depth from the surface after scour."""
    return F.when(depth > 0, F.pow(alpha * power(depth, 5 / 3) / (F.lit(0.68) * beta * power(d50, 0.28)), 1 / (1 + x))).otherwise(0.0)


def lischtvan_depth_cohesive(alpha: Column, depth: Column, beta: Column, x: Column, gamma_s: Column) -> Column:
    return F.when(depth > 0, F.pow(alpha * power(depth, 5 / 3) / (F.lit(0.60) * beta * power(gamma_s, 1.18)), 1 / (1 + x))).otherwise(0.0)


# Shape factors of piers and abutments by method.
PIER_K1 = {"square": 1.1, "chamfered": 0.9}
PIER_FROEHLICH = {"square": 1.3}
PIER_BREUSERS = {"square": 1.3, "chamfered": 0.75}
PIER_LARRAS = {"square": 1.4}
ABUTMENT_K1 = {"vertical": 1.0, "wing": 0.82, "spill": 0.55}


def by_shape(shape: Column, factors: dict[str, float], other: float) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, k in factors.items():
        out = out.when(shape == name, F.lit(k))
    return out.otherwise(other)


def pier_scour(width: Column, depth: Column, froude: Column, d50: Column, shape: Column, angle: Column, length: Column, k3: Column) -> dict[str, Column]:
    """Depths by five methods, with their envelope and mean. Shapes: circular, square, chamfered."""
    k2 = F.when((angle > 0) & (length > 0), power(F.cos(F.radians(angle)) + length / width * F.sin(F.radians(angle)), 0.65)).otherwise(1.0)
    out = {
        "csu": 2 * by_shape(shape, PIER_K1, 1.0) * k2 * k3 * depth * power(width / depth, 0.65) * power(froude, 0.43),
        "froehlich": F.lit(0.32) * by_shape(shape, PIER_FROEHLICH, 1.0) * power(width, 0.62) * power(depth, 0.47) * power(F.greatest(froude, F.lit(1e-3)), 0.22) * power(F.greatest(d50, F.lit(0.2)) / 1000, -0.09),
        "laursen_toch": F.lit(1.35) * power(width, 0.7) * power(depth, 0.3),
        "breusers": F.lit(1.5) * by_shape(shape, PIER_BREUSERS, 1.0) * width * F.tanh(depth / width),
        "larras": F.lit(1.05) * by_shape(shape, PIER_LARRAS, 1.0) * power(width, 0.75),
    }
    methods = list(out.values())
    total = methods[0]
    for m in methods[1:]:
        total = total + m
    return out | {"envelope": F.greatest(*methods), "mean": total / len(methods)}


def abutment_scour(depth: Column, froude: Column, blocked: Column, shape: Column, angle: Column) -> dict[str, Column]:
    """Froehlich for short embankments, HIRE from 25 depths on."""
    k1, k2, fr = by_shape(shape, ABUTMENT_K1, 0.55), power(F.greatest(angle, F.lit(1.0)) / 90, 0.13), F.greatest(froude, F.lit(1e-3))
    froehlich = depth * (F.lit(2.27) * k1 * k2 * power(F.greatest(blocked, F.lit(0.01)) / depth, 0.43) * power(fr, 0.61) + 1)
    hire = 4 * depth * (k1 / 0.55) * k2 * power(fr, 0.33)
    return {"froehlich": froehlich, "hire": hire, "adopted": F.when(blocked / depth >= 25, hire).otherwise(froehlich)}


# --- sediment --------------------------------------------------------------------------------------------


def bed_shear(depth: Column, slope: Column) -> Column:
    return F.lit(RHO * G) * depth * slope


def critical_shear(d: Column, theta: float = 0.047) -> Column:
    return F.lit(theta * (SEDIMENT - 1) * RHO * G) * d


def shields(shear: Column, d: Column) -> Column:
    return shear / (F.lit((SEDIMENT - 1) * RHO * G) * d)


def drag_velocity(d: Column, depth: Column, alpha: float = 1.41) -> Column:
    return F.lit(alpha) * F.sqrt(F.lit((SEDIMENT - 1) * G) * d) * power(depth / d, 1 / 6)


def meyer_peter_muller(depth: Column, slope: Column, d: Column, theta: float = 0.047) -> Column:
    """Bed load in m3/s per metre of width; d in metres."""
    over = shields(bed_shear(depth, slope), d) - F.lit(theta)
    return F.when(over > 0, 8 * power(F.when(over > 0, over), 1.5) * F.sqrt(F.lit((SEDIMENT - 1) * G) * power(d, 3))).otherwise(0.0)


def engelund_hansen(depth: Column, velocity: Column, slope: Column, d: Column) -> Column:
    """Total load in m3/s per metre of width."""
    theta = shields(bed_shear(depth, slope), d)
    v2 = F.when(velocity == 0, F.lit(1e-6)).otherwise(velocity * velocity)
    friction = F.lit(2 * G) * depth * slope / v2
    return F.lit(0.1) * power(F.greatest(theta, F.lit(0.0)), 2.5) / F.when(friction == 0, F.lit(1e-6)).otherwise(friction) * F.sqrt(F.lit((SEDIMENT - 1) * G) * power(d, 3))


def fall_velocity(d: Column, k: float = 1.1) -> Column:
    return F.lit(k) * F.sqrt(F.lit((SEDIMENT - 1) * G) * d)


def rouse_number(fall: Column, shear_velocity: Column) -> Column:
    return fall / (F.lit(0.4) * shear_velocity)


def rouse_mode(z: Column) -> Column:
    return F.when(z < 0.8, "suspension").when(z <= 2.5, "mixed").when(z.isNotNull(), "bed")


def long_term_degradation(depth: Column, slope: Column, width: Column, d50: Column, reach: Column, supply: Column, coarse: Column, exponent: float = 1.5) -> dict[str, Column]:
    """Equilibrium slope against armouring; supply is the ratio of the sediment supply to the capacity."""
    d = F.greatest(d50, F.lit(0.1)) / 1000
    capacity = meyer_peter_muller(depth, slope, d) * width
    moves = capacity > 1e-6
    by_slope = (slope - slope * power(F.greatest(supply, F.lit(0.0)), 1 / exponent)) * reach
    armour_size = bed_shear(depth, slope) / F.lit(0.047 * (SEDIMENT - 1) * RHO * G)
    by_armour = 2 * armour_size * (1 / F.least(F.lit(0.95), F.greatest(F.lit(0.01), coarse)) - 1)
    lowers = (by_slope > 1e-3) & moves
    return {"capacity": capacity, "by_slope": by_slope, "by_armour": by_armour, "degradation": F.when(lowers, F.least(by_slope, by_armour)).otherwise(0.0), "aggradation": F.when(by_slope < -1e-3, -by_slope).otherwise(0.0)}


# --- riprap and walls ---------------------------------------------------------------------------------------


def slope_factor(run: Column, repose: float = 40.0) -> Column:
    v = 1 - power(F.sin(F.atan2(F.lit(1.0), F.greatest(F.lit(0.01), run))) / math.sin(math.radians(repose)), 2)
    return F.when(v > 0, F.sqrt(F.when(v > 0, v))).otherwise(0.1)


def riprap_isbash(velocity: Column, c: float = 0.86) -> Column:
    return velocity * velocity / (c * c * 2 * G * (SEDIMENT - 1))


def riprap_maynord(velocity: Column, depth: Column, run: Column, safety: float = 1.1, cs: float = 0.30, cv: float = 1.0, ct: float = 1.0) -> Column:
    """D50, taken as 1.2 D30."""
    d30 = F.lit(safety * cs * cv * ct) * depth * power(velocity / F.sqrt(slope_factor(run) * (SEDIMENT - 1) * G * depth), 2.5)
    return 1.2 * d30


def riprap_pier(velocity: Column, square: Column) -> Column:
    return F.lit(0.692) * power(F.when(square, F.lit(1.7)).otherwise(1.5) * velocity, 2) / ((SEDIMENT - 1) * 2 * G)


def riprap_abutment(velocity: Column, depth: Column, vertical: Column) -> Column:
    fr = velocity / F.sqrt(G * F.greatest(depth, F.lit(1e-3)))
    slow, fast = F.when(vertical, 1.02).otherwise(0.89) * fr * fr, F.when(vertical, 0.69).otherwise(0.61) * power(fr, 0.14)
    return F.when(fr <= 0.8, slow).otherwise(fast) / (SEDIMENT - 1) * depth


def rock_weight(d: Column, unit_weight: float = 26.0) -> Column:
    """kN of a sphere of diameter d metres."""
    return F.lit(unit_weight * math.pi / 6) * power(d, 3)


def mononobe_okabe(phi: Column, delta: Column, beta: Column, theta: Column, psi: Column) -> Column:
    """Active thrust coefficient; angles in degrees; null where the backfill flows."""
    f, d, b, t, p = (F.radians(x) for x in (phi, delta, beta, theta, psi))
    inner = F.greatest(F.lit(0.0), F.sin(f + d) * F.sin(f - p - b) / (F.cos(d + t + p) * F.cos(b - t)))
    k = power(F.cos(f - p - t), 2) / (F.cos(p) * power(F.cos(t), 2) * F.cos(d + t + p) * power(1 + F.sqrt(inner), 2))
    return F.when(phi - psi - beta >= 0, k)


SEISMIC_A0 = {1: 0.20, 2: 0.30, 3: 0.40}  # fixed values: ground acceleration over g by zone


def wall_check(height: Column, unit_weight: Column, phi: Column, delta: Column, kh: Column, weight: Column, base: Column, friction: float = 0.55) -> dict[str, Column]:
    """Static and seismic thrust of a vertical wall and its safety against sliding and overturning."""
    zero = F.lit(0.0)
    psi = F.degrees(F.atan(kh))
    ka, kae = mononobe_okabe(phi, delta, zero, zero, zero), mononobe_okabe(phi, delta, zero, zero, psi)
    half = 0.5 * unit_weight * height * height
    static, extra = half * ka, F.greatest(zero, half * kae - half * ka)
    across = F.cos(F.radians(delta))
    inertia = kh * weight
    turning = static * across * height / 3 + extra * across * 0.6 * height + inertia * height / 2
    sliding = F.lit(friction) * weight / F.greatest(F.lit(1e-9), static * across + extra * across + inertia)
    overturning = weight * base / 2 / F.greatest(F.lit(1e-9), turning)
    return {"ka": ka, "kae": kae, "static": static, "seismic_extra": extra, "sliding": sliding, "overturning": overturning, "slides": sliding < 1.1, "overturns": overturning < 1.15}


def riprap_size(velocity: Column, depth: Column, run: Column) -> Column:
    """Envelope of the bank methods."""
    return F.greatest(riprap_isbash(velocity), riprap_maynord(velocity, depth, run))

