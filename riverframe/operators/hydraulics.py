"""Channel hydraulics: sections, backwater, culverts, bridges, mobile beds and shallow water.

Sections and reaches are rows; what is closed-form is an expression, what marches along a reach or
through time runs per reach or scenario as a numpy kernel, so the work spreads over reaches and scenarios.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import river
from ..functions.river import G


def section_properties(points: DataFrame, keys: Sequence[str], level: Column, s: str = "s", z: str = "z") -> DataFrame:
    """Area, wetted perimeter and width below a level, from profile points (keys, s, z)."""
    w = Window.partitionBy(*keys).orderBy(s)
    seg = points.withColumns({"__s2": F.lead(s).over(w), "__z2": F.lead(z).over(w)}).filter("__s2 is not null")
    a, c, ds = level - F.col(z), level - F.col("__z2"), F.col("__s2") - F.col(s)
    wet = F.when((a > 0) & (c > 0), ds).when((a <= 0) & (c <= 0), 0.0).otherwise(ds * F.greatest(a, c) / F.abs(a - c))
    ha, hc = F.greatest(a, F.lit(0.0)), F.greatest(c, F.lit(0.0))
    seg = seg.select(*keys, wet.alias("wet"), ha.alias("ha"), hc.alias("hc"))
    side = F.when((F.col("ha") > 0) | (F.col("hc") > 0), F.hypot("wet", F.col("ha") - F.col("hc"))).otherwise(0.0)
    return seg.groupBy(*keys).agg(F.sum((F.col("ha") + F.col("hc")) / 2 * F.col("wet")).alias("area"), F.sum(side).alias("perimeter"), F.sum("wet").alias("width"))


def transport_gradient(sections: DataFrame, keys: Sequence[str], order: str, spacing: float = 100.0, porosity: float = 0.4) -> DataFrame:
    """Bed load along a reach, its gradient, and the bed's tendency (columns h, j, d50, b); the first section has gradient 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = sections.withColumn("qs", river.meyer_peter_muller(F.col("h"), F.col("j"), F.col("d50") / 1000))
    dx = (F.col(order) - F.lag(order).over(w)) * spacing
    grad = F.coalesce((F.col("qs") - F.lag("qs").over(w)) / F.when(dx != 0, dx), F.lit(0.0))
    rows = rows.withColumn("grad", grad).withColumn("dzdt", F.lit(-1 / (1 - porosity)) / F.col("b") * F.col("grad"))
    return rows.withColumn("tendency", F.when(F.col("grad") > 1e-6, "erosion").when(F.col("grad") < -1e-6, "deposition").otherwise("balance"))


# --- kernels on sections: one, or many at once as rows of padded arrays ---------------------------------------


def wetted(s: np.ndarray, z: np.ndarray, level, perimeter: bool = True, moment: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """(area, perimeter, width, hydrostatic moment) of profiles (last axis: points) below their levels. A repeated last point adds nothing.

    The perimeter and the moment are None where they are not asked for."""
    level = np.asarray(level)[..., None]
    a, c, ds = level - z[..., :-1], level - z[..., 1:], np.diff(s)
    both, none = (a > 0) & (c > 0), (a <= 0) & (c <= 0)
    with np.errstate(all="ignore"):
        wet = np.where(both, ds, np.where(none, 0.0, ds * np.maximum(a, c) / np.abs(a - c)))
    ha, hc = np.maximum(a, 0), np.maximum(c, 0)
    side = np.where(none, 0.0, np.sqrt(wet * wet + (ha - hc) * (ha - hc))).sum(-1) if perimeter else None
    force = (wet * (ha * ha + ha * hc + hc * hc) / 6).sum(-1) if moment else None
    return ((ha + hc) / 2 * wet).sum(-1), side, wet.sum(-1), force


def root(f, lo, hi, steps: int = 80):
    """Root of an increasing f between lo and hi, for all rows at once: inverse quadratic steps where they are safe, halving where not (Chandrupatla).

    As halving does, it ends between a place where f is below 0 and one where it is not, or at the end of the interval
    on the other side of which that change would lie. Rows that have settled stay as they are; `steps` bounds the rounds."""
    lo, hi = np.broadcast_arrays(np.asarray(lo, float), np.asarray(hi, float))
    # a is the latest place, b the last one on the other side of the root, c the one before a.
    a, b, fa, fb = hi.copy(), lo.copy(), np.asarray(f(hi), float), np.asarray(f(lo), float)
    outside = np.where(fb < 0, np.where(fa < 0, hi, np.nan), lo)
    c, fc = b, fb
    t = np.full(a.shape, 0.5)
    for _ in range(steps):
        # Two spacings of doubles: no narrower interval has a place within.
        wide = np.isnan(outside) & (np.abs(b - a) > 2 * np.spacing(np.maximum(np.abs(a), np.abs(b)))) & (fa != 0)
        if not wide.any():
            break
        x = np.where(wide, a + t * (b - a), a)
        fx = np.where(wide, f(x), fa)
        same = (fx < 0) == (fa < 0)
        c, fc = np.where(same, a, b), np.where(same, fa, fb)
        b, fb = np.where(same, b, a), np.where(same, fb, fa)
        a, fa = x, fx
        with np.errstate(all="ignore"):
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            quadratic = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            safe = (phi * phi < xi) & ((1 - phi) * (1 - phi) < 1 - xi) & np.isfinite(quadratic)
            least = np.minimum(0.5, 2 * np.spacing(np.maximum(np.abs(a), np.abs(b))) / np.abs(b - a))
        t = np.where(safe, np.clip(quadratic, least, 1 - least), 0.5)
    return np.where(np.isnan(outside), np.where(np.abs(fa) <= np.abs(fb), a, b), outside)[()]


def manning_flow(s: np.ndarray, z: np.ndarray, level, n: float, slope: float):
    a, p, _, _ = wetted(s, z, level, moment=False)
    with np.errstate(all="ignore"):
        return np.where((a > 0) & (p > 0), a * (a / p) ** (2 / 3) * np.sqrt(slope) / n, 0.0)[()]


def normal_level(s, z, flow: float, n: float, slope: float):
    low = z.min(-1)
    top = low + 1.0
    for _ in range(40):
        short = manning_flow(s, z, top, n, slope) < flow
        if not short.any():
            break
        top = np.where(short, top + (top - low), top)
    return root(lambda w: manning_flow(s, z, w, n, slope) - flow, low, top)


def critical_level(s, z, flow: float):
    def f(w):
        # The area that flows critically with this width: nearly a line in w, unlike the square of the Froude number.
        a, _, b, _ = wetted(s, z, w, perimeter=False, moment=False)
        return np.where(a > 1e-9, a - np.cbrt(flow * flow * b / G), -1e9)

    return root(f, z.min(-1) + 1e-6, z.min(-1) + 100.0, 90)


def specific_force(s, z, flow: float, level):
    a, _, _, m = wetted(s, z, level)
    with np.errstate(all="ignore"):
        return np.where(a > 0, flow * flow / (G * a) + m, np.inf)


def march(x: np.ndarray, s: np.ndarray, z: np.ndarray, counts: np.ndarray, flow: float, n: float, start: np.ndarray, contraction: float, expansion: float, rising: bool) -> np.ndarray:
    """Levels (reach, section) by the standard step from each reach's first section on, all reaches at once.

    x (reach, section), s and z (reach, section, point); of each reach the first `counts` sections hold.
    rising: subcritical (upstream), else supercritical (downstream)."""
    levels = np.full(x.shape, np.nan)
    levels[:, 0] = start

    def head(s, z, w):
        a, p, _, _ = wetted(s, z, w, moment=False)
        v = flow / np.maximum(a, 1e-9)
        return v * v / (2 * G), (flow * n / (np.maximum(a, 1e-9) * (np.maximum(a, 1e-9) / np.maximum(p, 1e-9)) ** (2 / 3))) ** 2, w + v * v / (2 * G)

    for i in range(1, x.shape[1]):
        on = np.flatnonzero(counts > i)
        s1, z1, dx = s[on, i], z[on, i], np.abs(x[on, i] - x[on, i - 1])
        vh0, sf0, e0 = head(s[on, i - 1], z[on, i - 1], levels[on, i - 1])
        crit = critical_level(s1, z1, flow)
        sign = 1.0 if rising else -1.0

        def miss(w):
            vh, sf, e = head(s1, z1, w)
            lost = (sf0 + sf) / 2 * dx + np.where(vh0 > vh, contraction, expansion) * np.abs(vh0 - vh)
            return e - (e0 + sign * lost)

        if rising:
            w = np.where(miss(crit) < 0, root(miss, crit, crit + 100.0), crit)
        else:
            low = z1.min(-1) + 1e-3
            w = np.where((miss(low) > 0) & (miss(crit) < 0), root(lambda y: -miss(y), low, crit), crit)
        levels[on, i] = w
    return levels


def profiles(x: np.ndarray, s: np.ndarray, z: np.ndarray, counts: np.ndarray, flow: float, n: float, slope: float, contraction: float, expansion: float, regime: str) -> tuple[np.ndarray, ...]:
    """(level, lowest point, area, width) of every section of many reaches by station, reach by reach: arrays as march() takes them, padded."""
    held = np.arange(x.shape[1]) < counts[:, None]
    back = np.where(held, counts[:, None] - 1 - np.arange(x.shape[1]), np.arange(x.shape[1]))
    row = np.arange(len(x))[:, None]
    if regime != "super":
        ux, us, uz = x[row, back], s[row, back], z[row, back]
        first = np.maximum(normal_level(us[:, 0], uz[:, 0], flow, n, slope), critical_level(us[:, 0], uz[:, 0], flow))
        sub = march(ux, us, uz, counts, flow, n, first, contraction, expansion, True)[row, back][held]
    if regime != "sub":
        first = np.minimum(normal_level(s[:, 0], z[:, 0], flow, n, slope), critical_level(s[:, 0], z[:, 0], flow))
        sup = march(x, s, z, counts, flow, n, first, contraction, expansion, False)[held]
    s, z = s[held], z[held]
    if regime == "mixed":
        w = np.where(specific_force(s, z, flow, sub) >= specific_force(s, z, flow, sup), sub, sup)
    else:
        w = sub if regime == "sub" else sup
    a, _, b, _ = wetted(s, z, w, perimeter=False, moment=False)
    return w, z.min(-1), a, b


def padded(values: np.ndarray, points: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """(reach, section, point) of values that lie end to end, by the numbers of points of sections and of sections of reaches. Short sections repeat their last point."""
    ends, width = np.cumsum(points), int(points.max())
    at = (ends - points)[:, None] + np.minimum(np.arange(width), points[:, None] - 1)
    out = np.zeros((len(sections), int(sections.max()), width))
    out[np.repeat(np.arange(len(sections)), sections), np.arange(len(points)) - np.repeat(np.cumsum(sections) - sections, sections)] = values[at]
    return out


def backwater(sections: DataFrame, reach: str, flow: float, n: float = 0.035, slope: float = 0.002, contraction: float = 0.1, expansion: float = 0.3, regime: str = "sub", most: int = 20_000) -> DataFrame:
    """Water surface along each reach (reach, station, pts): levels, depths, areas, velocities and Froude numbers.

    regime: sub (from the last station up), super (from the first down), or mixed (the larger specific force governs).
    A reach is one row of its sections; reaches are marched together, about `most` points at a time, straight from
    their Arrow arrays. Sections without points are left out."""
    kind = {f.name: f.dataType.simpleString() for f in sections.schema}[reach]
    of = lambda c: F.transform("pts", lambda p: p[c].cast("double")).alias(c)
    section = F.struct(F.col("station").cast("double").alias("x"), of("s"), of("z"))
    rows = sections.filter(F.size("pts") > 0).groupBy(reach).agg(F.sort_array(F.collect_list(section)).alias("sections")).select(reach, *[F.col(f"sections.{c}").alias(f"__{c}") for c in ("x", "s", "z")])
    names = [reach, "station", "level", "depth", "area", "width", "v", "fr", "energy"]
    schema = f"{reach} {kind}, station double, level double, depth double, area double, width double, v double, fr double, energy double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            xs, inner = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten()
            points = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)
            s, z = inner.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().flatten().to_numpy(zero_copy_only=False)
            first_section, first_point = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(points)))
            widest = np.maximum.reduceat(points, first_section[:-1])
            at = 0
            while at < batch.num_rows:
                upto = at + 1
                while upto < batch.num_rows and (upto + 1 - at) * counts[at : upto + 1].max() * widest[at : upto + 1].max() <= most:
                    upto += 1
                own, sections_of = slice(first_section[at], first_section[upto]), counts[at:upto]
                values = slice(first_point[own.start], first_point[own.stop])
                arrays = [padded(v[values], points[own], sections_of) for v in (s, z)]
                x = padded(xs[own], sections_of, np.ones(len(sections_of), np.int64))[:, 0]
                w, low, a, b = profiles(x, *arrays, sections_of, flow, n, slope, contraction, expansion, regime)
                v = flow / a
                out = (xs[own], w, w - low, a, b, v, v / np.sqrt(G * a / b), w + v * v / (2 * G))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(at, upto), sections_of)))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], names)
                at = upto

    return rows.mapInArrow(run, schema)


# --- culverts and bridges: expressions ----------------------------------------------------------------------


def culvert_rating(culverts: DataFrame, keys: Sequence[str], steps: int = 24, cb: float = 0.0398, y: float = 0.67, k: float = 0.0098, m: float = 2.0, ke: float = 0.5) -> DataFrame:
    """Headwater of box culverts (width, height, length, slope, n) over `steps` flows: inlet and outlet control, the larger governs."""
    top = F.col("width") * F.col("height") * F.sqrt(2 * G * F.col("height"))
    rows = culverts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("q", top * F.col("i") / steps)
    area, d, q = F.col("width") * F.col("height"), F.col("height"), F.col("q")
    ratio = 1.811 * q / (area * F.sqrt(d))
    yc = F.least(d, river.critical_depth_box(q, F.col("width")))
    ec = yc + F.pow(q / (F.col("width") * yc), F.lit(2.0)) / (2 * G)
    free = d * (ec / d + F.lit(k) * F.pow(ratio, F.lit(m)) - 0.5 * F.col("slope"))
    full = d * (F.lit(cb) * ratio * ratio + F.lit(y) - 0.5 * F.col("slope"))
    t = (ratio - 3.5) / 0.5
    inlet = F.when(ratio <= 3.5, free).when(ratio >= 4.0, full).otherwise(free + (full - free) * t)
    radius = area / (2 * (F.col("width") + d))
    v2 = F.pow(q / area, F.lit(2.0)) / (2 * G)
    outlet = (yc + d) / 2 + v2 * (1 + ke + 2 * G * F.col("n") * F.col("n") * F.col("length") / F.pow(radius, F.lit(4 / 3))) - F.col("slope") * F.col("length")
    return rows.select(*keys, "q", inlet.alias("inlet"), outlet.alias("outlet"), F.greatest(inlet, outlet).alias("headwater"))


def bridge_level(flow: Column, width: Column, soffit: Column, deck: Column, deck_length: Column, invert: Column, tailwater: Column, cd: float = 0.8, cw: float = 1.7) -> Column:
    """Upstream level at which pressure flow under the deck and weir flow over it carry a flow; the tailwater reduces the weir (Villemonte)."""
    opening = width * (soffit - invert)

    def carried(w: Column) -> Column:
        under = cd * opening * F.sqrt(2 * G * F.greatest(F.lit(0.0), w - F.greatest(tailwater, (soffit + invert) / 2)))
        over = F.greatest(F.lit(0.0), w - deck)
        drowned = F.least(F.lit(1.0), F.greatest(F.lit(0.0), tailwater - deck) / F.when(over > 0, over).otherwise(1.0))
        weir = cw * deck_length * F.pow(over, F.lit(1.5)) * F.pow(F.greatest(F.lit(0.0), 1 - F.pow(drowned, F.lit(1.5))), F.lit(0.385))
        return under + weir

    return river.bisect(F.greatest(tailwater, soffit), F.greatest(deck, tailwater) + 30.0, lambda w: carried(w) < flow)


def freeboard(level: Column, soffit: Column, required: Column) -> Column:
    """Whether the free height under a deck is enough."""
    return soffit - level >= required


# --- mobile bed and shallow water -----------------------------------------------------------------------------


def hll(hl, ul, hr, ur):
    """HLL flux of (h, hu) with dry-bed wave speeds."""
    cl, cr = np.sqrt(G * hl), np.sqrt(G * hr)
    sl = np.where(hl > 0, np.minimum(ul - cl, ur - cr), ur - 2 * cr)
    sr = np.where(hr > 0, np.maximum(ul + cl, ur + cr), ul + 2 * cl)
    fl, fr = np.array([hl * ul, hl * ul**2 + G * hl**2 / 2]), np.array([hr * ur, hr * ur**2 + G * hr**2 / 2])
    with np.errstate(all="ignore"):
        mid = (sr * fl - sl * fr + sl * sr * (np.array([hr, hr * ur]) - np.array([hl, hl * ul]))) / (sr - sl)
    flux = np.where(sl >= 0, fl, np.where(sr <= 0, fr, mid))
    return np.where((hl <= 0) & (hr <= 0), 0.0, flux)


def shallow_water(h: np.ndarray, q: np.ndarray, z: np.ndarray, dx: float, seconds: float, n: float = 0.0, cfl: float = 0.4, frames: int = 10):
    """1D strip with walls: hydrostatic reconstruction (still water stays still), HLL fluxes, implicit friction. Yields (t, h, q)."""
    h, q = h.copy(), q.copy()
    t, every, next_frame = 0.0, seconds / frames, 0.0
    while True:
        if t >= next_frame - 1e-9:
            yield t, h.copy(), q.copy()
            next_frame += every
        if t >= seconds - 1e-9:
            return
        u = np.where(h > 1e-6, q / np.maximum(h, 1e-6), 0.0)
        speed = float((np.abs(u) + np.sqrt(G * h)).max())
        dt = min(cfl * dx / max(speed, 1e-6), next_frame - t if next_frame > t else seconds - t, seconds - t)
        hp, up, zp = (np.concatenate(([a[0]], a, [a[-1]])) for a in (h, u, z))
        up[0], up[-1] = -u[0], -u[-1]
        top = np.maximum(zp[:-1], zp[1:])
        hl, hr = np.maximum(0, hp[:-1] + zp[:-1] - top), np.maximum(0, hp[1:] + zp[1:] - top)
        f = hll(hl, up[:-1], hr, up[1:])
        left = f[1] + G / 2 * (hp[:-1] ** 2 - hl**2)
        right = f[1] + G / 2 * (hp[1:] ** 2 - hr**2)
        h = np.maximum(0.0, h - dt / dx * (f[0][1:] - f[0][:-1]))
        q = q - dt / dx * (left[1:] - right[:-1])
        q = np.where(h > 1e-6, q / (1 + dt * G * n * n * np.abs(q) / np.maximum(h, 1e-6) ** (7 / 3)), 0.0)
        t += dt


def dam_break(scenarios: DataFrame, key: str, cells: int = 200, dx: float = 5.0, seconds: float = 30.0, n: float = 0.0) -> DataFrame:
    """Frames (key, t, cell, h, q) of a dam break per scenario (key, depth): one task per scenario."""
    kind = {f.name: f.dataType.simpleString() for f in scenarios.schema}[key]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, depth in zip(part[key], part["depth"]):
            h = np.where(np.arange(cells) < cells // 2, float(depth), 0.0)
            for t, hh, qq in shallow_water(h, np.zeros(cells), np.zeros(cells), dx, seconds, n):
                out.append(pd.DataFrame({key: k, "t": round(t, 6), "cell": np.arange(cells), "h": hh, "q": qq}))
        return pd.concat(out)

    return scenarios.groupBy(key).applyInPandas(run, f"{key} {kind}, t double, cell bigint, h double, q double")


def mobile_bed(z: np.ndarray, width: np.ndarray, dx: float, flows: np.ndarray, dt: float, n: float, d: float, supply: float = 1.0, porosity: float = 0.4) -> np.ndarray:
    """Quasi-steady bed evolution: normal depth per section at the local slope, bed load, upwind Exner step with a limit of 0.3 depths."""
    z = z.astype(float).copy()
    for q in flows:
        slope = np.maximum(1e-4, np.concatenate((z[:-1] - z[1:], [z[-2] - z[-1]])) / dx)
        depth = (q * n / (width * np.sqrt(slope))) ** 0.6
        over = np.maximum(0.0, depth * slope / (1.65 * d) - 0.047)
        load = 8 * over**1.5 * np.sqrt(1.65 * G * d**3) * width
        into = np.concatenate(([supply * load[0]], load[:-1]))
        step = dt * (into - load) / ((1 - porosity) * width * dx)
        z += np.clip(step, -0.3 * depth, 0.3 * depth)
    return z


def hazard_summary(field: DataFrame, keys: Sequence[str], depth: str = "h", velocity: str = "v", dry: float = 0.02) -> DataFrame:
    """Cells by hazard class and the worst depth times velocity, of wet cells."""
    wet = field.filter(F.col(depth) > dry)
    return wet.groupBy(*keys, river.hazard_class(F.col(depth), F.col(velocity)).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(depth) * F.col(velocity)).alias("worst"))


def arrival(frames: DataFrame, keys: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """First time at which a cell is deeper than a threshold; null if never."""
    return frames.groupBy(*keys).agg(F.min(F.when(F.col("h") > threshold, F.col("t"))).alias("arrival"))
