"""From a design storm to a flood hydrograph, all basins at once.

A storm's blocks come from closed forms, so they are made on the spot. Effective rain, unit hydrographs and their
convolution are rows that meet by the keys of a basin; unit hydrographs are scaled so that a millimetre over the
basin holds exactly the basin's area times a millimetre.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import river
from . import routing


def hyetograph(storms: DataFrame, keys: Sequence[str], exponent: float = 0.7) -> DataFrame:
    """Blocks (keys, step, p) of storms (keys, total, duration_h, dt_h, pattern): as many as the duration holds, at least one, adding up to the total.

    "alternating": depths by duration as d^(1 - exponent), differenced; the largest block stands in the middle, the
    next ones right and left of it in turn. "triangular": falling on both sides of the middle. "uniform": equal.
    Another pattern, or a null one, counts as uniform; storms without total, duration or step give no rows."""
    if not exponent < 1:
        raise ValueError("depth must grow with duration: exponent < 1")
    grows = 1 - exponent
    n = F.greatest(F.lit(1), F.floor(F.col("duration_h") / F.col("dt_h") + 0.5)).cast("int")
    rows = storms.filter("total is not null and duration_h > 0 and dt_h > 0").select(*keys, "total", "dt_h", "pattern", n.alias("n"))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, n = F.col("step"), F.col("n")
    middle = F.floor((n - 1) / 2)
    place = F.when(i <= middle, 2 * (middle - i)).otherwise(2 * (i - middle) - 1)  # 0 for the largest block
    rank = place if grows <= 1 else n - 1 - place
    power = lambda x: F.pow(x.cast("double"), F.lit(float(grows)))
    alternating = (power(rank + 1) - power(rank)) / power(n)
    half = (n - 1) / 2
    triangular = F.greatest(F.lit(0.01), 1 - F.abs(i - half) / (half + 1))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("__w", F.when(F.col("pattern") == "alternating", alternating).when(F.col("pattern") == "triangular", triangular).otherwise(F.lit(1.0)))
    return rows.select(*keys, "step", (F.col("total") * F.col("__w") / F.sum("__w").over(w)).alias("p"))


def uniform(curves: DataFrame, keys: Sequence[str], last: str = "hold", least: int = 0, up: bool = False, t: str = "t", value: str = "q", dt: str = "dt") -> DataFrame:
    """(keys, step, t, value): curves (keys, t, value, dt) with uneven times at uniform steps from 0, dt apart, linear between points.

    Every piece between two points makes the steps that fall on it, so no step is searched for. Steps go to the last
    time over dt, rounded, or rounded up with `up`, `least` at least. Before the first point its value holds; from the
    last time on the last value holds, or 0 with last="zero". A curve of one point is constant; of equal times the
    first by value counts. dt is one for all rows of a curve."""
    w = Window.partitionBy(*keys).orderBy(t, value)
    whole = Window.partitionBy(*keys)
    rows = curves.filter(F.col(t).isNotNull() & (F.col(dt) > 0)).withColumns({"__t2": F.lead(t).over(w), "__v2": F.lead(value).over(w), "__first": F.lag(t).over(w).isNull(), "__end": F.max(t).over(whole)})
    steps = F.greatest(F.lit(least), (F.ceil if up else lambda x: F.floor(x + 0.5))(F.col("__end") / F.col(dt)).cast("int"))
    # Steps k with time in (t, t2], before the end; the first point also makes those at and before it, the last one those at and after the end.
    # Both reach one step further, which the filter below takes away where it is not this piece's.
    low = F.when(F.col("__first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(F.col(t) / F.col(dt)).cast("int") - 1))
    high = F.when(F.col("__t2").isNull(), steps).otherwise(F.least(steps, F.ceil(F.col("__t2") / F.col(dt)).cast("int") + 1))
    rows = rows.withColumns({"__low": low, "__high": high}).filter("__low <= __high")
    rows = rows.withColumn("__step", F.explode(F.sequence("__low", "__high"))).withColumn("__at", F.col("__step") * F.col(dt))
    ended = F.col("__at") >= F.col("__end")
    mine = F.when(ended, F.col("__t2").isNull()).when(F.col("__at") <= F.col(t), F.col("__first")).otherwise(F.col("__at") <= F.col("__t2"))
    over = F.lit(0.0) if last == "zero" else F.col(value)
    inside = F.col(value) + (F.col("__at") - F.col(t)) / (F.col("__t2") - F.col(t)) * (F.col("__v2") - F.col(value))
    # The only point of a curve, and what stands before the first, hold their value.
    result = F.when(F.col("__at") <= F.col(t), F.when(ended & ~F.col("__first"), over).otherwise(F.col(value))).when(ended, over).otherwise(inside)
    return rows.filter(mine).select(*keys, F.col("__step").alias("step"), F.col("__at").alias(t), result.alias(value))


def unit_ordinates(basins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ordinate, u) in m3/s a millimetre of basins (keys, length, to_centroid, slope, area, zone, dt_h): the synthetic unit hydrograph at
    uniform steps, scaled to area x 1000 m3 a millimetre."""
    h = river.unit_hydrograph(*[F.col(c) for c in ("length", "to_centroid", "slope", "area", "zone")])
    shape = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in river.UNIT_SHAPE])
    rows = basins.select(*keys, "area", "dt_h", h["tp"].alias("tp"), h["qpa"].alias("qpa"), F.explode(shape).alias("s"))
    curve = rows.select(*keys, "area", (F.col("s.a") * F.col("tp")).alias("t"), (F.col("s.b") * F.col("qpa")).alias("q"), F.col("dt_h").alias("dt"))
    u = uniform(curve, [*keys, "area", "dt"], last="zero", up=True)
    held = F.sum("q").over(Window.partitionBy(*keys)) * F.col("dt") * 3600
    return u.select(*keys, F.col("step").alias("ordinate"), (F.col("q") * F.when((held > 0) & (F.col("area") > 0), F.col("area") * 1000 / held).otherwise(1.0)).alias("u"))


def base_flow(step: Column, base: Column, recession_per_h: Column | None = None, dt_h: Column | None = None) -> Column:
    """A constant flow, or one that falls off exponentially where the rate is above 0."""
    if recession_per_h is None:
        return base
    return F.when(recession_per_h > 0, base * F.exp(-recession_per_h * step * dt_h)).otherwise(base)


def storm_hydrographs(basins: DataFrame, keys: Sequence[str], exponent: float = 0.7) -> DataFrame:
    """(keys, step, t_s, q) of basins (keys, length, to_centroid, slope, area, zone, cn, total, duration_h, pattern, dt_h, base).

    dt_h is the step of storm and flood; where it is null it is the unit hydrograph's own duration. base is a
    constant flow that is added. Basins whose measures lack give no rows."""
    keys = list(keys)
    tu = river.unit_hydrograph(*[F.col(c) for c in ("length", "to_centroid", "slope", "area", "zone")])["tu"]
    rows = basins.withColumn("dt_h", F.coalesce("dt_h", tu)).filter("dt_h > 0 and area > 0 and cn > 0")
    rain = hyetograph(rows, keys, exponent).join(rows.select(*keys, "cn"), keys)
    effective = routing.scs_increments(rain, keys, F.col("cn")).select(*keys, "step", "pe")
    met = effective.join(unit_ordinates(rows, keys), keys)
    direct = met.groupBy(*keys, (F.col("step") + F.col("ordinate")).alias("step")).agg(F.sum(F.col("pe") * F.col("u")).alias("q"))
    return direct.join(rows.select(*keys, "dt_h", "base"), keys).select(*keys, "step", (F.col("step") * F.col("dt_h") * 3600).alias("t_s"), (F.col("q") + F.coalesce("base", F.lit(0.0))).alias("q"))


def summary(hydrographs: DataFrame, basins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, peak, peak_step, volume): the largest flow, its first step, and the direct runoff in m3 without the base flow."""
    keys = list(keys)
    first = hydrographs.groupBy(*keys).agg(F.max(F.struct("q", (-F.col("step")).alias("s"))).alias("m"), F.sum("q").alias("sum"), F.count(F.lit(1)).alias("n"), (F.max("t_s") / F.max("step")).alias("dt"))
    rows = first.join(basins.select(*keys, F.coalesce("base", F.lit(0.0)).alias("base")), keys)
    return rows.select(*keys, F.col("m.q").alias("peak"), (-F.col("m.s")).alias("peak_step"), ((F.col("sum") - F.col("n") * F.col("base")) * F.col("dt")).alias("volume"))
