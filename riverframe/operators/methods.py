"""Design flows at points by every method, with coefficient dictionaries that do not cover everything.

A point keeps a row for each method and return period whatever happens: where a coefficient is not in its
dictionary the flow is null and `reason` says so, and `applies` tells whether the method's range covers the point.
Dictionaries are tables that are checked before they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interpolate, river

#: Methods and the order in which equal flows are adopted; the first three use flow records, the others rain.
METHODS = ("direct", "transposition", "regional", "unit_hydrograph", "rational", "verni_king", "zone_curve")
#: Most bytes of a dictionary that is sent to all tasks.
BROADCAST_MOST = 8 << 20


def problems(dim: DataFrame, on: Sequence[str], values: Sequence[str] = (), positive: Sequence[str] = ()) -> DataFrame:
    """(on, problem) of the entries that a dictionary may not have: null or repeated keys, missing values, values not above 0."""
    w = Window.partitionBy(*on)
    found = F.array_compact(F.array(
        F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on]), F.lit("null key")),
        F.when(F.col("__n") > 1, F.lit("repeated key")),
        *[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in values],
        *[F.when(F.col(c) <= 0, F.lit(f"{c} is not above 0")) for c in positive],
    ))
    return dim.withColumn("__n", F.count(F.lit(1)).over(w)).select(*on, F.explode(found).alias("problem")).distinct()


def checked(dim: DataFrame, on: Sequence[str], values: Sequence[str] = (), positive: Sequence[str] = ()) -> DataFrame:
    """The dictionary itself; ValueError with its first problems where it has any."""
    wrong = problems(dim, on, values, positive).orderBy(*on, "problem").limit(5).collect()
    if wrong:
        raise ValueError("dictionary: " + "; ".join(f"{', '.join(str(r[c]) for c in on)}: {r.problem}" for r in wrong))
    return dim


def small(dim: DataFrame) -> DataFrame:
    """The dictionary marked for broadcast where its estimated size allows, else as it is, for a shuffled join."""
    size = dim.agg(F.sum(F.length(F.to_json(F.struct(*dim.columns)))).alias("n")).first().n or 0
    return F.broadcast(dim) if size <= BROADCAST_MOST else dim


def lookup(rows: DataFrame, dim: DataFrame, on: str, values: Sequence[str], chain: Sequence[Column], found: str) -> DataFrame:
    """rows with a dictionary's values by the first key of a chain that it has.

    chain: keys in the order in which they are tried, as columns of rows; null keys match nothing. `found` names the
    column that says which one matched, from 1, or null. No row is dropped or repeated."""
    dim = small(dim.select(F.col(on).alias("__on"), F.struct(*values).alias("__v")))
    out = rows
    for i, key in enumerate(chain, 1):
        out = out.join(dim.select(F.col("__on").alias(f"__on{i}"), F.col("__v").alias(f"__v{i}")), key == F.col(f"__on{i}"), "left")
    v = [F.col(f"__v{i}") for i in range(1, len(chain) + 1)]
    first = F.coalesce(*v)
    which = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(v, 1)])
    return out.select(*rows.columns, *[first[c].alias(c) for c in values], which.alias(found))


def as_of(rows: DataFrame, dim: DataFrame, on: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """rows (on, at) with the values of their key's latest entry at or before `at`; null where there is none.

    A key's entries become one sorted array, so rows are looked up where they stand, whatever number has one key;
    of entries with equal `at` the largest by values counts."""
    entries = dim.filter(F.col(at).isNotNull()).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(at, *values))).alias("__e"))
    met = rows.join(small(entries), list(on), "left")
    last = F.try_element_at(F.filter("__e", lambda e: e[at] <= F.col(at)), F.lit(-1))
    return met.select(*rows.columns, *[last[c].alias(c) for c in values])


def chosen_distribution(fitted: DataFrame, best: DataFrame, override: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, dist, chosen): the user's distribution where it was fitted for the series, else the best; every series of `best` stays.

    override (keys, dist): "auto" and unknown names count as none; of several the first by name is taken."""
    own = override.groupBy(*keys).agg(F.min(F.when(F.col("dist") != "auto", F.col("dist"))).alias("__own"))
    known = fitted.select(*keys, F.col("dist").alias("__own")).distinct().withColumn("__has", F.lit(True))
    rows = best.select(*keys, "dist").join(own, list(keys), "left").join(known, [*keys, "__own"], "left")
    return rows.select(*keys, F.when(F.col("__has"), F.col("__own")).otherwise(F.col("dist")).alias("dist"), F.coalesce("__has", F.lit(False)).alias("chosen"))


def rain_methods(points: DataFrame, rain: DataFrame, dims: dict[str, DataFrame], factor_t: Sequence[float], factor: Sequence[float], default_zone: str, areal_reduction: bool = True) -> DataFrame:
    """(point_id, t, method, applies, q, reason, extrapolated) by the four rain methods.

    points (point_id, area, region, zone, c_rational, c_verni, tc_h, length, to_centroid, slope, cn, unit_zone); own
    coefficients go before those of the region. rain (point_id, t, p24) in mm; the zone method's base is the rain of
    10 years. dims: rational and verni (region, c10), default_zones (region, zone), zones (zone, law, alpha), curves
    (zone, t, ratio) and laws (law, k, exp_area, exp_rain). A zone that is null falls back to the region's, then to
    default_zone; one that is given but unknown does not. Curves go on beyond their last knot in ln t, flagged.
    areal_reduction: whether rain is reduced by the basin's area first."""
    region = F.col("region")
    p = lookup(points, checked(dims["rational"], ["region"], ["c10"], ["c10"]).withColumnRenamed("c10", "__rc"), "region", ["__rc"], [region], "__fr")
    p = lookup(p, checked(dims["verni"], ["region"], ["c10"], ["c10"]).withColumnRenamed("c10", "__vc"), "region", ["__vc"], [region], "__fv")
    p = lookup(p, checked(dims["default_zones"], ["region"], ["zone"]).withColumnRenamed("zone", "__rz"), "region", ["__rz"], [region], "__fz")
    p = p.withColumn("__zone", F.coalesce("zone", "__rz", F.lit(default_zone)))
    p = lookup(p, checked(dims["zones"], ["zone"], ["law", "alpha"], ["alpha"]), "zone", ["law", "alpha"], [F.col("__zone")], "__fa")
    p = lookup(p, checked(dims["laws"], ["law"], ["k", "exp_area", "exp_rain"], ["k"]), "law", ["k", "exp_area", "exp_rain"], [F.col("law")], "__fl")
    knots = checked(dims["curves"], ["zone", "t"], ["ratio"]).groupBy("zone").agg(F.array_sort(F.collect_list(F.struct(F.log(F.col("t").cast("double")).alias("x"), F.col("ratio").cast("double").alias("y")))).alias("__knots"))
    p = lookup(p, knots, "zone", ["__knots"], [F.col("__zone")], "__fk")
    area = F.col("area")
    reduced = F.col("p24") * (river.areal_reduction(area) if areal_reduction else F.lit(1.0))
    base = rain.filter("t = 10").select("point_id", F.col("p24").alias("__p10"))
    rows = p.join(rain.select("point_id", "t", "p24"), "point_id").join(base, "point_id", "left").withColumn("__p", reduced)
    p10 = F.col("__p10") * (river.areal_reduction(area) if areal_reduction else F.lit(1.0))
    t = F.col("t")
    by_period = interpolate.table(t, factor_t, factor, log_x=True)
    unit = river.unit_hydrograph(*[F.col(c) for c in ("length", "to_centroid", "slope", "area", "unit_zone")])
    whole = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in ("length", "to_centroid", "slope", "area", "cn")]) & unit["qpa"].isNotNull()
    c_rational, c_verni = F.coalesce("c_rational", "__rc"), F.coalesce("c_verni", "__vc")
    ratio = interpolate.curve(F.log(t.cast("double")), F.col("__knots"), after="extend")
    past = F.log(t.cast("double")) > F.try_element_at("__knots", F.lit(-1))["x"]
    no = F.lit(None).cast("string")
    struct = lambda name, applies, q, reason, extra=F.lit(False): F.struct(F.lit(name).alias("method"), F.coalesce(applies & reason.isNull(), F.lit(False)).alias("applies"), F.when(reason.isNull(), q).alias("q"), reason.alias("reason"), F.coalesce(extra, F.lit(False)).alias("extrapolated"))
    each = F.array(
        struct("unit_hydrograph", area.between(10, 4500), unit["qpa"] * river.scs_runoff(F.col("__p"), F.col("cn")), F.when(~F.coalesce(whole, F.lit(False)), "no basin measures")),
        struct("rational", area < 25, c_rational * by_period * river.grunsky(F.col("__p"), F.col("tc_h")) * area / 3.6, F.when(c_rational.isNull(), "no coefficient").when(~F.coalesce(F.col("tc_h") > 0, F.lit(False)), "no time of concentration").otherwise(no)),
        struct("verni_king", area.between(10, 10000), c_verni * by_period * 0.00618 * river.power(area, 0.88) * river.power(F.col("__p"), 1.24), F.when(c_verni.isNull(), "no coefficient").otherwise(no)),
        struct("zone_curve", area > 20, F.col("k") * F.pow(area, F.col("exp_area")) * F.pow(p10, F.col("exp_rain")) * ratio * F.col("alpha"), F.when(F.col("alpha").isNull(), "no zone").when(F.col("k").isNull(), "no law").when(F.col("__knots").isNull(), "no curve").when(F.col("__p10").isNull(), "no rain of 10 years").otherwise(no), past),
    )
    return rows.select("point_id", "t", F.explode(each).alias("m")).select("point_id", "t", "m.*")


def flow_methods(points: DataFrame, flows: DataFrame, donors: DataFrame, periods: Sequence[float], instant: Column | None = None) -> DataFrame:
    """(point_id, t, method, applies, q, reason, extrapolated) by the three methods that use records.

    points (point_id, area, station_id, control_area); flows (station_id, t, q) of the chosen distributions; donors
    (point_id, station_id, km, control_area) are the stations of the regional mean, weighted by 1 / km, 1 km at
    least. direct multiplies by `instant`. Points without station, and donors without area, keep rows without flow."""
    direct = F.col("q") * (instant if instant is not None else F.lit(1.0))
    kind = dict(flows.dtypes)["t"]
    rows = points.withColumn("t", F.explode(F.array(*[F.lit(t).cast(kind) for t in periods]))).join(flows, ["station_id", "t"], "left")
    area, control = F.col("area"), F.col("control_area")
    weight = 1 / F.greatest("km", F.lit(1.0))
    moved = donors.filter("control_area > 0").join(points.select("point_id", F.col("area").alias("__area")), "point_id").join(flows, "station_id")
    mean = moved.groupBy("point_id", "t").agg((F.sum(weight * F.col("q") * river.power(F.col("__area") / control, 0.88)) / F.sum(weight)).alias("__regional"))
    rows = rows.join(mean, ["point_id", "t"], "left")
    no = F.lit(None).cast("string")
    lacks = F.when(F.col("station_id").isNull(), "no station").when(F.col("q").isNull(), "no record").otherwise(no)
    struct = lambda name, q, reason: F.struct(F.lit(name).alias("method"), reason.isNull().alias("applies"), F.when(reason.isNull(), q).alias("q"), reason.alias("reason"), F.lit(False).alias("extrapolated"))
    each = F.array(
        struct("direct", direct, lacks),
        struct("transposition", F.col("q") * river.power(area / control, 0.88), F.coalesce(lacks, F.when(~F.coalesce((area > 0) & (control > 0), F.lit(False)), "no area").otherwise(no))),
        struct("regional", F.col("__regional"), F.when(F.col("__regional").isNull(), "no donors").otherwise(no)),
    )
    return rows.select("point_id", "t", F.explode(each).alias("m")).select("point_id", "t", "m.*")


def select_method(flows: DataFrame, choice: DataFrame, arid: Column | None = None) -> DataFrame:
    """(point_id, t, method, q, reason, how): the flow by each point's chosen method, or the adopted one where the choice is null or missing.

    A point whose chosen method is not among METHODS keeps a row per period with reason "unknown method". Adopted is,
    where `arid` (a column of choice) holds, the first of direct and transposition that has a flow; else the largest
    that applies; else the largest of all. Equal flows go by the order of METHODS; points without any flow stay."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    named = choice.select("point_id", F.col("method").alias("__choice"), F.coalesce(arid if arid is not None else F.lit(False), F.lit(False)).alias("__arid"))
    rows = flows.join(named, "point_id", "left")
    asked = F.col("__choice").isNotNull()
    by_record = F.col("__arid") & F.col("method").isin("direct", "transposition") & F.col("q").isNotNull()
    w = Window.partitionBy("point_id", "t").orderBy(
        F.coalesce(F.col("method") == F.col("__choice"), F.lit(False)).desc(), (~asked & F.coalesce(by_record, F.lit(False))).desc(), F.when(~asked & by_record, order).asc_nulls_last(),
        (F.col("applies") & F.col("q").isNotNull()).desc(), F.col("q").desc_nulls_last(), order,
    )
    first = rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    unknown = asked & (F.col("method") != F.col("__choice"))
    return first.select("point_id", "t", F.when(unknown, F.col("__choice")).otherwise(F.col("method")).alias("method"), F.when(~unknown, F.col("q")).alias("q"), F.when(unknown, "unknown method").otherwise(F.col("reason")).alias("reason"), F.when(asked, "chosen").otherwise("adopted").alias("how"))
