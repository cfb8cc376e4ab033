"""Scour of sections by strips and over layered beds, in expressions and grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import river

# Design return periods by kind of work, and recommended freeboard by debris.
DESIGN_PERIODS = (("bridge", 100, 200), ("culvert on a main road", 25, 50), ("culvert on a local road", 10, 25), ("ford", 25, 50), ("bank protection", 100, 100), ("road drainage", 10, 10), ("major structure", 100, 200))
FREEBOARD = {"low": 0.5, "medium": 1.0, "high": 1.5, "extreme": 2.0}


def layer_d50(layers: Column, depth: Column, otherwise: Column) -> Column:
    """Grain size at a depth under the bed: of the first layer (d50_mm, thickness) that reaches it, below all layers of the last; without layers `otherwise`."""
    bottoms = F.transform(layers, lambda x, i: F.struct(x["d50_mm"].alias("d"), F.aggregate(F.slice(layers, 1, i + 1), F.lit(0.0), lambda a, y: a + y["thickness"]).alias("to")))
    hit = F.try_element_at(F.filter(bottoms, lambda x: x["to"] >= depth), F.lit(1))
    return F.when(layers.isNull() | (F.size(layers) == 0), otherwise).otherwise(F.coalesce(hit["d"], F.try_element_at(layers, F.lit(-1))["d50_mm"]))


def settle(start: Column, step, rounds: int = 25, tolerance: float = 0.005) -> Column:
    """Fixed point of step by repeated substitution; it stays where two rounds differ by less than the tolerance."""
    begin = F.struct(start.cast("double").alias("x"), F.lit(False).alias("done"))

    def once(s: Column, _: Column) -> Column:
        new = step(s["x"])
        return F.struct(F.when(s["done"], s["x"]).otherwise(new).alias("x"), (s["done"] | (F.abs(new - s["x"]) < tolerance)).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, once, lambda s: s["x"])


def neill_layered(unit_flow: Column, depth: Column, d50: Column, layers: Column, rock: Column) -> Column:
    """Scour under the bed by competent velocity, with the grain size of the layer that is reached and a floor of rock (null: none)."""
    ds = settle(depth, lambda x: river.neill_depth(unit_flow, layer_d50(layers, x - depth, d50)))
    return F.greatest(F.lit(0.0), F.coalesce(F.least(ds - depth, rock), ds - depth))


def lischtvan_layered(alpha: Column, beta: Column, depth: Column, d50: Column, layers: Column, rock: Column) -> Column:
    def step(x: Column) -> Column:
        d = layer_d50(layers, x - depth, d50)
        return river.lischtvan_depth(alpha, depth, beta, river.exponent_granular(d), d)

    ds = settle(1.2 * depth, step)
    return F.greatest(F.lit(0.0), F.coalesce(F.least(ds - depth, rock), ds - depth))


def strips(points: DataFrame, keys: Sequence[str], level: Column) -> DataFrame:
    """Wet strips between profile points (keys, s, z): (keys, mid, w, h)."""
    w = Window.partitionBy(*keys).orderBy("s")
    rows = points.withColumns({"s2": F.lead("s").over(w), "z2": F.lead("z").over(w)}).filter("s2 is not null").withColumns({"a": level - F.col("z"), "c": level - F.col("z2")}).filter("a > 0 or c > 0")
    cut = F.col("s") + F.col("a") / F.when(F.col("a") != F.col("c"), F.col("a") - F.col("c")) * (F.col("s2") - F.col("s"))
    left, right = F.when(F.col("a") < 0, cut).otherwise(F.col("s")), F.when(F.col("c") < 0, cut).otherwise(F.col("s2"))
    h = (F.greatest("a", F.lit(0.0)) + F.greatest("c", F.lit(0.0))) / 2
    return rows.select(*keys, ((left + right) / 2).alias("mid"), (right - left).alias("w"), h.alias("h")).filter("w > 0 and h > 1e-3")


def by_strips(points: DataFrame, sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scour of each wet strip, the flow shared by conveyance: sections (keys, level, flow, area, width, d50, layers, rock, t); the larger of two methods is adopted."""
    joined = points.join(sections.select(*keys, "level"), list(keys))
    wet = strips(joined, keys, F.col("level")).join(sections, list(keys))
    k = river.power(F.col("h"), 5 / 3)
    unit = F.col("flow") * k / F.sum(k * F.col("w")).over(Window.partitionBy(*keys))
    alpha = F.col("flow") / (river.power(F.col("area") / F.col("width"), 5 / 3) * F.col("width"))
    rows = wet.withColumns({"unit_flow": unit, "alpha": alpha, "beta": river.frequency_beta(F.col("t"))})
    rows = rows.withColumns({
        "neill": neill_layered(F.col("unit_flow"), F.col("h"), F.col("d50"), F.col("layers"), F.col("rock")),
        "lischtvan": lischtvan_layered(F.col("alpha"), F.col("beta"), F.col("h"), F.col("d50"), F.col("layers"), F.col("rock")),
    })
    return rows.select(*keys, "mid", "w", "h", (F.col("unit_flow") / F.col("h")).alias("v"), "neill", "lischtvan", F.greatest("neill", "lischtvan").alias("scour"), (F.col("level") - F.col("h") - F.greatest("neill", "lischtvan")).alias("bed"))


def freeboard(checks: DataFrame, level: str = "level", soffit: str = "soffit", required: str = "required") -> DataFrame:
    """Clearance under a deck, whether it is enough, and what is missing."""
    free = F.col(soffit) - F.col(level)
    return checks.withColumns({"clearance": free, "ok": free >= F.col(required), "deficit": F.greatest(F.lit(0.0), F.col(required) - free)})


def general(points: DataFrame, sections: DataFrame, keys: Sequence[str], contraction: float = 1.0) -> DataFrame:
    """(keys, deepest, general_lischtvan, scoured_bed, general_neill) of sections (keys, level, flow, area, width, d50, t) and their profiles (keys, s, z).

    general_lischtvan is the largest of the profile's wet points, with the flow shared by depth over the width between
    the outermost of them; general_neill lowers the mean depth until the mean velocity is competent. Fewer than two wet points scour nothing."""
    depth = F.col("level") - F.col("z")
    wet = points.select(*keys, "s", "z").join(sections.select(*keys, "level"), list(keys)).filter(depth > 0).withColumn("h", depth)
    reach = wet.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("s") - F.min("s")).alias("be"), F.max("h").alias("deepest"))
    rows = sections.join(reach, list(keys)).filter("n > 1")
    hm = F.col("area") / F.col("width")
    rows = rows.withColumns({"alpha": F.col("flow") / (river.power(hm, 5 / 3) * F.col("be") * contraction), "beta": river.frequency_beta(F.col("t")), "x": river.exponent_granular(F.col("d50"))})
    hs = river.lischtvan_depth(F.col("alpha"), F.col("h"), F.col("beta"), F.col("x"), F.col("d50"))
    at = wet.select(*keys, "h", F.col("level").alias("__level")).join(rows.select(*keys, "alpha", "beta", "x", "d50"), list(keys))
    found = at.groupBy(*keys).agg(F.max(F.greatest(F.lit(0.0), hs - F.col("h"))).alias("general_lischtvan"), F.min(F.col("__level") - hs).alias("scoured_bed"))
    neill = F.greatest(F.lit(0.0), river.neill_depth(F.col("flow") / F.greatest(F.lit(1e-3), F.col("be")), F.col("d50")) - hm)
    return rows.select(*keys, "deepest", neill.alias("general_neill")).join(found, list(keys)).select(*keys, "deepest", "general_lischtvan", "scoured_bed", "general_neill")


def combined(points: DataFrame, sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per section with what scours it: (keys, general_lischtvan, general_neill, general_strips, general, local_csu, local, total, total_csu, live_bed, scoured_bed).

    sections (keys, level, flow, area, width, v, froude, d50, t, layers, rock, pier_width, pier_shape, pier_angle, pier_length,
    k3). general is the largest of three methods. local is the envelope of five for a pier, 0 without one; total adds
    general and local; total_csu adds the first general method and the first local one, as reports list them. live_bed:
    the mean velocity is above the competent one of the deepest point. Sections without two wet points have their strips alone."""
    g = general(points, sections, keys)
    s = by_strips(points, sections.select(*keys, "level", "flow", "area", "width", "d50", "layers", "rock", "t"), keys).groupBy(*keys).agg(F.max("scour").alias("general_strips"))
    rows = sections.join(g, list(keys), "left").join(s, list(keys), "left")
    pier = river.pier_scour(F.col("pier_width"), F.col("deepest"), F.col("froude"), F.col("d50"), F.col("pier_shape"), F.coalesce("pier_angle", F.lit(0.0)), F.coalesce("pier_length", F.lit(0.0)), F.coalesce("k3", F.lit(1.1)))
    none = F.lit(0.0)
    has = F.coalesce(F.col("pier_width") > 0, F.lit(False)) & F.col("deepest").isNotNull()
    three = {c: F.coalesce(c, none) for c in ("general_lischtvan", "general_neill", "general_strips")}
    rows = rows.withColumns({**three, "local_csu": F.when(has, pier["csu"]).otherwise(none), "local": F.when(has, pier["envelope"]).otherwise(none)})
    rows = rows.withColumn("general", F.greatest(*three))
    live = F.coalesce(F.col("v") > river.competent_velocity(F.col("deepest"), F.col("d50")), F.lit(False))
    return rows.select(*keys, *three, "general", "local_csu", "local", (F.col("general") + F.col("local")).alias("total"), (F.col("general_lischtvan") + F.col("local_csu")).alias("total_csu"), live.alias("live_bed"), "scoured_bed")


#: The columns of a section report, in order, and how many decimals each has (None: text).
REPORT = {
    "section": None, "station": 2, "level": 3, "critical_level": 3, "energy": 3, "depth": 3, "area": 3, "width": 3, "radius": 3, "v": 3, "fr": 3, "slope": 6, "regime": None, "shear": 3, "power": 3, "shields": 3,
    "v_critical": 3, "moves": None, "mode": None, "bed_load_kg_s": 3, "scour_general": 3, "scour_local": 3, "scour_total": 3, "scoured_bed": 3,
}


def report(profile: DataFrame) -> DataFrame:
    """The columns of REPORT from a profile (section, station, level, critical_level, energy, depth, area, width, radius, v, fr, slope, d50, scour_general, scour_local, scoured_bed)."""
    j, d = F.greatest("slope", F.lit(1e-6)), F.col("d50") / 1000
    shear = river.bed_shear(F.col("radius"), j)
    drag = river.drag_velocity(d, F.col("depth"))
    load = river.meyer_peter_muller(F.col("depth"), j, d)
    own = river.bed_shear(F.col("depth"), j)
    mode = river.rouse_mode(river.rouse_number(river.fall_velocity(d), F.sqrt(own / river.RHO)))
    rows = profile.withColumns({
        "slope": j, "regime": F.when(F.col("fr") > 1, "supercritical").otherwise("subcritical"), "shear": shear, "power": shear * F.col("v"), "shields": river.shields(own, d), "v_critical": drag, "moves": F.when(load > 0, "yes").otherwise("no"),
        "mode": mode, "bed_load_kg_s": load * F.col("width") * river.SEDIMENT * river.RHO, "scour_total": F.coalesce("scour_general", F.lit(0.0)) + F.coalesce("scour_local", F.lit(0.0)),
    })
    return rows.select(*REPORT)


def report_lines(rows: DataFrame) -> DataFrame:
    """(section, station, line): the report as lines of comma-separated text, missing and infinite numbers as nothing; the header is report_header()."""
    number = lambda c, n: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.format_string(f"%.{n}f", F.col(c).cast("double"))).otherwise("")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) if n is None else number(c, n) for c, n in REPORT.items()]
    return rows.select("section", "station", F.concat_ws(",", *cells).alias("line"))


def report_header() -> str:
    return ",".join(REPORT)
