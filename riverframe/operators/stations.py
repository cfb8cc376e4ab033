"""Stations: catalogue scans, nearest and recommended stations, overrides and point in polygon."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import cut, drop, meet

#: Points that a smallest tile of nearest() holds on average, how often a tile is divided each way at a time, and km of a degree of a great circle, rounded up.
POINTS, PARTS, DEGREE_KM = 64, 4, 111.2


def near(points: DataFrame, stations: DataFrame, radius_km: float, cell_degrees: float | None = None) -> DataFrame:
    """Pairs within a radius: both sides fall into grid cells, points are copied to the cells around them, and equal cells join.

    points (point_id, lat, lon), stations (station_id, lat, lon, ...). Near the poles cells of longitude
    grow with 1 / cos(lat), so the reach in cells is taken per point. Across the 180th meridian cells wrap."""
    # Columns of cells go round evenly, so none is narrower than the others.
    size = 360 / max(1, int(360 / (cell_degrees or max(0.05, radius_km / 111.0))))
    reach = lambda degrees: F.ceil(degrees / size).cast("int")
    dlat = F.lit(radius_km / 110.0)
    dlon = F.least(F.lit(180.0), dlat / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs("p_lat") + dlat))), F.lit(0.01)))
    columns = round(360 / size)
    p = points.select(F.col("point_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    rows, cols = F.floor((F.col("p_lat") + 90) / size).cast("int"), F.floor((F.col("p_lon") + 180) / size).cast("int")
    p = p.withColumn("r", F.explode(F.sequence(rows - reach(dlat), rows + reach(dlat)))).withColumn("c", F.explode(F.array_distinct(F.transform(F.sequence(cols - reach(dlon), cols + reach(dlon)), lambda x: F.pmod(x, F.lit(columns))))))
    s = stations.withColumns({"r": F.floor((F.col("lat") + 90) / size).cast("int"), "c": F.pmod(F.floor((F.col("lon") + 180) / size).cast("int"), F.lit(columns))})
    distance = geo.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return p.join(s, ["r", "c"]).withColumn("km", distance).filter(F.col("km") <= radius_km).drop("r", "c")


def nearest(points: DataFrame, stations: DataFrame, n: int, tie: Sequence[str] = ("station_id",), levels: int | None = None) -> DataFrame:
    """The n nearest stations of every point: (point_id, rank, km, station columns).

    Points fall into tiles of latitude and longitude that are divided step by step. If the n-th nearest station of
    a tile's centre is D away and no point of the tile is farther than h from it, the n nearest of any of its points
    lie within D + 2h of the centre: a tile looks only among what its parent has left and keeps what lies within
    that. Each point then ranks the few stations of its smallest tile. Stations and tables of tiles are written
    once. Points without a position give no row; all stations take part where there are fewer than n."""
    stations = cut(stations.filter("lat is not null and lon is not null"))
    many, most = points.count(), stations.count()
    if levels is None:
        levels = 0 if most <= 4 * n else max(1, math.ceil(math.log(max(1, many / POINTS), PARTS * PARTS)))
    parts = PARTS**levels
    at = lambda v, low, span: F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((v - low) / span * parts))).cast("int")
    placed = points.filter("lat is not null and lon is not null").select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), at(F.col("lat"), -90.0, 180.0).alias("r"), at(F.col("lon"), -180.0, 360.0).alias("c"))
    left, steps = stations.withColumns({"r": F.lit(0), "c": F.lit(0)}), []
    if levels:
        tiles = cut(placed.groupBy("r", "c").agg(F.count(F.lit(1)).alias("points")))
        steps.append(tiles)
        for level in range(1, levels + 1):
            coarse, parent, size = PARTS ** (levels - level), PARTS ** (levels - level + 1), 180.0 / PARTS**level
            down = lambda c, d: F.floor(F.col(c) / d).cast("int")
            some = tiles.select(down("r", parent).alias("pr"), down("c", parent).alias("pc"), down("r", coarse).alias("r"), down("c", coarse).alias("c")).distinct()
            some = some.withColumns({"t_lat": -90 + (F.col("r") + 0.5) * size, "t_lon": -180 + (F.col("c") + 0.5) * 2 * size})
            met = some.join(left.withColumnsRenamed({"r": "pr", "c": "pc"}), ["pr", "pc"]).withColumn("d", geo.haversine_km(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("lon")))
            # Half the tile along the meridian, then half along the parallel, which is shorter than along the equator.
            half = DEGREE_KM * size * 1.5
            first = met.withColumn("k", F.row_number().over(Window.partitionBy("r", "c").orderBy("d"))).filter(F.col("k") <= n)
            reach = first.groupBy("r", "c").agg(F.max("d").alias("reach"))
            left = cut(met.join(reach, ["r", "c"]).filter(F.col("d") <= (F.col("reach") + 2 * half) * (1 + 1e-9)).select(*stations.columns, "r", "c"))
            steps.append(left)
    order = Window.partitionBy("point_id").orderBy("km", *tie)
    km = geo.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    ranked = placed.join(left, ["r", "c"]).withColumn("km", km).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    if not steps:
        return ranked.drop("p_lat", "p_lon", "r", "c")
    out = cut(ranked.drop("p_lat", "p_lon", "r", "c"))
    drop(*steps, stations)
    return out


def recommended(ranked: DataFrame, years: str = "n_years", least_years: int = 15) -> DataFrame:
    """One station per point among its nearest: long series if there are any, then years less a twentieth of the distance."""
    w = Window.partitionBy("point_id")
    long_ = F.col(years) >= least_years
    pool = ranked.withColumn("__any", F.max(long_.cast("int")).over(w)).filter((F.col("__any") == 0) | long_)
    order = w.orderBy((F.col(years) - F.col("km") / 20).desc(), "rank")
    return pool.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__any")


def first_usable(ranked: DataFrame, usable: Column) -> DataFrame:
    """The nearest of each point's ranked stations for which `usable` holds; points without one are left out."""
    w = Window.partitionBy("point_id").orderBy("rank")
    return ranked.filter(usable).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def override(base: DataFrame, own: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series of the user replace whole series of the catalogue."""
    return base.join(own.select(*keys).distinct(), list(keys), "left_anti").unionByName(own, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Catalogue merge: new rows replace old ones of equal key; the last of repeated new rows by all columns stays."""
    w = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *[F.col(c).desc_nulls_last() for c in old.columns if c not in keys])
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__new")


def exclude_years(series: DataFrame, excluded: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Series without excluded years; series that keep fewer than `least` values go."""
    left = series.join(excluded.select(*keys, "year").distinct(), [*keys, "year"], "left_anti")
    w = Window.partitionBy(*keys)
    return left.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") >= least).drop("__n")


def edges(polygons: DataFrame, polygon_id: str = "polygon_id", ring: str = "ring") -> DataFrame:
    """One row per edge of rings array<struct<lon,lat>>; rings may be open or closed."""
    r = F.col(ring)
    closed = F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    rows = polygons.select(polygon_id, F.posexplode(closed).alias("i", "a"), closed.alias("all")).withColumn("b", F.get("all", F.col("i") + 1)).filter("b is not null")
    return rows.select(polygon_id, F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))


def crosses(x: Column, y: Column) -> Column:
    """Whether a ray to the right from (x, y) crosses the edge x1, y1, x2, y2; edges are half open."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1)


def inside(points: DataFrame, polygons: DataFrame, point_id: str = "point_id", polygon_id: str = "polygon_id", cell: float = 0.25) -> DataFrame:
    """Pairs (point_id, polygon_id) by parity of crossings; bounding boxes, cut into grid cells, are joined first."""
    e = edges(polygons, polygon_id)
    box = e.groupBy(polygon_id).agg(*[f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for n, f, a, b in (("w", F.min, "x1", "x2"), ("s", F.min, "y1", "y2"), ("e", F.max, "x1", "x2"), ("n", F.max, "y1", "y2"))])
    at = lambda c: F.floor(c / cell).cast("int")
    cells = box.withColumn("r", F.explode(F.sequence(at(F.col("s")), at(F.col("n"))))).withColumn("c", F.explode(F.sequence(at(F.col("w")), at(F.col("e")))))
    p = points.select(point_id, "lon", "lat").withColumns({"r": at(F.col("lat")), "c": at(F.col("lon"))})
    near_ = p.join(cells, ["r", "c"]).filter((F.col("lon") >= F.col("w")) & (F.col("lon") <= F.col("e")) & (F.col("lat") >= F.col("s")) & (F.col("lat") <= F.col("n")))
    hits = near_.select(point_id, polygon_id, "lon", "lat").join(e, polygon_id).filter(crosses(F.col("lon"), F.col("lat")))
    return hits.groupBy(point_id, polygon_id).agg(F.count(F.lit(1)).alias("__k")).filter("__k % 2 = 1").drop("__k")


def upstream(basins: DataFrame, start: DataFrame, node: str = "id", down: str = "next_down") -> DataFrame:
    """(root, id): all basins that drain to each root, itself included.

    Pointers down the tree are doubled: after k rounds all basins within 2^k - 1 steps of a root are found, and a
    round that finds none ends the search, so rounds are log2 of the longest way. Each is one join over all roots
    at once; lineage is cut. Basins on a cycle are met again and count once."""
    jump = basins.select(F.col(node).alias("up"), F.col(down).alias("down")).filter("up is not null and down is not null").distinct()
    seen = start.select(F.col(node).alias("root"), F.col(node).alias("id")).distinct()
    while True:
        more = meet(seen, jump, F.col("down") == F.col("id")).select("root", F.col("up").alias("id")).distinct()
        more = cut(meet(more, seen, ["root", "id"], "left_anti"))
        if more.isEmpty():
            return seen
        seen = cut(seen.union(more))
        far = jump.select(F.col("up").alias("down"), F.col("down").alias("far"))
        jump = cut(meet(jump, far, "down").select("up", F.col("far").alias("down")).distinct())
