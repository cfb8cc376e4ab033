"""Pools behind dams: which cells a rising level reaches, and how much it stores.

A cell of a dam's basin belongs to the pool at a level where a way over cells below that level, neighbours by
side, joins it to the dam. The lowest such level is the cell's flood level: the least, over all ways to the dam,
of the highest ground on the way. It is found for all cells and levels at once from a merge tree: the basin's
parts grow by joining along their lowest rim, and what a part's cells reach after that is the higher of the rim
and of what the part behind it reaches. Every round at least halves the parts that do not hold the dam.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop
from .pointers import follow


def flood_levels(cells: DataFrame, dams: DataFrame, keys: Sequence[str] = ("dam",)) -> DataFrame:
    """(keys, row, col, z, level) of basin cells (keys, row, col, z) that are joined to their dam's cell (keys, row, col): flooded where the water is above `level`.

    keys tell dams, and so basins, apart; a cell in several basins has a row for each. Cells without a way to the
    dam are left out, and so are cells without height."""
    keys = list(keys)
    base = cut(cells.filter("z is not null").select(*keys, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("z").cast("double").alias("z")))
    # A part is named by a number of its own: the cell's place in its basin's frame.
    frame = base.groupBy(*keys).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("col") - F.min("col") + 1).alias("w"))
    name = (F.col("row") - F.col("r0")) * F.col("w") + F.col("col") - F.col("c0")
    dam = dams.select(*keys, "row", "col", F.lit(True).alias("dam_cell"))
    cell = cut(base.join(frame, keys).withColumn("id", name).join(dam, [*keys, "row", "col"], "left").select(*keys, "row", "col", "id", "z", F.coalesce("dam_cell", F.lit(False)).alias("wet")))
    side = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    asked = cell.select(*keys, F.col("id").alias("a"), F.col("z").alias("za"), F.col("wet").alias("wa"), "row", "col", F.explode(side).alias("s")).select(*keys, "a", "za", "wa", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = cut(asked.join(cell.select(*keys, "row", "col", F.col("id").alias("b"), F.col("z").alias("zb"), F.col("wet").alias("wb")), [*keys, "row", "col"]).select(*keys, "a", "b", F.greatest("za", "zb").alias("rim"), "wa", "wb"))
    own = cut(cell.select(*keys, "id", F.col("id").alias("part"), F.col("z").alias("level"), F.col("wet").alias("done")))
    while True:
        both = edges.select(*keys, F.col("a").alias("part"), F.col("b").alias("to"), "rim", F.col("wa").alias("wet"), F.col("wb").alias("to_wet")).union(edges.select(*keys, "b", "a", "rim", "wb", "wa"))
        # Equal rims go by the pair's two names, so that two parts that choose each other choose one edge and rims never run in a circle.
        choice = F.struct("rim", F.least("part", "to").alias("u"), F.greatest("part", "to").alias("v"), "to", "to_wet")
        chosen = cut(both.filter("not wet").groupBy(*keys, "part").agg(F.min(choice).alias("c")).select(*keys, "part", "c.rim", "c.to", "c.to_wet"))
        if chosen.isEmpty():
            drop(chosen)
            break
        back = chosen.select(*keys, F.col("part").alias("to"), F.col("to").alias("back"))
        # Of two that choose each other the first stays; a part that holds the dam stays as well.
        stays = F.coalesce((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.lit(False))
        pointer = {**{f"to_{k}": k for k in keys}, "to_part": "to"}
        links = chosen.join(back, [*keys, "to"], "left").select(*keys, "part", *[F.when(~stays, F.col(c)).alias(n) for n, c in pointer.items()], F.when(stays, F.lit(float("-inf"))).otherwise(F.col("rim")).alias("rim"))
        ends = chosen.filter("to_wet").select(*keys, F.col("to").alias("part")).distinct()
        links = links.unionByName(ends.withColumn("rim", F.lit(float("-inf"))), allowMissingColumns=True)
        ended = follow(links, [*keys, "part"], list(pointer), maxima=["rim"])
        into = ended.select(*keys, "part", F.col("end_part").alias("whole"), "rim")
        wet_now = ends.select(*keys, F.col("part").alias("whole"), F.lit(True).alias("now_wet"))
        into = cut(into.join(wet_now, [*keys, "whole"], "left").select(*keys, "part", "whole", "rim", F.coalesce("now_wet", F.lit(False)).alias("now_wet")))
        moved = own.join(into, [*keys, "part"], "left")
        new_own = cut(moved.select(*keys, "id", F.coalesce("whole", "part").alias("part"), F.greatest("level", "rim").alias("level"), (F.col("done") | F.coalesce("now_wet", F.lit(False))).alias("done")))
        end = lambda c, w: into.select(*keys, F.col("part").alias(c), F.col("whole").alias(f"{c}2"), F.col("now_wet").alias(f"{w}2"))
        kept = edges.join(end("a", "wa"), [*keys, "a"], "left").join(end("b", "wb"), [*keys, "b"], "left")
        kept = kept.select(*keys, F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "rim", (F.col("wa") | F.coalesce("wa2", F.lit(False))).alias("wa"), (F.col("wb") | F.coalesce("wb2", F.lit(False))).alias("wb"))
        # Of several rims between two parts only the lowest matters.
        less = kept.filter("a <> b and not (wa and wb)").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rim", F.when(F.col("a") < F.col("b"), F.col("wa")).otherwise(F.col("wb")).alias("wa"), F.when(F.col("a") < F.col("b"), F.col("wb")).otherwise(F.col("wa")).alias("wb"))
        new_edges = cut(less.groupBy(*keys, "a", "b").agg(F.min("rim").alias("rim"), F.bool_or("wa").alias("wa"), F.bool_or("wb").alias("wb")))
        drop(edges, own, chosen, ended, into)
        edges, own = new_edges, new_own
    out = cut(cell.join(own.filter("done").select(*keys, "id", "level"), [*keys, "id"]).select(*keys, "row", "col", "z", "level"))
    drop(base, cell, edges, own)
    return out


def height_volume(levels: DataFrame, dams: DataFrame, cell_m2: float, keys: Sequence[str] = ("dam",), step: float = 2.0, highest: float = 60.0) -> DataFrame:
    """(keys, height, level, n, area, volume) at every `step` over the dam's ground up to `highest`, from flood_levels() and dams (keys, z).

    Cells are counted into the first step that floods them, then summed up along steps: no cell meets every step."""
    keys = list(keys)
    steps = int(highest / step + 1e-9)
    ground = dams.select(*keys, F.col("z").cast("double").alias("z0"))
    binned = levels.join(ground, keys).withColumn("k", F.greatest(F.lit(1), F.ceil((F.col("level") - F.col("z0")) / step)).cast("int"))
    # A level equal to the water's is not flooded.
    binned = binned.withColumn("k", F.when(F.col("z0") + F.col("k") * step <= F.col("level"), F.col("k") + 1).otherwise(F.col("k")))
    counted = binned.filter(F.col("k") <= steps).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"))
    rows = ground.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps)))).join(counted, [*keys, "k"], "left")
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n": F.sum(F.coalesce("n", F.lit(0))).over(w), "s": F.sum(F.coalesce("s", F.lit(0.0))).over(w)})
    level = F.col("z0") + F.col("k") * step
    return rows.select(*keys, (F.col("k") * step).alias("height"), level.alias("level"), "n", (F.col("n") * cell_m2).alias("area"), ((level * F.col("n") - F.col("s")) * cell_m2).alias("volume"))
