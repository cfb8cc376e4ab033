"""Delineation from points without reading the whole raster: windows widen only where a basin still touches their edge.

A raster is written as blocks, each with the rim of cells around it, so that flow directions of a block's own cells
need no other block. Blocks are partitions of the table: a round reads those that its windows newly cover, and only
these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, drop
from . import channels, terrain

#: Blocks named one by one in the filter of a read; beyond that they are joined.
LISTED_MOST = 4096


def block_of(row, col, size: int):
    """A block's name: its row and column of blocks in one number."""
    return F.floor(row / size).cast("bigint") * (1 << 31) + F.floor(col / size).cast("bigint")


def write_blocks(cells: DataFrame, path: str, size: int = 256) -> None:
    """Cells (row, col, z) as Parquet partitioned by block, every cell also in the blocks that it borders on. Rows and columns are 0 at least."""
    around = F.array_distinct(F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]), lambda s: block_of(F.greatest(F.lit(0), F.col("row") + s["a"]), F.greatest(F.lit(0), F.col("col") + s["b"]), size)))
    rows = cells.select("row", "col", F.col("z").cast("double").alias("z"), F.explode(around).alias("block"))
    own = cells.select(block_of(F.col("row"), F.col("col"), size).alias("block")).distinct()
    rows.join(own, "block", "left_semi").repartition("block").write.mode("overwrite").partitionBy("block").parquet(path)


def read_blocks(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """The cells of the blocks of a table (block), rims included: named in the scan's partition filter where they are few, else joined."""
    table = spark.read.parquet(path)
    some = [r.block for r in blocks.limit(LISTED_MOST + 1).collect()]
    return table.filter(F.col("block").isin(some)) if len(some) <= LISTED_MOST else table.join(F.broadcast(blocks), "block")


def block_directions(cells: DataFrame, size: int) -> DataFrame:
    """Flow directions of blocks' own cells, from cells with rims as read_blocks() gives them."""
    own = block_of(F.col("row"), F.col("col"), size) == F.col("block")
    return terrain.flow_directions(cells, ["block"]).filter(own)


def delineate(spark: SparkSession, path: str, points: DataFrame, size: int = 256, first: int = 64, growth: float = 2.2, rounds: int = 16) -> tuple[DataFrame, DataFrame]:
    """(basins, states) of points (point_id, row, col) on the raster of write_blocks().

    basins (point_id, row, col) are what the whole raster would give; states (point_id, half, truncated) tell how
    far a point's window reached, in cells, and whether its basin still touched the edge after the last round.
    Windows begin at `first` cells each way and grow by `growth`; points whose basin has a neighbour in a block that
    exists and was not read widen, the others are done. Points outside the raster get a state and no basin."""
    exist = cut(spark.read.parquet(path).select("block").distinct())
    left = cut(points.select("point_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")))
    known, loaded, half, basins, states = None, None, float(first), [], []
    for turn in range(rounds):
        reach = int(half)
        edge = lambda c, sign: F.greatest(F.lit(0), F.floor((F.col(c) + sign * reach) / size)).cast("bigint")
        wanted = left.select(F.explode(F.sequence(edge("row", -1), edge("row", 1))).alias("r"), edge("col", -1).alias("a"), edge("col", 1).alias("b")).select("r", F.explode(F.sequence("a", "b")).alias("c"))
        wanted = wanted.select((F.col("r") * (1 << 31) + F.col("c")).alias("block")).distinct().join(exist, "block", "left_semi")
        fresh = cut(wanted if loaded is None else wanted.join(loaded, "block", "left_anti"))
        more = cut(block_directions(read_blocks(spark, path, fresh), size))
        known = more if known is None else known.unionByName(more)
        loaded = fresh if loaded is None else loaded.unionByName(fresh)
        found = cut(channels.basins_of(known.drop("block"), left.join(known.select("row", "col"), ["row", "col"], "left_semi")))
        side = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in terrain.N8])
        beside = found.withColumn("s", F.explode(side)).select("point_id", (F.col("row") + F.col("s.a")).alias("r"), (F.col("col") + F.col("s.b")).alias("c")).filter("r >= 0 and c >= 0")
        unread = beside.select("point_id", block_of(F.col("r"), F.col("c"), size).alias("block")).distinct().join(exist, "block", "left_semi").join(loaded, "block", "left_anti")
        touching = cut(unread.select("point_id").distinct())
        last = turn == rounds - 1
        done = left.join(touching, "point_id", "left_anti")
        basins.append(cut(found if last else found.join(done.select("point_id"), "point_id", "left_semi")))
        states.append(cut(left.join(touching.withColumn("t", F.lit(True)), "point_id", "left").filter(F.lit(last) | F.col("t").isNull()).select("point_id", F.lit(reach).alias("half"), F.coalesce("t", F.lit(False)).alias("truncated"))))
        after = cut(left.join(touching, "point_id", "left_semi"))
        drop(found, touching, left)
        left = after
        if left.isEmpty():
            break
        half *= growth
    return reduce(DataFrame.unionByName, basins), reduce(DataFrame.unionByName, states)
