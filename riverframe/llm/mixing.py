"""Mixing sources to target weights by systematic sampling.

Sources share the total size by weight; no target passes `most` times its source's size, and what
is over is shared again by weight until none is above. A document expects target / source size
copies. Within a source the documents stand in order of (size, id), the expected copies are summed
up along that order from one random offset, and a document is taken once per integer that its
interval crosses, so each source's taken size comes near its target.

Running positions come from three levels of counts, per (source, size, id block), per (source, size)
and per source, so that neither a hot source nor a hot size is ever ordered by one task where ids are dense;
an id block then is of bounded length. Where ids are sparse, blocks are the ranges of as many ids that the
table spans, so a hot pair of source and size still falls into at most BLOCKS of them.

Null texts have size 0; a null source is a source of its own, ordered last. Sources with no words get
target 0 and nothing is taken from them. Rows without an id stand first in their size. Rows that repeat an
id and a size stand next to each other in any order and are taken on their own, each by its own count. A text
of any length counts by its number of words. An empty table gives an empty result; other columns pass
through mix() untouched, whatever their names (those starting with __ excepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, size_at_most, table, word_count

#: Ids a block holds where ids are dense, and blocks that the ids are dealt to where they are sparse.
BLOCK, BLOCKS = 4096, 1 << 16
#: Most bytes of (id, copies) that may be broadcast to meet their rows; more are joined by a shuffle.
BROADCAST_MOST = 8 << 20


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x01null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """From rows (source, source_size), one per source: weight and target. What no source can hold is left out.

    The table has one row per source; the windows below order sources, not documents."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", F.col("source_size").cast("bigint").alias("source_size"), w.alias("weight"))
    # A source is capped when its cap per weight is under the level that the others share: look at them by cap per weight.
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumns({"before": F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * F.lit(float(most)), "left": F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)), "total": F.sum("source_size").over(everywhere)})
    ranked = ranked.withColumn("rest", F.col("total") - F.col("before"))
    free = F.col("rest") * F.col("weight") / F.col("left") <= F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("level", F.min(F.when(free, F.struct((F.col("source_size") / F.col("weight")).alias("k"), F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"), "rest", "left"))).over(everywhere))
    cap = F.col("source_size") * F.lit(float(most))
    return ranked.select("source", "source_size", "weight", F.least(cap, F.coalesce(F.col("level.rest") * F.col("weight") / F.col("level.left"), cap)).alias("target"))


def counted(rows: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """Rows with columns __id, __source and __size, with __source_size, __target and __n: how often each is taken."""
    edge = rows.agg(F.min("__id").alias("low"), F.max("__id").alias("high"), F.count("__id").alias("n")).first()
    span = int(edge.high) - int(edge.low) + 1 if edge.n else 1
    width = max(BLOCK, -(-span // BLOCKS)) if span > 4 * (edge.n or 0) else BLOCK
    block = F.floor((F.col("__id") - F.lit(int(edge.low) if edge.n else 0)) / width)
    rows = rows.withColumn("__block", F.coalesce(block, F.lit(-1)))
    pair = ["__source", "__size"]
    blocks = rows.groupBy(*pair, "__block").agg(F.count(F.lit(1)).alias("n"))
    # Both upper levels come from the counts of blocks: the rows are read once for them.
    by_size = blocks.groupBy(*pair).agg(F.sum("n").alias("n"))
    in_size = Window.partitionBy(*pair).orderBy("__block")
    blocks = blocks.select(*pair, "__block", (F.sum("n").over(in_size) - F.col("n")).alias("block_start"))
    in_source = Window.partitionBy("__source").orderBy("__size")
    sizes = by_size.select(*pair, (F.sum("n").over(in_source) - F.col("n")).alias("size_start"))
    sources = targets(by_size.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("n") * F.col("__size")).alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    sources = sources.select("source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("rate"))
    starts = blocks.alias("b").join(sizes.alias("z"), F.col("b.__source").eqNullSafe(F.col("z.__source")) & (F.col("b.__size") == F.col("z.__size")))
    starts = starts.select("b.__source", "b.__size", "__block", (F.col("size_start") + F.col("block_start")).alias("start"))
    starts = starts.alias("b").join(sources.alias("s"), F.col("b.__source").eqNullSafe(F.col("s.source")))
    starts = starts.select(F.col("b.__source").alias("s"), F.col("__size").alias("z"), F.col("__block").alias("b"), "start", "__source_size", "__target", "rate")
    in_block = Window.partitionBy(*pair, "__block").orderBy("__id")
    ranked = rows.withColumn("rank", F.row_number().over(in_block) - 1)
    joined = ranked.join(starts, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__size") == F.col("z")) & (F.col("__block") == F.col("b")))
    k = F.col("start") + F.col("rank")
    u = offset(F.col("__source"), seed)
    crossed = F.floor(u + F.col("rate") * (k + 1)) - F.floor(u + F.col("rate") * k)
    return joined.withColumn("__n", F.least(crossed, F.lit(int(most))).cast("bigint")).drop("s", "z", "b", "start", "rate", "rank", "__block")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken."""
    rows = table(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size")), "sizes")
    n = counted(rows, weights, most, seed)
    return n.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__n").alias("copies"), (F.col("__n") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mixed corpus: docs' rows and columns, each row as often as it is taken.

    Rows meet their counts by id; where ids repeat or lack, by (id, source, size) and a number among the rows that
    agree in these, in the order of a hash of the text, so each row has a count of its own."""
    key = ["__id", "__source", "__size"]
    named = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(F.col(text_col))})
    n = table(counted(table(named.select(*key), "sizes"), weights, most, seed).select(*key, "__n"), "copies")
    if (n.groupBy("__id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0) <= 1:
        taken = n.filter("__n > 0").select(F.col("__id").alias("__of"), "__n")
        taken = F.broadcast(taken) if size_at_most(taken, F.lit(16), BROADCAST_MOST) else taken
        many = named.join(taken, F.col("__id").eqNullSafe(F.col("__of")))
    else:
        own = Window.partitionBy(*key)
        named = named.withColumn("__at", F.row_number().over(own.orderBy(F.xxhash64(F.col(text_col)))))
        n = n.withColumn("__at", F.row_number().over(own.orderBy("__n"))).select(*[F.col(c).alias(f"{c}_of") for c in [*key, "__at"]], "__n")
        same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in [*key, "__at"]]
        many = named.join(n, same[0] & same[1] & same[2] & same[3])
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int")))
    return many.filter("__n > 0").withColumn("__copy", repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
-- fill in rounds: whoever passes its cap is held there, the others share the rest
f AS (
  SELECT source, source_size, weight, false AS held, 0 AS round FROM w
  UNION ALL
  SELECT source, source_size, weight,
         held OR (sum(source_size) OVER () - 3.0 * sum(CASE WHEN held THEN source_size ELSE 0 END) OVER ()) * weight
                 / nullif(sum(CASE WHEN held THEN 0 ELSE weight END) OVER (), 0) > 3.0 * source_size, round + 1
  FROM f WHERE round < 40
),
t AS (
  SELECT source, source_size,
         CASE WHEN held THEN 3.0 * source_size
              ELSE (sum(source_size) OVER () - 3.0 * sum(CASE WHEN held THEN source_size ELSE 0 END) OVER ()) * weight
                   / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target
  FROM f WHERE round = 40
),
k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target::DOUBLE AS target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END::DOUBLE AS rate,
         ('0x' || substr(md5('7:' || coalesce(d.source, chr(1) || 'null')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (least(floor(u + rate * (k + 1)) - floor(u + rate * k), 3) * size)::BIGINT AS taken, source,
       least(floor(u + rate * (k + 1)) - floor(u + rate * k), 3)::BIGINT AS copies
FROM k
"""
