"""Running sums and exact order statistics without a sort in one task.

Rows are dealt to ranges of (keys, value), each range is summed, and what stands before a range is known from the
sums of the ranges. Only within a range are rows put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop


def ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows written in ranges of (keys, order), with the range's number in column __part; equal (keys, order) share a range."""
    return cut(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))


def before(placed: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(keys, __part, <sum>_before and <sum>_in): of each key, the sums of the ranges before and of the range itself. A key has few ranges."""
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"{c}_in") for c in sums])
    return totals.withColumns({f"{c}_before": F.coalesce(F.sum(f"{c}_in").over(w), F.lit(0).cast(dict(totals.dtypes)[f"{c}_in"])) for c in sums})


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """rows with run_<sum>: the sum over all rows of the key up to and with this one in the order given, which should be total."""
    placed = ranges(rows, keys, order)
    w = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"run_{c}": F.sum(c).over(w) for c in sums}).join(before(placed, keys, sums), [*keys, "__part"])
    return own.select(*rows.columns, *[(F.col(f"run_{c}") + F.col(f"{c}_before")).alias(f"run_{c}") for c in sums])


def following(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """rows with <column>_2, the values of the key's next row in order; the last row of a key goes.

    Keys are series of bounded length: lines, sections, curves."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumns({f"{c}_2": F.lead(c).over(w) for c in columns} | {"__more": F.lead(F.lit(1)).over(w)})
    return out.filter("__more = 1").drop("__more")


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, share, n, value): the value of rank round(share (n - 1)), half up, from 0, of each key's n values that are numbers.

    Equal values are counted first, so a frequent one is one row; then ranges of values are counted, and only the
    ranges that hold an asked rank are read again and put in order. Nulls and NaN are left out; a key without values gives no row."""
    keys = list(keys)
    counts = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = ranges(counts, keys, ["__v"])
    parts = before(placed, keys, ["__c"])
    total = parts.groupBy(*keys).agg(F.sum("__c_in").alias("n")) if keys else parts.agg(F.sum("__c_in").alias("n")).filter("n > 0")
    asked = total.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("__rank", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("share") * (F.col("n") - 1) + 0.5))))
    inside = (F.col("__rank") >= F.col("__c_before")) & (F.col("__rank") < F.col("__c_before") + F.col("__c_in"))
    wanted = (asked.join(parts, keys) if keys else asked.join(parts.withColumn("__all", F.lit(1)), F.col("__all") == 1)).filter(inside).select(*keys, "__part", "share", "n", (F.col("__rank") - F.col("__c_before")).alias("__at"))
    wanted = cut(wanted)
    w = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(wanted.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi").withColumn("__upto", F.sum("__c").over(w))
    hit = near.join(wanted, [*keys, "__part"]).filter((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__c")))
    out = cut(hit.select(*keys, "share", "n", F.col("__v").alias(value)))
    drop(placed, wanted)
    return out


def robust_box(points: DataFrame, keys: Sequence[str], share: float = 0.004, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, min_x, max_x, min_y, max_y): the box between the exact order statistics at `share` and 1 - share of each axis.

    Points count where both coordinates are finite numbers."""
    keys = list(keys)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    axes = F.array(F.struct(F.lit("x").alias("axis"), F.col(x).cast("double").alias("v")), F.struct(F.lit("y").alias("axis"), F.col(y).cast("double").alias("v")))
    rows = points.filter(finite(x) & finite(y)).select(*keys, F.explode(axes).alias("a")).select(*keys, "a.axis", "a.v")
    found = order_statistics(rows, [*keys, "axis"], "v", [share, 1 - share])
    of = lambda axis, s: F.max(F.when((F.col("axis") == axis) & (F.col("share") == s), F.col("v")))
    return found.groupBy(*keys).agg(of("x", share).alias("min_x"), of("x", 1 - share).alias("max_x"), of("y", share).alias("min_y"), of("y", 1 - share).alias("max_y"))


def below_lines(bands: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(columns of lines, below, above): of each key's bands (keys, lo, hi, area), cut linearly, the area below each line (keys, line, ...) and above it.

    The area below a line is piecewise linear in it: a band adds its area per height from lo on and takes it away
    from hi on. Edges and lines stand in one order and running sums give every line its area: rows are twice the
    bands and the lines, however many lines a key has. Equal edges are summed first. Bands without height are left out."""
    keys = list(keys)
    rate = F.col("area") / (F.col("hi") - F.col("lo"))
    ends = F.array(F.struct(F.col("lo").alias("at"), rate.alias("r")), F.struct(F.col("hi").alias("at"), (-rate).alias("r")))
    edges = bands.filter("hi > lo").select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e.at").agg(F.sum("e.r").alias("r")).withColumn("m", F.col("r") * F.col("at"))
    asked = lines.select(*keys, F.col("line").cast("double").alias("at")).distinct()
    both = edges.select(*keys, "at", F.lit(0).alias("kind"), "r", "m").unionByName(asked.select(*keys, "at", F.lit(1).alias("kind"), F.lit(0.0).alias("r"), F.lit(0.0).alias("m")))
    known = running_sums(both, keys, ["at", "kind"], ["r", "m"]).filter("kind = 1").select(*keys, F.col("at").alias("__at"), (F.col("at") * F.col("run_r") - F.col("run_m")).alias("below"))
    whole = bands.filter("hi > lo").groupBy(*keys).agg(F.sum("area").alias("__whole"))
    met = lines.withColumn("__at", F.col("line").cast("double")).join(known, [*keys, "__at"]).join(whole, keys)
    return met.select(*lines.columns, "below", (F.col("__whole") - F.col("below")).alias("above"))
