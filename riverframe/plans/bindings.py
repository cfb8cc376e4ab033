"""How the star-schema tables stand in for hydrological ones.

A station is a nation; its observations are the prices of its customers' orders; a series is the largest
per month. Suppliers are points, parts are cells of a raster and nodes of a tree, events are a rain gauge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("st"))
    period = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return orders.join(customers, "o_custkey").select("st", period.alias("period"), F.col("o_totalprice").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("st", "period").agg(F.max("value").alias("value"))


SERIES = """ser AS (
  SELECT c.c_nationkey AS st, (year(o.o_orderdate) * 100 + month(o.o_orderdate))::INTEGER AS period, max(o.o_totalprice) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"""

MOMENTS = """mo AS (
  SELECT st, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS skew, max(value) AS mx, min(value) AS mn,
    avg(ln(greatest(value, 1e-6))) AS mean_ln, stddev_samp(ln(greatest(value, 1e-6))) AS std_ln,
    avg(log10(greatest(value, 1e-6))) AS mean_log, stddev_samp(log10(greatest(value, 1e-6))) AS std_log, skewness(log10(greatest(value, 1e-6))) AS skew_log
  FROM ser GROUP BY st)"""


def station_lat(key: Column) -> Column:
    return -18.0 - (key * 7 % 25) * 1.5


def station_lon(key: Column) -> Column:
    return -69.0 - (key * 3 % 10) * 0.4


def part_raster(spark: SparkSession, sf_dir: str, width: int = 50) -> DataFrame:
    """(row, col, z), one cell per part."""
    p = read(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / width).cast("int").alias("row"), (F.col("p_partkey") % width).cast("int").alias("col"), F.col("p_retailprice").alias("z"))


RASTER = "ras AS (SELECT (p_partkey // 50)::INTEGER AS row, (p_partkey % 50)::INTEGER AS col, p_retailprice AS z FROM part)"


def valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, z), one cell per part: a valley that falls along its rows, with rough ground."""
    k = F.col("p_partkey")
    row, col = F.floor(k / 50).cast("int"), (k % 50).cast("int")
    return read(spark, sf_dir, "part").select(row.alias("row"), col.alias("col"), (2.0 * row + 1.5 * F.abs(col - 25) + (k * 7919 % 101) / 32.0).alias("z"))


VALLEY = "ras AS (SELECT (p_partkey // 50)::INTEGER AS row, (p_partkey % 50)::INTEGER AS col, 2.0::DOUBLE * (p_partkey // 50) + 1.5::DOUBLE * abs(p_partkey % 50 - 25) + (p_partkey * 7919 % 101)::DOUBLE / 32 AS z FROM part)"


def supplier_cells(spark: SparkSession, sf_dir: str, name: str = "point_id") -> DataFrame:
    """(name, row, col): a cell of the valley per supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias(name), F.floor(k * 19 / 50).cast("int").alias("row"), (k * 19 % 50).cast("int").alias("col"))


SUPPLIER_CELLS = "pts AS (SELECT s_suppkey AS point_id, (s_suppkey * 19 // 50)::INTEGER AS row, (s_suppkey * 19 % 50)::INTEGER AS col FROM supplier)"


def hourly_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, step, p): events per hour of each day."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.dayofmonth("ts").alias("day"), F.hour("ts").alias("step")).agg((F.sum("value") / 100).alias("p"))


RAIN = "rain AS (SELECT day(ts)::INTEGER AS day, hour(ts)::INTEGER AS step, sum(value) / 100 AS p FROM events GROUP BY 1, 2)"


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, step, q): a daily flow per type of event."""
    e = read(spark, sf_dir, "events")
    days = F.datediff("ts", F.lit("2024-01-01"))
    return e.groupBy(F.col("event_type").alias("series"), days.cast("bigint").alias("step")).agg(F.sum("value").alias("q"))


FLOW = "flow AS (SELECT event_type AS series, datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step, sum(value) AS q FROM events GROUP BY 1, 2)"


def flow_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths, velocities, slopes, grain sizes and widths from line items."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("h"), (0.2 + F.col("l_discount") * 40).alias("v"), (0.0005 + F.col("l_tax") / 10).alias("j"),
        (0.5 + (F.col("l_partkey") % 40)).cast("double").alias("d50"), (5.0 + F.col("l_suppkey") % 30).alias("b"), (0.5 + F.col("l_linenumber") * 0.25).alias("a"), (F.col("l_extendedprice") / 100).alias("q"),
    )


CASES = """cas AS (
  SELECT l_orderkey, l_linenumber, l_quantity / 10 AS h, 0.2 + l_discount * 40 AS v, 0.0005 + l_tax / 10 AS j, (0.5 + (l_partkey % 40))::DOUBLE AS d50,
    (5.0 + l_suppkey % 30)::DOUBLE AS b, (0.5 + l_linenumber * 0.25)::DOUBLE AS a, l_extendedprice / 100 AS q
  FROM lineitem)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per order and line number: the largest of each measure."""
    c = flow_cases(spark, sf_dir)
    return c.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(x).alias(x) for x in ("h", "v", "j", "d50", "b", "a", "q")])


SECTIONS = CASES + ", sec AS (SELECT l_orderkey, l_linenumber, max(h) AS h, max(v) AS v, max(j) AS j, max(d50) AS d50, max(b) AS b, max(a) AS a, max(q) AS q FROM cas GROUP BY 1, 2)"
