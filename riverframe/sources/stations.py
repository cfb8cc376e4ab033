"""Sources and sinks of station data: series files, catalogues, daily matrices, pasted series, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES_SCHEMA = "nombre string, bna string, tipo string, variable string, unidad string, altitud_m double, lat double, lon double, cuenca string, subcuenca string, fuente string, n_anios int, serie map<string,double>"


def read_series_files(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """One row per station file. The schema is given: inferred, every year would become a column."""
    return spark.read.schema(SERIES_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST" if fail else "PERMISSIVE").json(path)


def tidy(files: DataFrame) -> DataFrame:
    """(bna, tipo, year, value) of finite values."""
    rows = files.select("bna", "tipo", F.explode("serie").alias("y", "value"))
    return rows.select("bna", "tipo", F.expr("try_cast(y AS int)").alias("year"), "value").filter("year is not null and value is not null and not isnan(value)")


def catalogue(files: DataFrame) -> DataFrame:
    """One row per (bna, tipo), with counted years and their span, ordered as catalogues are (tipo, lat, lon, bna)."""
    years = tidy(files).groupBy("bna", "tipo").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.count(F.lit(1)).cast("int").alias("n"))
    rows = files.drop("n_anios", "serie").join(years, ["bna", "tipo"], "left")
    return rows.select("bna", F.col("nombre"), "tipo", F.col("variable").alias("var"), "lat", "lon", "altitud_m", "cuenca", F.concat_ws("-", "y0", "y1").alias("periodo"), F.coalesce("n", F.lit(0)).alias("n_anios")).orderBy("tipo", "lat", "lon", "bna")


def station_filter(kind: str | None = None, least_years: int = 0) -> Column:
    years = F.coalesce(F.col("n_anios"), F.lit(0)) >= least_years
    return years & (F.col("tipo") == kind) if kind else years


def positive_rounded(series: DataFrame, value: str = "value") -> DataFrame:
    """Finite values above 0, rounded to a tenth afterwards (small ones become 0)."""
    return series.filter((F.col(value) > 0) & ~F.isnan(value)).withColumn(value, F.round(value, 1))


def station_metadata(spark: SparkSession, path: str, box: tuple[float, float, float, float] = (-56.0, -17.0, -76.0, -66.0)) -> DataFrame:
    """CSV of stations; rows with bad coordinates or outside (south, north, west, east) go; ids are padded to eight characters."""
    south, north, west, east = box
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.withColumns({"lat": F.expr("try_cast(latitud AS double)"), "lon": F.expr("try_cast(longitud AS double)"), "bna": F.lpad(F.trim("codigo_estacion"), 8, "0")})
    return rows.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def daily_matrix(spark: SparkSession, path: str, stations: list[str] | None = None) -> DataFrame:
    """Wide CSV (date, one column per station) -> (date, bna, value). Rows without a date and missing values go; only asked columns are parsed."""
    wide = spark.read.option("header", "true").csv(path)
    date, names = wide.columns[0], [c for c in wide.columns[1:] if stations is None or c in stations]
    rows = wide.filter(F.col(date).rlike(r"^\d{4}-")).select(F.to_date(date).alias("date"), *names)
    long_ = rows.unpivot(["date"], names, "bna", "raw") if names else rows.select("date", F.lit(None).cast("string").alias("bna"), F.lit(None).cast("string").alias("raw")).limit(0)
    return long_.select("date", F.lpad("bna", 8, "0").alias("bna"), F.expr("try_cast(raw AS double)").alias("value")).filter("value is not null and value <> -9999")


def parse_pasted(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Pasted series: lines of `year value` or of values only (then numbered from 1); headers are skipped."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("i", "line"))
    parts = F.filter(F.split(F.trim("line"), r"[\s,;]+"), lambda x: x != "")
    rows = lines.withColumn("p", parts).filter(F.size("p") > 0)
    number = lambda i: F.expr(f"try_cast(replace(get(p, {i}), ',', '.') AS double)")
    rows = rows.withColumns({"a": number(0), "b": number(1)}).filter((F.col("a").isNotNull()) & ((F.size("p") == 1) | F.col("b").isNotNull()))
    w = Window.partitionBy(key).orderBy("i")
    return rows.select(key, F.when(F.size("p") > 1, F.col("a").cast("int")).otherwise(F.row_number().over(w)).alias("year"), F.coalesce("b", "a").alias("value"))


def synthetic_forcing(spark: SparkSession, days: int, basins: int = 1) -> DataFrame:
    """Daily forcing: a cosine year of temperature, rain every third day, more in winter."""
    rows = spark.range(basins).withColumnRenamed("id", "basin_id").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    season = F.cos(2 * 3.141592653589793 * (F.col("day") - 15) / 365)
    return rows.select("basin_id", "day", F.when(F.col("day") % 3 == 0, 12 * (1.2 - season)).otherwise(0.0).alias("p"), (8 + 10 * season).alias("temp"))


def write_catalogue(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("tipo").parquet(path)


def write_csv(rows: DataFrame, path: str, quote: bool = False) -> None:
    rows.write.mode("overwrite").option("header", "true").option("quoteAll", str(quote).lower()).csv(path)


def near_series(points: DataFrame, stations: DataFrame, series: DataFrame, n: int = 5, years: int = 30) -> DataFrame:
    """The last `years` years of the n stations nearest to each point, ready for CSV."""
    from ..operators.stations import nearest

    found = nearest(points, stations, n)
    rows = found.join(series.withColumnRenamed("bna", "station_id"), "station_id")
    last = F.max("year").over(Window.partitionBy("point_id", "station_id"))
    return rows.withColumn("__last", last).filter(F.col("year") > F.col("__last") - years).drop("__last")


def latest(registry: DataFrame, key: str = "module", at: str = "ts") -> DataFrame:
    """Last result of each module in an append-only registry."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    return registry.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
