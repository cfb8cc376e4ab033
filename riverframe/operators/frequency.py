"""Flood frequency: moments, quantiles, goodness of fit, best distribution and checks on series.

A series table has one row per observation: key columns and `value`. All series are analysed in one
plan; nothing is collected, and a series is only ever a group of an aggregate or a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

RETURN_PERIODS = (2, 5, 10, 25, 50, 100, 200)
PARAMETERS = {"normal": 2, "lognormal": 2, "pearson3": 3, "logpearson3": 3, "gumbel": 2, "gamma": 2}
MOMENTS = ("n", "mean", "std", "skew", "mean_ln", "std_ln", "mean_log", "std_log", "skew_log")


def annual_maxima(observations: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    return observations.filter(F.col(value).isNotNull()).groupBy(*keys, F.year(date).alias("year")).agg(F.max(value).alias("value"))


def moments(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Moments of the values and of their logarithms (values are floored at 1e-6 there); n_zero tells how many were floored."""
    v = F.col(value).cast("double")
    ln, log = F.log(F.greatest(v, F.lit(1e-6))), F.log10(F.greatest(v, F.lit(1e-6)))
    return series.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), stats.adjusted_skew(v).alias("skew"),
        F.avg(ln).alias("mean_ln"), F.stddev_samp(ln).alias("std_ln"), F.avg(log).alias("mean_log"), F.stddev_samp(log).alias("std_log"), stats.adjusted_skew(log).alias("skew_log"),
        F.sum((v <= 1e-6).cast("int")).alias("n_zero"), F.max(v).alias("max"), F.min(v).alias("min"),
    )


def quantile_columns(t: Column, dists: Sequence[str] = stats.DISTRIBUTIONS) -> Column:
    """Array of (dist, ord, q) for moments that stand as columns."""
    m = {c: F.col(c) for c in MOMENTS}
    return F.array(*[F.struct(F.lit(d).alias("dist"), F.lit(stats.DISTRIBUTIONS.index(d)).alias("ord"), stats.quantile(d, t, m).alias("q")) for d in dists])


def quantiles(fits: DataFrame, keys: Sequence[str], periods: Sequence[float] = RETURN_PERIODS, dists: Sequence[str] = stats.DISTRIBUTIONS) -> DataFrame:
    """Rows (keys, t, dist, q) from moments."""
    rows = fits.withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in periods])))
    return rows.select(*keys, "t", F.explode(quantile_columns(F.col("t"), dists)).alias("f")).select(*keys, "t", "f.dist", "f.q")


def weibull(series: DataFrame, keys: Sequence[str], tie: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rank from the largest, exceedance probability and empirical return period."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(value).desc(), *tie))
    n = F.count(F.lit(1)).over(w)
    return series.withColumns({"rank": rank, "n": n}).withColumns({"p": F.col("rank") / (F.col("n") + 1), "t_emp": (F.col("n") + 1) / F.col("rank")})


def r_squared(series: DataFrame, fits: DataFrame, keys: Sequence[str], dists: Sequence[str] = stats.DISTRIBUTIONS, tie: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Fit of each distribution to the plotting positions: (keys, dist, r2)."""
    w = Window.partitionBy(*keys).orderBy(F.col(value), *tie)
    placed = series.select(*keys, F.col(value).alias("value"), (F.row_number().over(w)).alias("i"))
    rows = placed.join(fits, list(keys)).select(*keys, "value", "mean", F.explode(quantile_columns(1 / (1 - F.col("i") / (F.col("n") + 1)), dists)).alias("f"))
    total = F.sum(F.pow(F.col("value") - F.col("mean"), F.lit(2.0)))
    return rows.groupBy(*keys, F.col("f.dist").alias("dist")).agg(F.when(total > 0, 1 - F.sum(F.pow(F.col("value") - F.col("f.q"), F.lit(2.0))) / F.when(total > 0, total)).otherwise(0.0).alias("r2"))


def grubbs_beck(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Series with limits and flags for high and low outliers; only positive values count, and from four on."""
    v = F.col(value).cast("double")
    log = F.when(v > 0, F.log10(F.when(v > 0, v)))
    limits = series.groupBy(*keys).agg(F.count(log).alias("n_pos"), F.avg(log).alias("m"), F.stddev_samp(log).alias("s")).withColumn("kn", F.when(F.col("n_pos") >= 4, stats.outlier_kn(F.col("n_pos"))))
    limits = limits.select(*keys, "n_pos", "kn", F.pow(F.lit(10.0), F.col("m") + F.col("kn") * F.col("s")).alias("high"), F.pow(F.lit(10.0), F.col("m") - F.col("kn") * F.col("s")).alias("low"))
    return series.join(limits, list(keys)).withColumns({"is_high": F.coalesce(v > F.col("high"), F.lit(False)), "is_low": F.coalesce((v > 0) & (v < F.col("low")), F.lit(False))})


def chi_square(series: DataFrame, fits: DataFrame, keys: Sequence[str], dists: Sequence[str] = stats.DISTRIBUTIONS, value: str = "value") -> DataFrame:
    """Pearson's statistic over Sturges' bins: (keys, dist, x2, df, critical, accepted).

    The model's CDF is read off a table of its quantiles at return periods 1.0001 * 1.15^k, sorted by
    quantile, as arrays: one row per series and distribution, no row per knot."""
    n = F.col("n")
    bins = F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.lit(1.5) + F.lit(3.322) * F.log10(n.cast("double"))))).cast("int")
    sized = fits.withColumns({"__k": bins}).withColumn("__w", (F.col("max") - F.col("min")) / F.col("__k"))
    bin_of = F.least(F.col("__k") - 1, F.when(F.col("__w") > 0, F.floor((F.col(value) - F.col("min")) / F.when(F.col("__w") > 0, F.col("__w")))).otherwise(F.col("__k") - 1)).cast("int")
    edge = lambda i: F.col("min") + F.col("__w") * i
    placed = series.select(*keys, value).join(sized.select(*keys, "__k", "__w", "min", "max"), list(keys)).withColumn("guess", bin_of)
    # Rounding in the division must not move a value that lies on an edge.
    i = F.col("guess")
    exact = F.when(F.col(value) < edge(i), i - 1).when((i < F.col("__k") - 1) & (F.col(value) >= edge(i + 1)), i + 1).otherwise(i)
    counts = placed.groupBy(*keys, exact.alias("bin")).agg(F.count(F.lit(1)).alias("obs")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "obs"))).alias("obs"))
    periods = [1.0001]
    while periods[-1] * 1.15 <= 100_000:
        periods.append(periods[-1] * 1.15)
    knots = sized.withColumn("t", F.explode(F.array(*map(F.lit, periods)))).select(*keys, "__k", "__w", "min", "max", "n", "t", F.explode(quantile_columns(F.col("t"), dists)).alias("f"))
    tables = knots.groupBy(*keys, "__k", "__w", "min", "max", "n", F.col("f.dist").alias("dist")).agg(F.sort_array(F.collect_list(F.struct(F.col("f.q").alias("x"), (1 - 1 / F.col("t")).alias("p")))).alias("cdf"))

    def cdf(x: Column) -> Column:
        c = F.col("cdf")
        j = F.size(F.filter(c, lambda e: e["x"] < x))
        a, b = F.get(c, j - 1), F.get(c, j)
        return F.when(j == 0, F.greatest(F.lit(0.0), F.get(c, F.lit(0))["p"] * 0.5)).when(j >= F.size(c), F.get(c, F.size(c) - 1)["p"]).otherwise(a["p"] + (x - a["x"]) / F.when(b["x"] == a["x"], F.lit(1e-9)).otherwise(b["x"] - a["x"]) * (b["p"] - a["p"]))

    rows = tables.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).join(counts, list(keys))
    upper = F.when(F.col("bin") == F.col("__k") - 1, F.col("max") + 1e-9).otherwise(edge(F.col("bin") + 1))
    rows = rows.withColumn("esp", F.col("n") * (cdf(upper) - cdf(edge(F.col("bin"))))).withColumn("o", F.coalesce(F.element_at("obs", F.col("bin")), F.lit(0)))
    x2 = F.sum(F.when(F.col("esp") > 0, F.pow(F.col("o") - F.col("esp"), F.lit(2.0)) / F.when(F.col("esp") > 0, F.col("esp"))).otherwise(0.0))
    used = F.when(F.lit(False), F.lit(0))
    for d, count in PARAMETERS.items():
        used = used.when(F.col("dist") == d, count)
    out = rows.groupBy(*keys, "dist", "__k").agg(x2.alias("x2")).withColumn("df", F.greatest(F.lit(1), F.col("__k") - 1 - used).cast("int"))
    return out.withColumn("critical", stats.chi2_critical(F.col("df"))).withColumn("accepted", F.col("x2") <= F.col("critical")).withColumnRenamed("__k", "bins")


def best(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The accepted distribution of least statistic, else the least of all; ties in the order of definition."""
    place = F.array_position(F.array(*map(F.lit, stats.DISTRIBUTIONS)), F.col("dist"))
    w = Window.partitionBy(*keys).orderBy(F.col("accepted").desc(), F.col("x2"), place)
    return tests.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def quality_alerts(fits: DataFrame, q100: Column) -> DataFrame:
    """Short series, and design values far above what was observed."""
    return fits.withColumns({"short": F.col("n") < 20, "far_above_max": q100 > 2.2 * F.col("max"), "far_above_mean": q100 > 20 * F.col("mean")})


def historical_moments(series: DataFrame, keys: Sequence[str], threshold: Column, history: Column, value: str = "value") -> DataFrame:
    """Weighted moments of logarithms: values above the threshold stand for the whole history, the rest for what is left of it."""
    v = F.log10(F.greatest(F.col(value).cast("double"), F.lit(1e-6)))
    high = F.col(value) > threshold
    base = series.groupBy(*keys).agg(F.max(history).cast("double").alias("h"), F.sum(high.cast("int")).alias("z"), F.sum((~high).cast("int")).alias("l"))
    rows = series.join(base, list(keys)).withColumn("w", F.when(high, F.lit(1.0)).otherwise((F.col("h") - F.col("z")) / F.col("l"))).withColumn("v", v)
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("n_eff"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean_log"))
    joined = rows.join(sums, list(keys))
    return joined.groupBy(*keys, "n_eff", "mean_log").agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("v") - F.col("mean_log"), F.lit(2.0))) / (F.col("n_eff") - 1)).alias("std_log"))


def covering_period(quantiles_of: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least return period whose flow reaches the largest observation; null if none does."""
    top = observed.groupBy(*keys).agg(F.max("value").alias("top"))
    return quantiles_of.join(top, list(keys)).groupBy(*keys, "top").agg(F.min(F.when(F.col("q") >= F.col("top"), F.col("t"))).alias("covering_t"))


def return_period_of(q: Column, dist: str, m: dict[str, Column], steps: int = 80) -> Column:
    """Return period of a flow by bisection on ln t between 1.0001 and 1e5 (closed-form distributions)."""
    from ..functions.river import bisect

    return F.exp(bisect(F.log(F.lit(1.0001)), F.log(F.lit(1e5)), lambda x: stats.quantile(dist, F.exp(x), m) < q, steps))
