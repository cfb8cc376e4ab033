"""Extensions over unbounded input, which the batch operators have twins of: period maxima and latest results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_maxima(observations: DataFrame, keys: list[str], time: str = "ts", value: str = "value", period: str = "30 days", late: str = "7 days") -> DataFrame:
    """Largest value per key and period of a stream; what comes later than `late` is dropped, and state with it."""
    rows = observations.filter(F.col(value).isNotNull()).withWatermark(time, late)
    out = rows.groupBy(*keys, F.window(time, period).alias("w")).agg(F.max(value).alias("value"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")
