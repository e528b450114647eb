"""Incremental quarters: the streaming form of ``resample_last``."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quarter_end


def quarterly_last(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """(series, date, value) of a stream of (series, ts, value): the last value of each quarter, updated as rows come.

    The watermark lets state of old quarters go; rows later than that are dropped by Structured Streaming.
    """
    rows = stream.filter("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    quarter = F.window("ts", "1 day")  # state expires by day; quarters are formed from days
    days = rows.groupBy("series", quarter.alias("w")).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    return days.select("series", F.col("w.start").cast("date").alias("day"), quarter_end(F.col("w.start")).alias("date"), "value")


def latest(days: DataFrame) -> DataFrame:
    """Quarters from the days that ``quarterly_last`` has given so far."""
    return days.groupBy("series", "date").agg(F.max_by("value", "day").alias("value"))
