"""What a provider's limits allow, read from the log of calls: so many in any 60 seconds, so many in a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate_breaches(calls: DataFrame, client: str, at: str, most: int, seconds: int = 60) -> DataFrame:
    """calls that came when their client had made more than `most` in the `seconds` up to them, themselves and calls of
    the same moment included; a call exactly `seconds` old counts no more. in_window: how many there were.

    Every call counts, allowed or not. A client's calls are read in order and only the window's are held."""
    if most <= 0 or seconds <= 0:
        raise ValueError("limits must be positive")
    frame = Window.partitionBy(client).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(1 - seconds * 1_000_000, 0)
    return calls.where(F.col(at).isNotNull()).withColumn("in_window", F.count("*").over(frame)).where(F.col("in_window") > most)


def daily_use(calls: DataFrame, client: str, at: str, limit: int, reserve: int = 0) -> DataFrame:
    """Per client and day of the session's time zone: calls made and calls left of the limit less its reserve, never below zero."""
    used = calls.where(F.col(at).isNotNull()).groupBy(client, F.col(at).cast("date").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(0), F.lit(limit - reserve) - F.col("used")))
