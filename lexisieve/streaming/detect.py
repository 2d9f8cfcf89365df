"""Detection is a stateless Column function, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.columns import Sieve


def detect_stream(stream: DataFrame, sieve: Sieve, text: str = "text") -> DataFrame:
    """stream with a detection column."""
    return sieve.with_detection(stream, text)


def term_rates(stream: DataFrame, sieve: Sieve, time: str, text: str = "text", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Matches by event-time window and term; rows later than the watermark are left out by Spark."""
    found = stream.withWatermark(time, late).select(time, sieve.matches(text).alias("_m")).select(time, F.inline("_m"))
    return found.groupBy(F.window(time, window).alias("window"), "term").agg(F.count("*").alias("n"))
