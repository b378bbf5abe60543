"""Fixed-window rate limits, alike for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limited(events: DataFrame, subject: str, ts: str, limit: int, every: str = "1 minute") -> DataFrame:
    """subject, window_start, n and rejected (calls beyond the limit) of each fixed window."""
    rows = events.groupBy(F.col(subject), F.window(ts, every).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(subject, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("rejected"))


def decided(events: DataFrame, subject: str, ts: str, limit: int, seconds: int = 60, ident: str = "event_id") -> DataFrame:
    """events with allowed, remaining (calls left in the window after this one) and retry_after (whole seconds to the next window, 1 at least) of each call, in order of time
    and id within its fixed window."""
    window = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    nth = F.row_number().over(Window.partitionBy(subject, window).orderBy(ts, ident))
    left = ((window + 1) * seconds * 1_000_000 - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000
    rows = events.withColumn("__nth", nth)
    return rows.select("*", (F.col("__nth") <= limit).alias("allowed"), F.greatest(limit - F.col("__nth"), F.lit(0)).cast("long").alias("remaining"), F.greatest(F.ceil(left), F.lit(1)).cast("long").alias("retry_after")).drop("__nth")
