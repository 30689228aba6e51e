"""Structured Streaming forms of metering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; state of a window goes once the watermark has passed it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def debounced(events: DataFrame, keys: list[str], quiet: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A row per burst of events, out once its keys have been quiet."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy(*keys, F.session_window("ts", quiet)).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    return s.select(*keys, F.col("session_window.start").alias("first_at"), "last_at", "n")


def quotas(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The day's floored counter of each user after each batch: +1, or -1 for a refund, never below zero.

    events: user_id, ts, event_id, delta. State is one number per user and day,
    dropped when the watermark has passed the day.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for d in rows["delta"]:
            n = max(0, n + int(d))
        state.update((n,))
        state.setTimeoutTimestamp(int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000) + 1)
        yield pd.DataFrame({"user_id": [key[0]], "day": [key[1]], "counter": [n]})

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("user_id", "day").applyInPandasWithState(run, "user_id long, day string, counter long", "n long", "update", GroupStateTimeout.EventTimeTimeout)
