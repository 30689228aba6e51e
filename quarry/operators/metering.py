"""Usage: daily counts, quotas with refunds, per-address limits, debounced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def daily(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def floored_sum(events: DataFrame, keys: list[str], delta: Column, *order: str) -> DataFrame:
    """A counter of +1 and -1 that never goes below zero at any event, as columns ``counter``.

    With prefix sums s, the floored counter is s minus the least of all prefix
    sums so far and 0, so two windows replay the floor exactly.
    """
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    e = events.withColumn("prefix", F.sum(delta).over(w))
    return e.withColumn("counter", F.col("prefix") - F.least(F.lit(0), F.min("prefix").over(w))).drop("prefix")


def over_limit(events: DataFrame, keys: list[str], most: int, *order: str) -> DataFrame:
    """Whether each request of a day is beyond the limit of its keys."""
    n = F.row_number().over(W.partitionBy(*keys, F.to_date("ts")).orderBy("ts", *order))
    return events.withColumn("blocked", n > most)


def debounce(events: DataFrame, keys: list[str], quiet: float, *order: str) -> DataFrame:
    """Only events followed by that many quiet seconds on their keys fire: the last of each burst."""
    nxt = F.lead("ts").over(W.partitionBy(*keys).orderBy("ts", *order))
    e = events.withColumn("wait", micros(nxt) - micros(F.col("ts")))
    return e.filter(F.col("wait").isNull() | (F.col("wait") >= int(quiet * 1_000_000))).drop("wait")


def bursts(events: DataFrame, keys: list[str], quiet: float, *order: str) -> DataFrame:
    """Bursts with their first and last event times and sizes."""
    w = W.partitionBy(*keys).orderBy("ts", *order)
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    b = events.withColumn("burst", F.sum(F.coalesce((gap >= int(quiet * 1_000_000)).cast("int"), F.lit(1))).over(w))
    return b.groupBy(*keys, "burst").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))


def budget(events: DataFrame, keys: list[str], initial: int, *order: str) -> DataFrame:
    """What is left of a budget before each charge (value > 0) or refund, refunds capped at the initial budget.

    The cap is a floor seen from above: spent = prefix - min(0, least prefix so
    far). A charge is admitted while something is left.
    """
    spent = floored_sum(events, keys, F.col("delta"), *order)
    return spent.withColumn("left", F.greatest(F.lit(0), F.lit(initial) - F.col("counter"))).withColumn("admitted", F.col("counter") - F.greatest(F.col("delta"), F.lit(0)) < initial).drop("counter")


def clamp(requests: DataFrame, models: list[str], default: str, most_tokens: int) -> DataFrame:
    """Unknown models become the default; token counts stay within the cap."""
    return requests.withColumn("model", F.when(F.col("model").isin(models), F.col("model")).otherwise(default)).withColumn("max_tokens", F.least(F.coalesce("max_tokens", F.lit(most_tokens)), F.lit(most_tokens)))
