"""Admission of requests by account: a trial window, daily limits by plan, refunds, and budgets of sessions.

A request row has ``account``, ``ts``, ``id`` (order of equal times), ``kind`` and ``failed``. Kinds of chat rows are sign_in,
upgrade and ask; those of session rows are start and call. A request that was let through but failed gives its place back
at once, so what counts against a limit are the earlier requests that succeeded. Days are those of the session's time zone.

Rows without an account or a time belong to nobody: their asks are ``unauthenticated``. ``failed`` without a value is no
failure; other kinds count for nothing but an account's first sight. Equal rows are separate requests.

``quarry.streaming.admission`` keeps the same counters as state of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
TRIAL_DAILY = 6
PRO_DAILY = 25
TRIAL_HOURS = 24
SESSION_BUDGET = 50
SESSION_MINUTES = 30


def earlier(rows: DataFrame, keys: list[str], counts: dict[str, Column], *order: str) -> DataFrame:
    """Adds, for each name, how many earlier rows of the keys meet a condition.

    Counted in two levels: hours first (with map-side combine), then the rows within an hour, so a busy key is spread over
    as many windows as it has hours.
    """
    hour = rows.withColumn("_hour", F.date_trunc("hour", "ts"))
    flags = {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()}
    before = W.partitionBy(*keys).orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    hours = hour.groupBy(*keys, "_hour").agg(*(F.sum(c).alias(n) for n, c in flags.items()))
    hours = hours.select(*keys, "_hour", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_" + n) for n in flags))
    within = W.partitionBy(*keys, "_hour").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = hour.join(hours, [*keys, "_hour"])
    return out.select(*rows.columns, *((F.col("_" + n) + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in flags.items()))


def chat_admission(requests: DataFrame, trial: int = TRIAL_DAILY, pro: int = PRO_DAILY, hours: int = TRIAL_HOURS) -> DataFrame:
    """Every ask with plan, used (places taken that day before it), remaining (after it) and outcome.

    Outcomes: admitted, refunded (let through, but failed), trial_ended (a trial lasts some hours from the account's first
    row), limit, unauthenticated. An upgrade holds for all later rows; what the trial used that day still counts.
    """
    if pro < trial:
        raise ValueError("an upgrade must not lower the limit")
    r = requests.select("account", F.col("ts").cast("timestamp").alias("ts"), "id", "kind", F.coalesce("failed", F.lit(False)).alias("failed"))
    known = F.col("account").isNotNull() & F.col("ts").isNotNull()
    up = F.when(F.col("kind") == "upgrade", F.struct("ts", "id"))
    accounts = r.filter(known).groupBy("account").agg(F.min("ts").alias("_started"), F.min(up).alias("_up"))
    asks = r.filter(known & (F.col("kind") == "ask")).join(accounts, "account")
    is_pro = F.coalesce(F.struct("ts", "id") > F.col("_up"), F.lit(False))
    asks = asks.withColumn("_pro", is_pro).withColumn("_day", F.to_date("ts"))
    asks = asks.withColumn("_open", F.col("_pro") | (F.col("ts") <= F.col("_started") + F.make_interval(hours=F.lit(hours))))
    done = F.col("_open") & ~F.col("failed")
    n = earlier(asks, ["account", "_day"], {"_trials": done & ~F.col("_pro"), "_pros": done & F.col("_pro")}, "ts", "id")
    limit = F.when(F.col("_pro"), pro).otherwise(trial)
    used = F.least(limit, F.least(F.lit(trial), F.col("_trials")) + F.col("_pros"))
    n = n.withColumn("used", used).withColumn("plan", F.when(F.col("_pro"), "pro").otherwise("trial"))
    n = n.withColumn("outcome", F.when(~F.col("_open"), "trial_ended").when(F.col("used") >= limit, "limit").when(F.col("failed"), "refunded").otherwise("admitted"))
    left = limit - F.col("used") - (F.col("outcome") == "admitted").cast("long")
    cols = ["account", "ts", "id", "plan", "used", "remaining", "outcome"]
    nobody = r.filter(~known & (F.col("kind") == "ask")).select("account", "ts", "id", F.lit(None).cast("string").alias("plan"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("remaining"), F.lit("unauthenticated").alias("outcome"))
    return n.withColumn("remaining", F.when(F.col("_open"), left).otherwise(0).cast("long")).select(*cols).unionByName(nobody)


def session_calls(rows: DataFrame, budget: int = SESSION_BUDGET, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Every call with what its session's budget has left after it, and its outcome.

    Rows have session, ts, id, kind and failed. A session's id is its own: it lives for some minutes from its first start,
    and starting it again does nothing (a stream, which has forgotten an expired id, would begin it anew). Outcomes: admitted,
    refunded, exhausted, and no_session for calls before a start, of an unknown session, or at the expiry or later
    (left is null).
    """
    r = rows.select("session", F.col("ts").cast("timestamp").alias("ts"), "id", "kind", F.coalesce("failed", F.lit(False)).alias("failed"))
    starts = r.filter((F.col("kind") == "start") & F.col("ts").isNotNull()).groupBy("session").agg(F.min(F.struct("ts", "id")).alias("_start"))
    calls = r.filter(F.col("kind") == "call").join(starts, "session", "left")
    live = (F.struct("ts", "id") > F.col("_start")) & (F.col("ts") < F.col("_start.ts") + F.make_interval(mins=F.lit(minutes)))
    calls = calls.withColumn("_live", F.coalesce(live & F.col("ts").isNotNull(), F.lit(False)))
    held = earlier(calls.filter("_live"), ["session"], {"_n": ~F.col("failed")}, "ts", "id")
    spent = F.least(F.lit(budget), F.col("_n"))
    outcome = F.when(spent >= budget, "exhausted").when(F.col("failed"), "refunded").otherwise("admitted")
    held = held.select("session", "ts", "id", outcome.alias("outcome"), (budget - spent - (outcome == "admitted").cast("long")).alias("left"))
    lost = calls.filter(~F.col("_live")).select("session", "ts", "id", F.lit("no_session").alias("outcome"), F.lit(None).cast("long").alias("left"))
    return held.unionByName(lost)
