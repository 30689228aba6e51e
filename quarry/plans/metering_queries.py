"""Queries of usage metering over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import admission as A
from quarry.operators import metering as M
from quarry.plans.registry import query, table


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.daily(table(spark, sf_dir, "events"), "user_id")


@query(
    """WITH d AS (SELECT *, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS delta FROM events), p AS (SELECT *, sum(delta) OVER w AS prefix FROM d WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, min(prefix) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM p)
SELECT event_id, CAST(prefix - least(0, low) AS BIGINT) AS counter FROM f"""
)
def quota_with_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a day, less refunds (errors), never below zero."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return M.floored_sum(e, ["user_id", "day"], F.when(F.col("event_type") == "error", -1).otherwise(1), "ts", "event_id").select("event_id", "counter")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id % 20, CAST(ts AS DATE) ORDER BY ts, event_id) > 3 AS blocked FROM events")
def per_ip_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ip", F.col("user_id") % 20)
    return M.over_limit(e, ["event_type", "ip"], 3, "event_id").select("event_id", "blocked")


@query("WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_id, user_id FROM n WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 3600000000")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of quiet per user."""
    return M.debounce(table(spark, sf_dir, "events"), ["user_id"], 3600, "event_id").select("event_id", "user_id")


@query(
    """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, CAST(burst AS BIGINT) AS burst, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM b GROUP BY user_id, burst"""
)
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bursts(table(spark, sf_dir, "events"), ["user_id"], 3600, "event_id")


@query(
    """WITH d AS (SELECT *, CAST(CASE WHEN event_type = 'error' THEN -5 ELSE floor(value) END AS BIGINT) AS delta FROM events),
p AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS prefix FROM d),
f AS (SELECT *, prefix - least(0, min(prefix) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS spent FROM p)
SELECT event_id, CAST(greatest(0, 500 - spent) AS BIGINT) AS "left", spent - greatest(delta, 0) < 500 AS admitted FROM f"""
)
def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "error", F.lit(-5)).otherwise(F.floor("value")).cast("long"))
    return M.budget(e, ["user_id"], 500, "ts", "event_id").select("event_id", "left", "admitted")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS model, least(CAST(floor(value * 100) AS BIGINT), 2000) AS max_tokens FROM events")
def request_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.floor(F.col("value") * 100).alias("max_tokens"))
    return M.clamp(r, ["click", "view"], "view", 2000)


@query(
    """SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events) GROUP BY ALL"""
)
def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming usage aggregate."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    """WITH e AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS started, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS pro FROM events),
a AS (SELECT *, pro OR ts <= started + INTERVAL 24 HOUR AS open, CASE WHEN pro THEN 3 ELSE 2 END AS most FROM e WHERE event_type NOT IN ('purchase', 'signup')),
n AS (SELECT *, coalesce(sum(CASE WHEN open AND event_type <> 'error' AND NOT pro THEN 1 END) OVER w, 0) AS trials, coalesce(sum(CASE WHEN open AND event_type <> 'error' AND pro THEN 1 END) OVER w, 0) AS pros
  FROM a WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, CAST(least(most, least(2, trials) + pros) AS BIGINT) AS used FROM n),
o AS (SELECT *, CASE WHEN NOT open THEN 'trial_ended' WHEN used >= most THEN 'limit' WHEN event_type = 'error' THEN 'refunded' ELSE 'admitted' END AS outcome FROM u)
SELECT event_id, user_id, CASE WHEN pro THEN 'pro' ELSE 'trial' END AS plan, used, CAST(CASE WHEN NOT open THEN 0 WHEN outcome = 'admitted' THEN most - used - 1 ELSE most - used END AS BIGINT) AS remaining, outcome FROM o"""
)
def chat_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks by users whose first purchase is an upgrade; errors are failures. Limits of 2 and 3 a day are met at every size."""
    kind = F.when(F.col("event_type") == "purchase", "upgrade").when(F.col("event_type") == "signup", "sign_in").otherwise("ask")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_type") == "error").alias("failed"))
    a = A.chat_admission(e, 2, 3)
    return a.select(F.col("id").alias("event_id"), F.col("account").alias("user_id"), "plan", "used", "remaining", "outcome")


@query(
    """WITH e AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events),
s AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id, k) AS started FROM e),
c AS (SELECT *, coalesce(ts < started + INTERVAL 2880 MINUTE, false) AS live FROM s WHERE event_type <> 'signup'),
n AS (SELECT *, least(3, coalesce(sum(CASE WHEN live AND event_type <> 'error' THEN 1 END) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS spent FROM c),
o AS (SELECT *, CASE WHEN NOT live THEN 'no_session' WHEN spent >= 3 THEN 'exhausted' WHEN event_type = 'error' THEN 'refunded' ELSE 'admitted' END AS outcome FROM n)
SELECT event_id, outcome, CAST(CASE WHEN live THEN 3 - spent - CASE WHEN outcome = 'admitted' THEN 1 ELSE 0 END END AS BIGINT) AS "left" FROM o"""
)
def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup opens a session of its user, of three calls within two days; errors give their call back."""
    e = table(spark, sf_dir, "events")
    nth = F.count(F.when(F.col("event_type") == "signup", 1)).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = e.select(F.concat_ws("-", "user_id", nth).alias("session"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "start").otherwise("call").alias("kind"), (F.col("event_type") == "error").alias("failed"))
    return A.session_calls(rows, 3, 2880).select(F.col("id").alias("event_id"), "outcome", "left")
