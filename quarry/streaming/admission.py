"""Admission as streams: the counters of ``quarry.operators.admission`` kept as state with event-time timers.

The session needs the RocksDB state store (``ROCKSDB``). Rows of an account within a micro-batch are taken by time and id;
what a task holds for one account is its share of a micro-batch, which the source's rate limit bounds. State is a few
numbers an account: when it was first seen and its plan stay, a day's counter goes when the watermark has passed that day,
a session goes when the watermark has passed its expiry. Rows without a key or a time have no counter; the batch form lists
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.admission import PRO_DAILY, SESSION_BUDGET, SESSION_MINUTES, TRIAL_DAILY, TRIAL_HOURS

#: The state store's setting and value that these streams need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHAT = "account {kind}, at long, id {id}, plan string, used long, remaining long, outcome string"
CALLS = "session {kind}, at long, id {id}, outcome string, left long"


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")


class _Chat(StatefulProcessor):
    def __init__(self, trial: int, pro: int, hours: int):
        self.limits, self.micros = {False: trial, True: pro}, hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "started long, pro boolean")
        self.today = handle.getValueState("today", "ends long, used long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201
        started, pro = self.account.get() or (None, False)
        ends, used = self.today.get() or (None, 0)
        timed, out = ends, []
        for at, id_, kind, failed, end in _ordered(rows)[["at", "id", "kind", "failed", "ends"]].itertuples(index=False):
            started = at if started is None else min(started, at)
            if ends is None or end > ends:
                ends, used = int(end), 0
            if kind == "upgrade":
                pro = True
            if kind != "ask":
                continue
            limit, before = self.limits[pro], used
            if not pro and at > started + self.micros:
                outcome = "trial_ended"
            elif used >= limit:
                outcome = "limit"
            elif failed:
                outcome = "refunded"
            else:
                outcome, used = "admitted", used + 1
            out.append((key[0], at, id_, "pro" if pro else "trial", min(limit, before), 0 if outcome == "trial_ended" else max(0, limit - used), outcome))
        self.account.update((int(started), bool(pro)))
        self.today.update((int(ends), used))
        if ends != timed:
            self.handle.registerTimer(int(ends))
        yield pd.DataFrame(out, columns=["account", "at", "id", "plan", "used", "remaining", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201
        if self.today.exists() and self.today.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.today.clear()
        yield pd.DataFrame(columns=["account", "at", "id", "plan", "used", "remaining", "outcome"])

    def close(self) -> None:
        pass


def chat_admission(requests: DataFrame, trial: int = TRIAL_DAILY, pro: int = PRO_DAILY, hours: int = TRIAL_HOURS, late: str = "10 minutes") -> DataFrame:
    """The batch form's columns of every ask (``ts`` as ``at``, in microseconds), as the asks come."""
    if pro < trial:
        raise ValueError("an upgrade must not lower the limit")
    r = requests.withColumn("ts", F.col("ts").cast("timestamp")).filter("account IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    ends = F.unix_millis(F.date_add(F.to_date("ts"), 1).cast("timestamp"))
    r = r.select("account", "ts", F.unix_micros("ts").alias("at"), "id", "kind", F.coalesce("failed", F.lit(False)).alias("failed"), ends.alias("ends"))
    schema = CHAT.format(**_kinds(r, "account"))
    return r.groupBy("account").transformWithStateInPandas(_Chat(trial, pro, hours), schema, "Append", "eventTime")


class _Calls(StatefulProcessor):
    def __init__(self, budget: int, minutes: int):
        self.budget, self.micros = budget, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "expires long, spent long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201
        expires, spent = self.session.get() or (None, 0)
        known, out = expires, []
        for at, id_, kind, failed in _ordered(rows)[["at", "id", "kind", "failed"]].itertuples(index=False):
            if kind == "start" and expires is None:
                expires = int(at) + self.micros
            if kind != "call":
                continue
            if expires is None or at >= expires:
                outcome = "no_session"
            elif spent >= self.budget:
                outcome = "exhausted"
            elif failed:
                outcome = "refunded"
            else:
                outcome, spent = "admitted", spent + 1
            out.append((key[0], at, id_, outcome, None if outcome == "no_session" else self.budget - spent))
        if expires is not None:
            self.session.update((expires, spent))
            if known is None:
                self.handle.registerTimer(expires // 1000 + 1)
        yield pd.DataFrame(out, columns=["session", "at", "id", "outcome", "left"]).astype({"left": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201
        self.session.clear()
        yield pd.DataFrame(columns=["session", "at", "id", "outcome", "left"])

    def close(self) -> None:
        pass


def session_calls(rows: DataFrame, budget: int = SESSION_BUDGET, minutes: int = SESSION_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The batch form's columns of every call (``ts`` as ``at``, in microseconds); an expired session's state is dropped."""
    r = rows.withColumn("ts", F.col("ts").cast("timestamp")).filter("session IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    r = r.select("session", "ts", F.unix_micros("ts").alias("at"), "id", "kind", F.coalesce("failed", F.lit(False)).alias("failed"))
    return r.groupBy("session").transformWithStateInPandas(_Calls(budget, minutes), CALLS.format(**_kinds(r, "session")), "Append", "eventTime")


def _kinds(r: DataFrame, key: str) -> dict[str, str]:
    return {"kind": r.schema[key].dataType.simpleString(), "id": r.schema["id"].dataType.simpleString()}
