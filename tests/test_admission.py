"""Admission by plan and trial window, and session budgets: plain recurrence, batch form and stream agree."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import admission as A
from quarry.streaming import admission as S

T0 = dt.datetime(2024, 3, 1, 20, 0, 0)
CHAT = "account string, ts timestamp, id long, kind string, failed boolean"
CALL = "session string, ts timestamp, id long, kind string, failed boolean"


def _rows(seed, n, names, kinds, step):
    r, out, at = random.Random(seed), [], T0
    for i in range(n):
        at += dt.timedelta(seconds=r.choice([0, 1, step, step * 3]))
        out.append((r.choice(names), at, i, r.choice(kinds), r.choice([True, False, False, None])))
    return out


def _plain_chat(rows, trial, pro, hours):
    first, plans, used, out = {}, {}, {}, {}
    for acc, at, i, kind, failed in sorted(rows, key=lambda x: (x[1], x[2])):
        first.setdefault(acc, at)
        if kind == "upgrade":
            plans[acc] = "pro"
        if kind != "ask":
            continue
        plan = plans.get(acc, "trial")
        limit, k = (pro if plan == "pro" else trial), (acc, at.date())
        n = used.get(k, 0)
        if plan == "trial" and at > first[acc] + dt.timedelta(hours=hours):
            out[i] = (plan, n, 0, "trial_ended")
        elif n >= limit:
            out[i] = (plan, n, 0, "limit")
        elif failed:
            out[i] = (plan, n, limit - n, "refunded")
        else:
            used[k] = n + 1
            out[i] = (plan, n, limit - n - 1, "admitted")
    return out


def _plain_calls(rows, budget, minutes):
    expires, spent, out = {}, {}, {}
    for s, at, i, kind, failed in sorted(rows, key=lambda x: (x[1], x[2])):
        if kind == "start":
            expires.setdefault(s, at + dt.timedelta(minutes=minutes))
        if kind != "call":
            continue
        n = spent.get(s, 0)
        if s not in expires or at >= expires[s]:
            out[i] = ("no_session", None)
        elif n >= budget:
            out[i] = ("exhausted", 0)
        elif failed:
            out[i] = ("refunded", budget - n)
        else:
            spent[s] = n + 1
            out[i] = ("admitted", budget - n - 1)
    return out


CHATS = _rows(3, 900, ["a", "b", "c", "d"], ["ask"] * 30 + ["sign_in", "upgrade", None], 700)


def _sessions():
    """Sessions that begin one after another; a start repeated within a session's life changes nothing, later ones are calls."""
    begun, out = {}, []
    for s, at, i, kind, failed in _rows(5, 600, [f"s{i}" for i in range(4)], ["call"] * 9 + ["start"], 60):
        s = f"{s}-{i // 60}"
        if kind == "start" and at >= begun.setdefault(s, at) + dt.timedelta(minutes=20):
            kind = "call"
        out.append((s, at, i, kind, failed))
    return out


CALLS = _sessions()
chat_of = lambda df: {r["id"]: (r["plan"], r["used"], r["remaining"], r["outcome"]) for r in df.collect()}
call_of = lambda df: {r["id"]: (r["outcome"], r["left"]) for r in df.collect()}


def test_chat_by_plan_and_trial(spark):
    want = _plain_chat(CHATS, 4, 9, 5)
    assert {w[3] for w in want.values()} == {"admitted", "refunded", "trial_ended", "limit"} and {w[0] for w in want.values()} == {"trial", "pro"}
    assert chat_of(A.chat_admission(spark.createDataFrame(CHATS, CHAT), 4, 9, 5)) == want
    with pytest.raises(ValueError):
        A.chat_admission(spark.createDataFrame(CHATS, CHAT), 9, 4)


def test_default_limits(spark):
    assert (A.TRIAL_DAILY, A.PRO_DAILY, A.TRIAL_HOURS, A.SESSION_BUDGET, A.SESSION_MINUTES) == (6, 25, 24, 50, 30)
    rows = [("a", T0 - dt.timedelta(hours=15), i, "ask", False) for i in range(8)] + [("a", T0 + dt.timedelta(hours=9), 8, "ask", False), ("a", T0 + dt.timedelta(hours=9, microseconds=1), 9, "ask", False)]
    got = chat_of(A.chat_admission(spark.createDataFrame(rows, CHAT)))
    assert [got[i][3] for i in range(10)] == ["admitted"] * 6 + ["limit"] * 2 + ["admitted", "trial_ended"]


def test_rows_of_nobody_and_no_rows(spark):
    rows = [(None, T0, 1, "ask", False), ("a", None, 2, "ask", None), ("a", T0, 3, "ask", None), ("a", T0, 3, "ask", None), (None, T0, 4, None, None)]
    got = sorted((r["id"], r["outcome"], r["used"]) for r in A.chat_admission(spark.createDataFrame(rows, CHAT)).collect())
    assert got == [(1, "unauthenticated", 0), (2, "unauthenticated", 0), (3, "admitted", 0), (3, "admitted", 1)]
    assert A.chat_admission(spark.createDataFrame([], CHAT)).count() == A.session_calls(spark.createDataFrame([], CALL)).count() == 0
    odd = [(None, T0, 1, "call", None), ("s", T0, 2, "start", None), ("s", None, 3, "call", None), ("s", T0, 4, "call", None), ("s", T0, 1, "call", None)]
    got = sorted((r["id"], r["outcome"], r["left"]) for r in A.session_calls(spark.createDataFrame(odd, CALL), 2).collect())
    assert [g for g in got if g[1] != "no_session"] == [(4, "admitted", 1)] and len(got) == 4


def test_session_budgets(spark):
    want = _plain_calls(CALLS, 3, 20)
    assert {w[0] for w in want.values()} == {"admitted", "refunded", "exhausted", "no_session"}
    assert call_of(A.session_calls(spark.createDataFrame(CALLS, CALL), 3, 20)) == want


def _stream(spark, tmp_path, rows, schema, form, parts):
    """Runs a stream over the rows in several files, a file a batch, stopped and started again halfway."""
    spark.conf.set(*S.ROCKSDB)
    src, out = tmp_path / "in", tmp_path / "out"
    size = -(-len(rows) // parts)
    try:
        for half in (range(parts // 2), range(parts // 2, parts)):
            for i in half:
                spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(src / f"{i:03d}"))
            reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
            q = form(reader).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert not q.isActive and q.exception() is None
    finally:
        spark.conf.unset(S.ROCKSDB[0])
    return spark.read.parquet(str(out)), q


def test_chat_stream_equals_batch(spark, tmp_path):
    got, _ = _stream(spark, tmp_path, CHATS, CHAT, lambda r: S.chat_admission(r, 4, 9, 5), 4)
    assert chat_of(got) == _plain_chat(CHATS, 4, 9, 5)
    assert got.filter(F.col("at") != F.unix_micros(F.lit(T0))).count() > 0


def test_session_stream_equals_batch_and_forgets(spark, tmp_path):
    got, q = _stream(spark, tmp_path, CALLS, CALL, lambda r: S.session_calls(r, 3, 20), 4)
    assert call_of(got) == _plain_calls(CALLS, 3, 20)
    # Of 40 sessions only those stay that the watermark hasn't passed.
    assert q.lastProgress.stateOperators[0].numRowsTotal < 2 * 20
