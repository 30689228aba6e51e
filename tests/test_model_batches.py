"""The ladder of model batches: a faulty model loses nothing, nothing is asked for twice, and a day's budget holds."""

from __future__ import annotations

import json
import os
import time
from collections import Counter

from quarry.operators import model_batches


def test_a_faulty_model_loses_nothing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def model(texts):
        with open(log / f"{os.getpid()}", "a") as f:
            f.write(json.dumps([time.time_ns(), texts]) + "\n")
        if "raise" in texts and len(texts) > 1:
            raise ValueError("broken")
        if "never" in texts or ("hard" in "".join(texts) and len(texts) > 2):
            return None
        return [None if t.startswith("skip") and len(texts) > 1 else t.upper() for t in texts]

    calls = lambda: [c for _, c in sorted(json.loads(x) for f in log.iterdir() for x in f.read_text().splitlines())]
    texts = [f"text {i}" for i in range(45)] + ["hard 1", "hard 2", "raise", "never", "skip 1", "skip 2", "x" * 500, "y" * 500, "text 3"]
    docs = spark.createDataFrame([(i, f"h-{t[:8]}", t) for i, t in enumerate(texts)] + [(90, "h-null", None), (91, None, "no hash")], "id long, hash string, text string")
    run = lambda day, n: {r["id"]: (r["reply"], r["state"]) for r in model_batches.answer(docs, model, str(tmp_path / "cache"), day, calls=n, most_chars=600, wave=3).collect()}
    first = run("1", 4)
    assert len(calls()) == 4 and {s for _, s in first.values()} == {"answered", "waiting"}
    assert all(len(c) <= 10 and (len(c) == 1 or sum(map(len, c)) <= 600) for c in calls())
    assert run("1", 4) == first and len(calls()) == 4  # the day is over
    got = run("2", 1000)
    for i, t in enumerate(texts):
        assert got[i] == ((None, "unreadable") if t == "never" else (t.upper(), "answered"))
    assert got[90] == ("", "answered") and got[91] == (None, "waiting")
    n = len(calls())
    assert run("2", 1000) == got and len(calls()) == n
    # No text is asked for again once it has a reply.
    answered = Counter()
    for c in calls():
        assert not any(answered[t] for t in c)
        if not (("raise" in c and len(c) > 1) or "never" in c or ("hard" in "".join(c) and len(c) > 2)):
            answered.update(t for t in c if not (t.startswith("skip") and len(c) > 1))
    assert run("3", 1000)[texts.index("never")] == (None, "unreadable") and len(calls()) > n


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "hash string, text string")
    assert model_batches.answer(none, lambda t: t, str(tmp_path / "c"), "1").count() == 0
