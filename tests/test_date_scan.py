"""Announced dates, excerpts and primary dates against a character-by-character version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.operators import date_scan
from tests import plain_dates

PARTS = [
    "Payment due ", "amount due by ", "file by ", "last date for filing: ", "renew by ", "expires on ", "valid till ", "respond by ", "deadline ", "due on ", "due: ", "no later than ", "was paid on ", "Date of filing: ", "filed on ", "filing due date - ",
    "5 March 2024", "3rd of June 2031", "April 4, 2025", "2024-02-30", "2024-02-28", "01/02/2024", "31.12.1999", "13/02/2024", "12-30-2026", "Sept. 9 2027", "May 2026",
    " ", " ", ". ", "! ", "?\n", "\n", "\r\n", " Rs. 5", " no. 7 ", " etc. and", "word " * 9, "x" * 130, " (see below) ", "é à ", "1.5 ", "Invoice date: ", "dated ", "a.b ", "\t",
]


def _texts(n=400):
    rng = random.Random(8)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(n)] + ["", None, "5 March 2024", "due by 5 March 2024", " " * 300 + "due by 5 March 2024" + " " * 300, "due on 01/02/2024 " * 60]


def test_events(spark):
    texts = _texts()
    for first in (False, True):
        got = date_scan.scan_events(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", first)
        rows = {(r["id"], r["date"], r["title"]): r["excerpt"] for r in got.collect()}
        want = {(i, e["date"], e["title"]): e["excerpt"] for i, t in enumerate(texts) for e in plain_dates.find_events(t or "", first)}
        assert set(rows) == set(want)
        assert {k: (texts[k[0]], rows[k], want[k]) for k in want if rows[k] != want[k]} == {}


def test_primary_dates(spark):
    rng = random.Random(9)
    names = ["GST-Return-Mar2024.pdf", "scan_2023-07.pdf", "a.pdf", None, "MayReport2025v2.doc", "2031-13 x", "x 1999-05"]
    rows = [(i, rng.choice(names), t) for i, t in enumerate(_texts())] + [(9000, "a.pdf", "x" * 1990 + " 5 March 2024")]
    got = {r["id"]: r["d"] for r in spark.createDataFrame(rows, "id long, name string, text string").select("id", date_scan.primary_date(F.col("name"), F.col("text")).alias("d")).collect()}
    assert {i: (n, t, got[i], plain_dates.primary_date(n, t)) for i, n, t in rows if got[i] != plain_dates.primary_date(n, t)} == {}
    assert sum(d is not None for d in got.values()) > 200
