"""Dates in texts in plain Python, character by character: the brute-force version of ``quarry.operators.date_scan``."""

from __future__ import annotations

import datetime
import re

from quarry.functions import dates as D
from quarry.operators.date_scan import ANNOUNCED, OVER, OVER_LABEL

ABBREVIATIONS = set("rs no dr mr mrs ms pvt ltd inc co vs etc approx".split())
OVER, OVER_LABEL = re.compile(OVER), re.compile(OVER_LABEL)
_ANNOUNCED = [(name, re.compile(p)) for name, p in ANNOUNCED]
_SHAPES = [
    ("dmy", re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{D.MONTH}\.?,?\s+(\d{{4}})\b", re.I)),
    ("mdy", re.compile(rf"\b{D.MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", re.I)),
    ("iso", re.compile(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b")),
    ("numeric", re.compile(r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b")),
]
BEFORE = 60


def _date(kind: str, m: re.Match, month_first: bool) -> datetime.date | None:
    g = m.groups()
    month = lambda s: D.MONTHS.index(s[:3].lower()) + 1
    if kind == "numeric":
        a, b, y = map(int, g)
        tries = [(y, a, b), (y, b, a)] if month_first else [(y, b, a), (y, a, b)]
    elif kind == "iso":
        tries = [tuple(map(int, g))]
    else:
        day, mon = (g[0], g[1]) if kind == "dmy" else (g[1], g[0])
        tries = [(int(g[2]), month(mon), int(day))]
    for y, mo, d in tries:
        if 2000 <= y <= 2099:
            try:
                return datetime.date(y, mo, d)
            except ValueError:
                continue
    return None


def _announced(before: str) -> str | None:
    if OVER_LABEL.search(before):
        return None
    for name, p in _ANNOUNCED:
        end = max((m.end() for m in p.finditer(before)), default=-1)
        if end >= 0 and not OVER.search(before[end:]):
            return name
    return None


def _around(text: str, start: int, end: int, back: int = 120, ahead: int = 100) -> str:
    """The sentence around a date, cut at words, one character after the other."""
    s = start
    while s > 0 and start - s < back:
        c = text[s - 1]
        if c in "\n\r":
            break
        if c in ".!?" and text[s].isspace() and re.search(r"([^\W_]*)$", text[: s - 1])[1].lower() not in ABBREVIATIONS:
            break
        s -= 1
    if start - s >= back:
        while s < start and not text[s].isspace():
            s += 1
    e = end
    while e < len(text) and e - end < ahead:
        c = text[e]
        if c in "\n\r":
            break
        e += 1
        if c in ".!?" and (e >= len(text) or text[e].isspace()):
            break
    if e - end >= ahead:
        while e > end and not text[e - 1].isspace():
            e -= 1
    return " ".join(text[s:e].split())


def find_events(text: str, month_first: bool = False) -> list[dict]:
    """Announced dates of a text; each (date, title) once."""
    low, seen, out = text.lower(), set(), []
    for kind, p in _SHAPES:
        for m in p.finditer(text):
            day = _date(kind, m, month_first)
            title = day and _announced(low[max(0, m.start() - BEFORE) : m.start()])
            if title and (day, title) not in seen:
                seen.add((day, title))
                out.append({"date": day.isoformat(), "title": title, "excerpt": _around(text, m.start(), m.end())})
    return out


CUE = re.compile(r"(?:invoice\s+date|statement\s+period|return\s+period|bill\s+month|pay\s+date|date\s+of\s+issue|issued\s+on|issued|dated|date)\s*[:\-]?\s*", re.I)
MONTH_YEAR = re.compile(rf"\b{D.MONTH}\.?\s+(\d{{4}})\b", re.I)


def _first_date(s: str, month_first: bool) -> datetime.date | None:
    best, at = None, len(s) + 1
    for kind, p in _SHAPES:
        m = p.search(s)
        if m and m.start() < at and (day := _date(kind, m, month_first)):
            best, at = day, m.start()
    m = MONTH_YEAR.search(s)
    if m and m.start() < at and 2000 <= int(m[2]) <= 2099:
        best = datetime.date(int(m[2]), D.MONTHS.index(m[1][:3].lower()) + 1, 1)
    return best


def primary_date(name: str | None, text: str | None, month_first: bool = False) -> str | None:
    """The month in the file's name, else a date after a cue, else the first date of the opening."""
    if name:
        n = re.sub(r"([a-z])([A-Z])", r"\1 \2", name)
        n = re.sub(r"([A-Za-z])([0-9])", r"\1 \2", n)
        n = re.sub(r"[-_./]+", " ", re.sub(r"([0-9])([A-Za-z])", r"\1 \2", n))
        m = MONTH_YEAR.search(n)
        if m and 2000 <= int(m[2]) <= 2099:
            return datetime.date(int(m[2]), D.MONTHS.index(m[1][:3].lower()) + 1, 1).isoformat()
        m = re.search(r"\b(20\d{2})\s*[-_. ]\s*(\d{1,2})\b", n)
        if m and 1 <= int(m[2]) <= 12:
            return datetime.date(int(m[1]), int(m[2]), 1).isoformat()
    head = (text or "")[:2000]
    for m in CUE.finditer(head):
        if day := _first_date(head[m.end() : m.end() + 40], month_first):
            return day.isoformat()
    day = _first_date(head, month_first)
    return day.isoformat() if day else None


