"""Dates in texts with what stands around them: announced dates, their excerpts, and a file's primary date.

All of it is column expressions. A text is split at the dates of a shape; the pieces and the dates between them, side by
side, give each date's surroundings without any offsets: as a date has eight characters at least, the last sixteen
neighbours suffice for 120 characters before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as T

# What announces an obligation, in order of priority, what says that it is over, cues of a document's own date, and words after which a dot ends no sentence.
ANNOUNCED = [
    ("Payment due", r"payment\s+due|amount\s+due|pay\s+(?:by|before)"),
    ("Filing due", r"filing\s+due(?:\s+date)?|file\s+by|last\s+date(?:\s+for\s+filing)?|(?:must|shall|should|to)\s+be\s+filed\s+(?:on\s+or\s+)?before"),
    ("Renewal", r"renewal(?:\s+review)?(?:\s+due)?|renew\s+(?:by|before)"),
    ("Expires", r"expir(?:es|y|ing|ation)|valid\s+(?:until|till|upto|up\s+to)|lapses?"),
    ("Response due", r"response\s+(?:required|due)|respond\s+by|reply\s+by"),
    ("Deadline", r"deadline"),
    ("Due", r"due\s+(?:by|date|on)|due:"),
    ("Due", r"on\s+or\s+before|no\s+later\s+than"),
]
OVER = (
    r"\b(?:was|were|has\s+been|have\s+been|already|been)\s+(?:paid|settled|completed|received|cleared|renewed|filed|submitted|made|done)\b"
    r"|\b(?:paid|settled|completed|received|cleared|renewed|filed|submitted)\s+on\b(?!\s+or\b)"
)
OVER_LABEL = (
    r"(?:(?<!due\s)(?<!last\s)\b(?:date\s+of\s+(?:filing|submission|payment|receipt)|filing\s+date|submission\s+date|payment\s+date|receipt\s+date)"
    r"|\b(?:filed|submitted|paid|received|issued|generated)\s+on)\s*[:\-–—]?\s*$"
)
CUE = r"(?i)(?:invoice\s+date|statement\s+period|return\s+period|bill\s+month|pay\s+date|date\s+of\s+issue|issued\s+on|issued|dated|date)\s*[:\-]?\s*"
ABBREVIATIONS = "rs|no|dr|mr|mrs|ms|pvt|ltd|inc|co|vs|etc|approx"
SHAPES = {
    "dmy": rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{D.MONTH}\.?,?\s+(\d{{4}})\b",
    "mdy": rf"(?i)\b{D.MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b",
    "iso": r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b",
    "numeric": r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b",
}
MONTH_YEAR = rf"(?i)\b{D.MONTH}\.?\s+(\d{{4}})\b"
YEAR_MONTH = r"\b(20\d{2})\s*[-_. ]\s*(\d{1,2})\b"
FIRST_YEAR, LAST_YEAR = 2000, 2099
WINDOW, BACK, AHEAD = 60, 120, 100
OPENING, AFTER_CUE = 2000, 40
# Fixed values end.
#: Ends a sentence on the way back from a date.
STOP = rf"[\n\r]|(?<!(?<![\p{{L}}\p{{N}}])(?i:{ABBREVIATIONS}))[.!?](?=\s)"


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a column that is computed once, however often it is named; Spark repeats it else in every branch."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, D.MONTHS)), F.lower(F.substr(name, F.lit(1), F.lit(3))))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The ISO date of text or numbers, if there is one in the accepted years."""

    def iso(n: Column) -> Column:
        text = F.concat_ws("-", *(F.lpad(n[c].cast("string"), size, "0") for c, size in (("y", 4), ("m", 2), ("d", 2))))
        fits = n["y"].between(FIRST_YEAR, LAST_YEAR) & n["m"].between(1, 12) & n["d"].between(1, 31)
        return F.when(fits, _let(text, lambda t: F.when(F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t)))

    return _let(F.struct(*(c.try_cast("int").alias(k) for k, c in (("y", y), ("m", m), ("d", d)))), iso)


def parsed(kind: str, match: Column, month_first: bool = False) -> Column:
    """The date of a match of a shape; numbers are read day first unless said otherwise, and the other way if that is none."""

    def read(g: Column) -> Column:
        a, b, c = (g[k] for k in "abc")
        if kind == "dmy":
            return _day(c, _month(b), a)
        if kind == "mdy":
            return _day(c, _month(a), b)
        if kind == "iso":
            return _day(a, b, c)
        return F.coalesce(_day(c, a, b), _day(c, b, a)) if month_first else F.coalesce(_day(c, b, a), _day(c, a, b))

    return _let(F.struct(*(F.regexp_extract(match, SHAPES[kind], i).alias(k) for i, k in enumerate("abc", 1))), read)


def found(text: Column, pattern: str) -> Column:
    """Structs (match, before, after) of all matches: up to 120 characters before each and 101 after it."""
    cut = lambda x: F.when(F.length(x) > BACK + AHEAD, F.concat(F.substr(x, F.lit(1), F.lit(AHEAD + 1)), F.right(x, F.lit(BACK)))).otherwise(x)

    def around(matches: Column, side: Column) -> Column:
        before = lambda i: F.right(F.array_join(F.slice(side, F.greatest(2 * i - 30, F.lit(1)), F.least(2 * i + 1, F.lit(32))), ""), F.lit(BACK))
        after = lambda i: F.substr(F.array_join(F.slice(side, 2 * i + 3, F.lit(32)), ""), F.lit(1), F.lit(AHEAD + 1))
        return F.transform(matches, lambda m, i: F.struct(m.alias("match"), before(i).alias("before"), after(i).alias("after")))

    def of(t: Column) -> Column:
        """Piece, match, piece, match, ..., piece, "" of a text."""
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        sides = lambda ms: F.transform(F.flatten(F.zip_with(F.split(t, pattern, -1), ms, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), cut)
        return _let(matches, lambda ms: _let(sides(ms), lambda side: around(ms, side)))

    return _let(text, of)


def announced(before: Column) -> Column:
    """What the 60 characters before a date announce; null if nothing, or if it is over."""

    def named(w: Column) -> Column:
        title = None
        for name, p in ANNOUNCED:
            gap = F.element_at(F.split(w, p, -1), -1)  # what follows the last of them
            title = (F.when if title is None else title.when)(w.rlike(p) & ~gap.rlike(OVER), name)
        return F.when(~w.rlike(OVER_LABEL), title)

    return _let(F.lower(F.right(before, F.lit(WINDOW))), named)


def excerpt(before: Column, match: Column, after: Column) -> Column:
    """The sentence around a date: back to a stop or 120 characters, on to one or 100, cut at words there."""
    head = F.element_at(F.split(before, STOP, -1), -1)
    head = F.when((F.length(before) == BACK) & (F.length(head) == BACK), F.regexp_replace(head, r"^\S+", "")).otherwise(head)
    line = F.regexp_extract(after, r"^[^\n\r]*", 0)
    stop = F.regexp_extract(after, r"^([^\n\r]*?[.!?])(?=\s|\z)", 1)
    tail = F.when((stop != "") & (F.length(stop) <= AHEAD), stop).otherwise(F.substr(line, F.lit(1), F.lit(AHEAD)))
    tail = F.when(F.length(tail) >= AHEAD, F.regexp_replace(tail, r"\S+$", "")).otherwise(tail)
    return F.trim(F.regexp_replace(F.concat(head, match, tail), r"\s+", " "))


def _dated(kind: str, month_first: bool) -> Callable[[Column, Column], Column]:
    """A match with its place and date."""
    return lambda f, i: F.struct(i.alias("_at"), parsed(kind, f["match"], month_first).alias("date"), *(f[c].alias(c) for c in ("match", "before", "after")))


def scan_events(docs: DataFrame, id_col: str, text_col: str, month_first: bool = False) -> DataFrame:
    """(id, date, title, excerpt) for every announced date of a text, each date and title once, as first found.

    The shapes are looked for one after the other. Texts of one id count as one.
    """
    some = docs.select(id_col, F.col(text_col).alias("_text")).filter(F.col("_text").rlike(r"\d{4}"))
    each = []
    for n, (kind, pattern) in enumerate(SHAPES.items()):
        # Nothing is computed for texts without a date of the shape.
        # Dates and titles are read and filtered within the array: a filter on columns would read them again.
        dated = F.filter(F.transform(found(F.col("_text"), pattern), _dated(kind, month_first)), lambda f: f["date"].isNotNull())
        titled = F.filter(F.transform(dated, lambda f: F.struct(f.alias("f"), announced(f["before"]).alias("title"))), lambda f: f["title"].isNotNull())
        hit = some.filter(F.col("_text").rlike(pattern)).select(id_col, F.explode(titled).alias("_f"))
        each.append(hit.select(id_col, F.lit(n).alias("_shape"), "_f.title", "_f.f.*"))
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    rows = rows.select(id_col, "date", "title", F.struct("_shape", "_at").alias("_place"), excerpt(F.col("before"), F.col("match"), F.col("after")).alias("excerpt"))
    return rows.groupBy(id_col, "date", "title").agg(F.min_by("excerpt", "_place").alias("excerpt"))


def first_date(text: Column, month_first: bool = False) -> Column:
    """The date that comes first of the first of each shape, a month with its year included; null without any."""

    def option(t: Column, n: int, pattern: str, read: Callable[[Column], Column]) -> Column:
        """(at, shape, date) of the first match; null without one, or if it is no date."""
        dated = lambda d: F.when(d.isNotNull(), F.struct(F.regexp_instr(t, F.lit(pattern)).alias("at"), F.lit(n).alias("shape"), d.alias("date")))
        return _let(F.regexp_extract(t, pattern, 0), lambda m: F.when(m != "", _let(read(m), dated)))

    def of(t: Column) -> Column:
        options = [option(t, n, p, lambda m, kind=kind: parsed(kind, m, month_first)) for n, (kind, p) in enumerate(SHAPES.items())]
        options.append(option(t, len(SHAPES), MONTH_YEAR, _month_of))
        return F.array_min(F.array_compact(F.array(*options)))["date"]

    return _let(text, of)


def _month_of(text: Column) -> Column:
    """The first day of the first month with its year."""
    return _day(F.regexp_extract(text, MONTH_YEAR, 2), _month(F.regexp_extract(text, MONTH_YEAR, 1)), F.lit(1))


def primary_date(name: Column, text: Column, month_first: bool = False) -> Column:
    """The month in a file's name, else the date after the first cue that has one, else the first date of the opening."""

    def by_name(n: Column) -> Column:
        return F.coalesce(_month_of(n), _day(F.regexp_extract(n, YEAR_MONTH, 1), F.regexp_extract(n, YEAR_MONTH, 2), F.lit(1)))

    def by_text(head: Column) -> Column:
        cued = F.filter(F.transform(found(head, CUE), lambda f: first_date(F.substr(f["after"], F.lit(1), F.lit(AFTER_CUE)), month_first)), lambda d: d.isNotNull())
        return F.coalesce(F.when(head.rlike(CUE), F.get(cued, F.lit(0))), F.when(head.rlike(r"\d{4}"), first_date(head, month_first)))

    named = _let(F.regexp_replace(T.split_camel(F.coalesce(name, F.lit(""))), "[-_./]+", " "), by_name)
    return F.coalesce(named, _let(F.substr(F.coalesce(text, F.lit("")), F.lit(1), F.lit(OPENING)), by_text))
