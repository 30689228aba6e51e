"""Dates in text, calendar periods and steps. "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and the shapes of dates and of words that announce one.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_SHAPES = {
    "numeric-date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "iso-date": r"\b\d{4}-\d{2}-\d{2}\b",
    "month-name": rf"(?i)\b(\d{{1,2}}\s+{MONTH}|{MONTH}\.?\s+\d{{1,2}})\b",
    "ordinal-day": r"(?i)\bthe\s+\d{1,2}(?:st|nd|rd|th)\b",
    "bare-year": r"\b20\d{2}\b",
    "relative-date": r"(?i)\b(within\s+\d+\s+(?:day|week|month|year)s?|next\s+(?:week|month|quarter|year)|in\s+\d+\s+(?:day|week|month)s?|q[1-4]\b)",
}
TRIGGER_WORDS = (
    r"(?i)\b(due|deadline|expir\w+|renew\w*|valid\s+(?:until|till|through)|no\s+later\s+than|on\s+or\s+before|last\s+date|cut[\s-]?off|payable|remit|submit|filed?\s+by|respond|lapse\w*|maturity|effective\s+date|notice\s+period|terminat\w+|grace\s+period|overdue|reminder|by\s+the)\b"
)
# Fixed values end.
#: Steps after which a repeated date has found its last day of the month (leap years may be eight years apart).
DRIFT = 100


def date_reasons(c: Column) -> Column:
    """Names of the date shapes a text has, and "trigger-word"; empty for none."""
    shapes = [F.when(c.rlike(p), name) for name, p in (*DATE_SHAPES.items(), ("trigger-word", TRIGGER_WORDS))]
    return F.filter(F.array(*shapes), lambda x: x.isNotNull())


def is_iso(c: Column) -> Column:
    """A text of ten characters that is a date."""
    return F.coalesce((F.length(c) == 10) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def due_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "NO_DATE").when(days < 0, "OVERDUE").when(days <= 7, "DUE_SOON").otherwise("UPCOMING")


def step(date: Column, every: Column) -> Column:
    return F.when(every == "weekly", F.date_add(date, 7)).when(every == "monthly", F.add_months(date, 1)).when(every == "quarterly", F.add_months(date, 3)).when(every == "yearly", F.add_months(date, 12))


def next_occurrence(date: Column, every: Column, today: Column) -> Column:
    """Repeated steps until not before today; the 31st, once shortened to the 28th, stays there.

    A day up to the 28th is never shortened, so whole periods are skipped at once. A later day is first stepped
    ``DRIFT`` times: by then a series of months has passed a February of 28 days, one of quarters every month it meets,
    and one of years its shortest; the rest is skipped at once as well.
    """
    months = F.when(every == "monthly", 1).when(every == "quarterly", 3).when(every == "yearly", 12)
    weeks = F.greatest(F.lit(0), F.floor((F.datediff(today, date) + 6) / 7)).cast("int")

    def skip(d: Column) -> Column:
        apart = (F.year(today) - F.year(d)) * 12 + F.month(today) - F.month(d)
        near = F.add_months(d, F.floor(apart / months).cast("int") * months)
        return F.when(d >= today, d).when(near >= today, near).otherwise(F.add_months(d, (F.floor(apart / months).cast("int") + 1) * months))

    stepped = F.aggregate(F.sequence(F.lit(1), F.lit(DRIFT)), date, lambda d, _: F.when(d < today, step(d, every)).otherwise(d))
    return F.when(every == "weekly", F.date_add(date, weeks * 7)).when(months.isNotNull() & (F.dayofmonth(date) <= 28), skip(date)).when(months.isNotNull(), skip(stepped)).otherwise(date)


def period_index(c: Column) -> Column:
    """Months, quarters or years as integers, by the period's own shape; null for another text."""
    y = F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")
    month = F.regexp_extract(c, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    quarter = F.regexp_extract(c, r"^\d{4}-Q([1-4])$", 1).try_cast("int")
    return F.when(month.between(1, 12), y * 12 + month - 1).when(quarter.isNotNull(), y * 4 + quarter - 1).when(c.rlike(r"^\d{4}$"), y)


def asked_period(c: Column) -> Column:
    """struct(year, month) of the one month a question names, or its one year after in, from, during, for, of or since."""
    q = F.lower(F.coalesce(c, F.lit("")))
    months = F.regexp_extract_all(q, F.lit(rf"\b{MONTH}\b"), F.lit(1))
    month = (F.array_position(F.array(*map(F.lit, MONTHS)), F.substr(F.get(months, F.lit(0)), F.lit(1), F.lit(3)))).cast("int")
    year_near = F.regexp_extract(q, rf"\b{MONTH}\.?,?\s+(20\d{{2}})\b", 2).try_cast("int")
    years = F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), F.lit(1))
    asked = F.regexp_extract(q, r"\b(?:in|from|during|for|of|since)\s+(20\d{2})\b", 1).try_cast("int")
    one_month = F.struct(F.coalesce(year_near, F.lit(0)).alias("year"), month.alias("month"))
    return F.when(F.size(months) == 1, one_month).when((F.size(months) == 0) & (F.size(years) == 1) & asked.isNotNull(), F.struct(asked.alias("year"), F.lit(0).alias("month")))


def in_period(iso: Column, year: Column, month: Column) -> Column:
    y, m = F.substr(iso, F.lit(1), F.lit(4)).try_cast("int"), F.substr(iso, F.lit(6), F.lit(2)).try_cast("int")
    return F.coalesce(((year == 0) | (y == year)) & ((month == 0) | (m == month)), F.lit(False))


def rrule(every: Column) -> Column:
    return F.when(every == "weekly", "FREQ=WEEKLY").when(every == "monthly", "FREQ=MONTHLY").when(every == "quarterly", "FREQ=MONTHLY;INTERVAL=3").when(every == "yearly", "FREQ=YEARLY")
