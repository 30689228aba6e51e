"""Amounts, currencies and digit grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
MAX_AMOUNT = 1e14
# An amount in prose has a currency before it, or digits in groups.
PROSE_AMOUNT = r"(?i)(?:(?:₹|£|\$|€|\brs\.?\s*|\binr\s*|\busd\s*|\bgbp\s*|\beur\s*)([0-9][0-9,]*)|([0-9]{1,3}(?:,[0-9]{2,3})+))(?:\.[0-9]+)?"
# Fixed values end.


def _plausible(s: Column) -> Column:
    v = F.regexp_replace(s, ",", "").try_cast("double")
    return F.when((v >= 0) & (v <= MAX_AMOUNT), F.floor(v + 0.5).cast("long"))


def parse_amount(c: Column) -> Column:
    """The first number, or the sum of a pure chain "a + b"; null if any is out of bounds."""
    numbers = F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))
    chain = c.rlike(rf"^\s*[^0-9+]*{NUMBER}(?:\s*\+\s*[^0-9+]*{NUMBER})+\s*$")
    values = F.transform(numbers, _plausible)
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(c.isNull() | (F.size(numbers) == 0), F.lit(None).cast("long")).when(chain, total).otherwise(F.get(values, F.lit(0)))


def parse_currency(c: Column) -> Column:
    """What stands before the first digit, without brackets; empty if longer than six characters."""
    lead = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^([^0-9]+)[0-9]", 1)
    cur = F.trim(F.regexp_replace(F.trim(lead), r"^[\(\[\{:;,-]+|[\(\[\{:;,-]+$", ""))
    return F.when(F.length(cur) > 6, "").otherwise(cur)


def western(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")


def indian(v: Column) -> Column:
    """Three digits, then pairs."""
    return F.regexp_replace(v.cast("string"), r"(?<=\d)(?=(?:\d{2})*\d{3}$)", ",")


def render(currency: Column, v: Column) -> Column:
    """The symbol attached, letters with a blank; rupees in Indian grouping."""
    cur = F.trim(F.coalesce(currency, F.lit("")))
    num = F.when((cur == "₹") | cur.rlike(r"(?i)^(rs\.?|inr|rupees?)$"), indian(v)).otherwise(western(v))
    return F.when(cur == "", num).when(cur.rlike("[A-Za-z]"), F.concat_ws(" ", cur, num)).otherwise(F.concat(cur, num))


def whole(c: Column) -> Column:
    """The integer part of whatever digits there are, negative if the text begins with a minus."""
    digits = F.regexp_replace(c, r"[^0-9.\-]", "")
    part = F.regexp_replace(F.regexp_extract(digits, r"^([^.]*)", 1), "-", "")
    v = F.when(part == "", F.lit("0")).otherwise(part).try_cast("long")
    return F.when(digits != "", F.when(F.ltrim(c).startswith("-"), -v).otherwise(v))


def fraction(c: Column) -> Column:
    """Up to two decimals, as text."""
    frac = F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"[^0-9.]", ""), r"\.(.*)$", 1), r"\D", "")
    return F.when(frac != "", F.substr(frac, F.lit(1), F.lit(2)))


def prose_amount(c: Column) -> Column:
    """The first amount in a text, in whole units: of digits alone, with a currency before it, or in groups; else null."""
    digits = F.regexp_replace(F.concat(F.regexp_extract(c, PROSE_AMOUNT, 1), F.regexp_extract(c, PROSE_AMOUNT, 2)), ",", "")
    return F.when(F.trim(c).rlike("^[0-9]{1,15}$"), F.trim(c).try_cast("long")).otherwise(digits.try_cast("long"))
