"""Deadlines: buckets, rolling, attention, gaps in periodic series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators.library import undismissed

LATE_DAYS = 60
MAX_GAP, MAX_PER_SERIES = 4, 8


def buckets(deadlines: DataFrame, today: Column) -> DataFrame:
    """days and bucket of each deadline's due_date (ISO text)."""
    due = F.when(D.is_iso(F.col("due_date")), F.try_to_date("due_date", "yyyy-MM-dd"))
    return deadlines.withColumn("days", F.datediff(due, today)).withColumn("bucket", D.due_bucket(F.col("days")))


def maintain(deadlines: DataFrame, today: Column) -> DataFrame:
    """Recurring ones roll forward; one-time past ones go if done, dismissed or over 60 days late."""
    due = F.try_to_date("due_date", "yyyy-MM-dd")
    late = F.datediff(today, due)
    one_time = F.coalesce(F.col("recurring"), F.lit("none")) == "none"
    gone = one_time & (late > 0) & (F.col("status").isin("DONE", "DISMISSED") | (late > LATE_DAYS))
    kept = deadlines.filter(~F.coalesce(gone, F.lit(False)))
    rolled = F.date_format(D.next_occurrence(due, F.col("recurring"), today), "yyyy-MM-dd")
    return kept.withColumn("due_date", F.when(~one_time & (late > 0), rolled).otherwise(F.col("due_date")))


def attention(deadlines: DataFrame, dates: DataFrame, missing: DataFrame, dismissed: DataFrame, today: Column) -> DataFrame:
    """What needs attention: due today, then overdue (latest first), then missing documents.

    Pending deadlines and dates from 60 days ago to today; a deadline wins over
    a date of the same path and day; dismissals hide dates and missing ones.
    """
    window = lambda c: F.datediff(F.try_to_date(c, "yyyy-MM-dd"), today).between(-LATE_DAYS, 0)
    d = deadlines.filter((F.col("status") == "PENDING") & window("due_date")).select(F.concat(F.lit("deadline:"), F.col("id").cast("string")).alias("item_key"), "path", "title", F.col("due_date").alias("day"))
    t = dates.filter(window("event_date")).select(F.concat_ws("|", F.lit("date"), "path", "event_date").alias("item_key"), "path", "title", F.col("event_date").alias("day"))
    t = t.join(d.select("path", "day"), ["path", "day"], "left_anti").select(d.columns)
    m = missing.select(F.concat_ws("|", F.lit("missing"), "series", "period").alias("item_key"), F.lit(None).cast("string").alias("path"), F.concat_ws(" ", "series", "period").alias("title"), F.lit(None).cast("string").alias("day"))
    shown = d.unionByName(undismissed(t.unionByName(m), dismissed, "item_key"))
    gap = F.datediff(F.try_to_date("day", "yyyy-MM-dd"), today)
    return shown.withColumn("bucket", F.when(gap == 0, "DUE_TODAY").when(gap < 0, "OVERDUE").otherwise("MISSING")).withColumn("rank", F.when(gap == 0, 0).when(gap < 0, 1).otherwise(2))


def obligations(deadlines: DataFrame, dates: DataFrame, today: Column, most: int = 30) -> DataFrame:
    """The next obligations of -60 to +180 days, deadlines before dates on the same path and day."""
    both = deadlines.select("path", F.col("due_date").alias("day"), "title", F.lit(0).alias("source")).unionByName(dates.select("path", F.col("event_date").alias("day"), "title", F.lit(1).alias("source")))
    both = both.filter(F.datediff(F.try_to_date("day", "yyyy-MM-dd"), today).between(-LATE_DAYS, 180))
    best = both.groupBy("path", "day").agg(F.min_by(F.struct("title", "source"), F.struct("source", "title")).alias("b")).select("path", "day", "b.*")
    return best.orderBy("day", "path").limit(most)


def gaps(series: DataFrame, keys: list[str]) -> DataFrame:
    """Missing periods of each series: aligned to its smallest step (if three or more periods are there), in gaps of up to four; eight per series."""
    s = series.select(*keys, F.col("idx")).filter("idx is not null").distinct()
    w = W.partitionBy(*keys)
    s = s.withColumn("gap", F.col("idx") - F.lag("idx").over(w.orderBy("idx"))).withColumn("n", F.count("*").over(w))
    s = s.withColumn("step", F.when(F.col("n") >= 3, F.min("gap").over(w)).otherwise(F.lit(1)))
    holes = s.filter((F.col("gap") > F.col("step")) & (F.col("gap") % F.col("step") == 0) & (F.col("gap") / F.col("step") - 1 <= MAX_GAP))
    miss = holes.select(*keys, F.explode(F.sequence(F.col("idx") - F.col("gap") + F.col("step"), F.col("idx") - F.col("step"), F.col("step"))).alias("idx"))
    return miss.withColumn("rn", F.row_number().over(w.orderBy("idx"))).filter(F.col("rn") <= MAX_PER_SERIES).drop("rn")


def calendar(events: DataFrame) -> DataFrame:
    """A VEVENT text per (uid, title, due_date, recurring), lines ended by CRLF and folded at 75 characters."""
    day = F.regexp_replace("due_date", "-", "")
    rule = D.rrule(F.col("recurring"))
    fold = lambda c: F.regexp_replace(c, r"(.{73})(?=.)", "$1\r\n ")
    lines = F.array_compact(F.array(F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.concat(F.lit("DTSTART;VALUE=DATE:"), day), fold(F.concat(F.lit("SUMMARY:"), T.ics_escape(F.col("title")))), F.concat(F.lit("RRULE:"), rule), F.lit("END:VEVENT")))
    return events.select("uid", F.array_join(lines, "\r\n").alias("vevent"))


def reminders(events: DataFrame, made_at: Column) -> DataFrame:
    """(uid, vevent): whole VEVENTs with an hour's time, a link to the source and an alarm, lines folded at 75 characters.

    events: (uid, title, description, due_date, time, lead_days, recurring, source_file, source_path). Without a time it is
    nine o'clock, without lead days three, without a title "Reminder". Rows whose date is none have no event.
    """
    at = F.try_to_timestamp(F.concat_ws(" ", "due_date", F.coalesce("time", F.lit("09:00"))), F.lit("yyyy-MM-dd HH:mm"))
    e = events.withColumn("_at", at).filter("_at IS NOT NULL")
    stamp = lambda c, end="": F.date_format(c, f"yyyyMMdd'T'HHmmss{end}")
    title = T.ics_escape(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("Reminder"))
    link = F.when(F.coalesce("source_path", F.lit("")) != "", F.concat(F.lit("file://"), F.replace(F.replace(F.replace(F.col("source_path"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit('"'), F.lit("%22"))))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    about = T.ics_escape(F.concat_ws("\n", some(F.col("description")), F.concat(F.lit("Source: "), some(F.col("source_file"))), link))
    lead = F.greatest(F.lit(0), F.coalesce("lead_days", F.lit(3)))
    of = lambda name, c: F.concat(F.lit(name + ":"), c)
    lines = F.array(
        F.lit("BEGIN:VEVENT"), of("UID", F.col("uid")), of("DTSTAMP", stamp(made_at, "'Z'")), of("DTSTART", stamp(F.col("_at"))), of("DTEND", stamp(F.col("_at") + F.expr("INTERVAL 1 HOUR"))),
        of("SUMMARY", title), of("DESCRIPTION", about), of("URL", link), of("RRULE", D.rrule(F.lower("recurring"))), F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), of("DESCRIPTION", title),
        of("TRIGGER", F.when(lead > 0, F.concat(F.lit("-P"), lead.cast("string"), F.lit("D"))).otherwise("PT0S")), F.lit("END:VALARM"), F.lit("END:VEVENT"),
    )
    return e.select("uid", F.array_join(F.transform(F.array_compact(lines), T.ics_fold), "\r\n").alias("vevent"))


def tabs(items: DataFrame) -> DataFrame:
    """Items of the two tabs: open (pending, with a date) and reminded (done, or with a reminder set); one may be on both."""
    dated = F.col("bucket").isin("OVERDUE", "DUE_SOON", "UPCOMING")
    on = F.array(F.when((F.col("status") == "PENDING") & dated, "open"), F.when((F.col("status") == "DONE") | F.coalesce("reminder_set", F.lit(False)), "reminded"))
    return items.withColumn("tab", F.explode(F.filter(on, lambda t: t.isNotNull())))
