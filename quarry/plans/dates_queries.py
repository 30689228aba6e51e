"""Queries on dates: orders stand in for deadlines and dated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.operators import date_scan as S
from quarry.operators import deadlines as L
from quarry.plans.registry import query, table

TODAY = "1998-08-01"


def _today() -> Column:
    return F.lit(TODAY).cast("date")


DEADLINES = """
deadlines AS (SELECT o_orderkey AS id, '/c/' || o_custkey AS path, 'Order ' || o_orderpriority AS title, CASE WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_date,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PENDING' ELSE 'DISMISSED' END AS status, CASE o_orderkey % 6 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'quarterly' WHEN 3 THEN 'yearly' ELSE 'none' END AS recurring FROM orders)
"""


def _deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("path"), F.concat(F.lit("Order "), "o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due_date"),
        F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DISMISSED").alias("status"),
        F.when(k == 0, "weekly").when(k == 1, "monthly").when(k == 2, "quarterly").when(k == 3, "yearly").otherwise("none").alias("recurring"),
    )




@query(f"""WITH {DEADLINES} SELECT id, due_date, CASE WHEN due_date = 'soon' THEN 'NO_DATE' ELSE CASE WHEN CAST(due_date AS DATE) < DATE '{TODAY}' THEN 'OVERDUE' WHEN CAST(due_date AS DATE) <= DATE '{TODAY}' + 7 THEN 'DUE_SOON' ELSE 'UPCOMING' END END AS bucket
FROM (SELECT id, due_date FROM deadlines)""".replace("CAST(due_date AS DATE)", "TRY_CAST(due_date AS DATE)"))
def timeline_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.buckets(_deadlines(spark, sf_dir), _today()).select("id", "due_date", "bucket")


@query(f"""WITH {DEADLINES}, b AS (SELECT status, date_diff('day', DATE '{TODAY}', TRY_CAST(due_date AS DATE)) AS days FROM deadlines)
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'DONE') AS done, count(*) FILTER (WHERE status = 'DISMISSED') AS dismissed,
  count(*) FILTER (WHERE days < 0) AS overdue, count(*) FILTER (WHERE days BETWEEN 0 AND 7) AS due_soon, count(*) FILTER (WHERE days IS NULL) AS no_date FROM b""")
def deadline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven counters in one pass."""
    b = L.buckets(_deadlines(spark, sf_dir), _today())
    n = lambda c, name: F.count_if(c).alias(name)
    s, k = F.col("status"), F.col("bucket")
    return b.agg(F.count("*").alias("total"), n(s == "PENDING", "pending"), n(s == "DONE", "done"), n(s == "DISMISSED", "dismissed"), n(k == "OVERDUE", "overdue"), n(k == "DUE_SOON", "due_soon"), n(k == "NO_DATE", "no_date"))


@query(
    f"""WITH RECURSIVE {DEADLINES}, d AS (SELECT id, status, recurring, TRY_CAST(due_date AS DATE) AS due, due_date FROM deadlines),
kept AS (SELECT * FROM d WHERE NOT coalesce(recurring = 'none' AND due < DATE '{TODAY}' AND (status <> 'PENDING' OR due < DATE '{TODAY}' - 60), false)),
roll(id, recurring, due) AS (SELECT id, recurring, due FROM kept WHERE recurring <> 'none' AND due < DATE '{TODAY}' UNION ALL
  SELECT id, recurring, CAST(CASE recurring WHEN 'weekly' THEN due + 7 WHEN 'monthly' THEN due + INTERVAL 1 MONTH WHEN 'quarterly' THEN due + INTERVAL 3 MONTH ELSE due + INTERVAL 1 YEAR END AS DATE) FROM roll WHERE due < DATE '{TODAY}'),
r AS (SELECT id, max(due) AS due FROM roll GROUP BY id)
SELECT kept.id, CASE WHEN r.due IS NOT NULL THEN CAST(r.due AS VARCHAR) ELSE kept.due_date END AS due_date, status, recurring FROM kept LEFT JOIN r ON r.id = kept.id"""
)
def recurring_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.maintain(_deadlines(spark, sf_dir), _today()).select("id", "due_date", "status", "recurring")


DATES = "dates AS (SELECT '/c/' || l_suppkey * 13 % 1500 AS path, strftime(l_shipdate, '%Y-%m-%d') AS event_date, min('Shipment ' || l_returnflag) AS title FROM lineitem GROUP BY 1, 2)"


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("/c/"), (F.col("l_suppkey") * 13 % 1500).cast("string")).alias("path"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("event_date")).agg(F.min(F.concat(F.lit("Shipment "), "l_returnflag")).alias("title"))


SERIES = """
series AS (SELECT DISTINCT 'c' || o_custkey AS series, strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS idx FROM orders),
g AS (SELECT *, idx - lag(idx) OVER (PARTITION BY series ORDER BY idx) AS gap, count(*) OVER (PARTITION BY series) AS n FROM series),
s AS (SELECT *, CASE WHEN n >= 3 THEN min(gap) OVER (PARTITION BY series) ELSE 1 END AS step FROM g),
x AS (SELECT series, unnest(range(idx - gap + step, idx, step)) AS idx FROM s WHERE gap > step AND gap % step = 0 AND gap / step - 1 <= 4),
missing AS (SELECT series, idx FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY idx) AS rn FROM x) WHERE rn <= 8)
"""


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    return L.gaps(o.select("series", D.period_index(F.col("period")).alias("idx")), ["series"])


@query(f"WITH {SERIES} SELECT series, CAST(idx AS BIGINT) AS idx FROM missing")
def series_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir).select("series", F.col("idx").cast("long").alias("idx"))


@query(
    f"""WITH {DEADLINES}, {DATES}, {SERIES}, dismissed AS (SELECT 'date|' || path || '|' || event_date AS item_key FROM dates WHERE path LIKE '%7' UNION SELECT 'missing|' || series || '|' || idx FROM missing WHERE idx % 2 = 0),
d AS (SELECT 'deadline:' || id AS item_key, path, title, due_date AS day FROM deadlines WHERE status = 'PENDING' AND date_diff('day', DATE '{TODAY}', TRY_CAST(due_date AS DATE)) BETWEEN -60 AND 0),
t AS (SELECT 'date|' || path || '|' || event_date AS item_key, path, title, event_date AS day FROM dates WHERE date_diff('day', DATE '{TODAY}', CAST(event_date AS DATE)) BETWEEN -60 AND 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.path = dates.path AND d.day = dates.event_date)),
m AS (SELECT 'missing|' || series || '|' || idx AS item_key, NULL AS path, series || ' ' || idx AS title, NULL AS day FROM missing),
u AS (SELECT * FROM d UNION ALL SELECT * FROM (SELECT * FROM t UNION ALL SELECT * FROM m) WHERE item_key NOT IN (SELECT item_key FROM dismissed))
SELECT item_key, path, title, day, CASE WHEN day = '{TODAY}' THEN 'DUE_TODAY' WHEN day < '{TODAY}' THEN 'OVERDUE' ELSE 'MISSING' END AS bucket FROM u"""
)
def deadlines_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = _dates(spark, sf_dir)
    missing = _missing(spark, sf_dir).select("series", F.col("idx").cast("string").alias("period"))
    dismissed = dates.filter("path like '%7'").select(F.concat_ws("|", F.lit("date"), "path", "event_date").alias("item_key")).union(missing.filter("cast(period as int) % 2 = 0").select(F.concat_ws("|", F.lit("missing"), "series", "period").alias("item_key")))
    return L.attention(_deadlines(spark, sf_dir), dates, missing, dismissed, _today()).select("item_key", "path", "title", "day", "bucket")


@query(
    f"""WITH {DEADLINES}, {DATES}, u AS (SELECT path, due_date AS day, title, 0 AS source FROM deadlines UNION ALL SELECT path, event_date, title, 1 FROM dates),
w AS (SELECT * FROM u WHERE date_diff('day', DATE '{TODAY}', TRY_CAST(day AS DATE)) BETWEEN -60 AND 180),
r AS (SELECT *, row_number() OVER (PARTITION BY path, day ORDER BY source, title) AS rn FROM w) SELECT path, day, title, source FROM r WHERE rn = 1 ORDER BY day, path LIMIT 30"""
)
def obligations_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.obligations(_deadlines(spark, sf_dir), _dates(spark, sf_dir), _today())


TEXTS = """
texts AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Amount due by ' || strftime(o_orderdate, '%d/%m/%Y') || '. Thank you.' WHEN 1 THEN 'Filed on ' || strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN 'Nothing to report' WHEN 3 THEN 'please respond within ' || o_custkey % 30 || ' days' WHEN 4 THEN 'Valid until ' || day(o_orderdate) || ' March 2004' WHEN 5 THEN 'the 3rd of the month' WHEN 6 THEN 'Budget 2031' ELSE 'see you next week' END AS text FROM orders)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    d = F.col("o_orderdate")
    text = (
        F.when(k == 0, F.concat(F.lit("Amount due by "), F.date_format(d, "dd/MM/yyyy"), F.lit(". Thank you.")))
        .when(k == 1, F.concat(F.lit("Filed on "), F.date_format(d, "yyyy-MM-dd")))
        .when(k == 2, "Nothing to report")
        .when(k == 3, F.concat(F.lit("please respond within "), (F.col("o_custkey") % 30).cast("string"), F.lit(" days")))
        .when(k == 4, F.concat(F.lit("Valid until "), F.dayofmonth(d).cast("string"), F.lit(" March 2004")))
        .when(k == 5, "the 3rd of the month")
        .when(k == 6, "Budget 2031")
        .otherwise("see you next week")
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


M = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


@query(
    rf"""WITH {TEXTS} SELECT id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b') THEN 'numeric-date' END, CASE WHEN regexp_matches(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') THEN 'iso-date' END,
  CASE WHEN regexp_matches(text, '\b(\d{{1,2}}\s+{M}|{M}\.?\s+\d{{1,2}})\b', 'i') THEN 'month-name' END, CASE WHEN regexp_matches(text, '\bthe\s+\d{{1,2}}(?:st|nd|rd|th)\b', 'i') THEN 'ordinal-day' END,
  CASE WHEN regexp_matches(text, '\b20\d{{2}}\b') THEN 'bare-year' END,
  CASE WHEN regexp_matches(text, '\b(within\s+\d+\s+(?:day|week|month|year)s?|next\s+(?:week|month|quarter|year)|in\s+\d+\s+(?:day|week|month)s?|q[1-4]\b)', 'i') THEN 'relative-date' END,
  CASE WHEN regexp_matches(text, '\b(due|valid\s+until|respond|by\s+the|filed?\s+by)\b', 'i') THEN 'trigger-word' END], lambda x: x IS NOT NULL), ',') AS reasons FROM texts"""
)
def deadline_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which date shapes and trigger words a text has."""
    return _texts(spark, sf_dir).select("id", F.array_join(D.date_reasons(F.col("text")), ",").alias("reasons"))


@query(
    f"""WITH {TEXTS} SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Payment due' AS title FROM orders WHERE o_orderkey % 8 = 0 AND year(o_orderdate) >= 2000
UNION ALL SELECT o_orderkey, '2004-03-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0'), 'Expires' FROM orders WHERE o_orderkey % 8 = 4"""
)
def date_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced dates: "amount due", "valid until"; past tense ("filed on") is none."""
    return S.scan_events(_texts(spark, sf_dir), "id", "text").select("id", "date", "title")


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, TRY_CAST((year(o_orderdate) + 10) || strftime(o_orderdate, '-%m-%d') AS DATE) AS day FROM orders)
SELECT id, '2024-03-05' AS date, 'Payment due' AS title, 'Payment due 5 March 2024!' AS excerpt FROM t WHERE k = 0
UNION ALL SELECT id, '2024-02-01', 'Filing due', 'file by 2024-02-30, or file by 01/02/2024 or so' FROM t WHERE k = 1
UNION ALL SELECT id, '2031-06-03', 'Expires', repeat('word ', 21) || 'expires on 3rd of June 2031 ' || trim(repeat('tail ', 19)) FROM t WHERE k = 2
UNION ALL SELECT id, '2026-05-06', 'Expires', 'renewed on 1 May 2025; valid till May 6, 2026' FROM t WHERE k = 4
UNION ALL SELECT id, strftime(day, '%Y-%m-%d'), 'Deadline', strftime(day, 'The deadline (firm) %d/%m/%Y is near.') FROM t WHERE k = 5 AND day IS NOT NULL"""
)
def date_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced dates with the sentences around them."""
    k = F.col("o_orderkey") % 6
    d = F.col("o_orderdate")
    text = (
        F.when(k == 0, "Dear R., see Rs. 500. Payment due 5 March 2024! Thanks.")
        .when(k == 1, "Note no. 7:\nfile by 2024-02-30, or file by 01/02/2024 or so")
        .when(k == 2, F.concat(F.repeat(F.lit("word "), F.lit(60)), F.lit("expires on 3rd of June 2031 "), F.repeat(F.lit("tail "), F.lit(60))))
        .when(k == 3, "The fee was paid on 5 March 2024")
        .when(k == 4, "renewed on 1 May 2025; valid till May 6, 2026")
        .otherwise(F.concat(F.lit("Hello!\tThe deadline  (firm) "), F.date_format(d, "dd/MM/"), (F.year(d) + 10).cast("string"), F.lit(" is near.")))
    )
    return S.scan_events(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")


@query(
    """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, month(o_orderdate) AS m, year(o_orderdate) + 10 AS y, TRY_CAST((year(o_orderdate) + 10) || strftime(o_orderdate, '-%m-%d') AS DATE) AS day FROM orders)
SELECT id, CASE k WHEN 0 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' WHEN 1 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' WHEN 2 THEN coalesce(strftime(day, '%Y-%m-%d'), '2021-06-02') WHEN 3 THEN '2020-05-01' WHEN 5 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' END AS date FROM t"""
)
def primary_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's own date: from its name, after a cue, or the first of its opening."""
    k = F.col("o_orderkey") % 7
    d = F.col("o_orderdate")
    year = (F.year(d) + 10).cast("string")
    name = F.when(k == 0, F.concat(F.lit("GST-Return-"), F.date_format(d, "MMM"), year, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("scan_"), year, F.date_format(d, "-MM"), F.lit(".pdf"))).when(k == 6, F.lit(None)).otherwise("a1.pdf")
    text = (
        F.when(k == 2, F.concat(F.lit("On 1 May 2020 we met. Dated: soon. Invoice date: "), F.date_format(d, "dd.MM."), year, F.lit(", issued on 02.06.2021")))
        .when(k == 3, "We met on 1 May 2020, then on 2020-04-01.")
        .when(k == 4, F.concat(F.repeat(F.lit("x"), F.lit(2000)), F.lit(" dated 1 May 2020")))
        .when(k == 5, F.concat(F.lit("Statement period "), F.date_format(d, "MMMM"), F.lit(" "), year))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.primary_date(name, text).alias("date"))


@query(
    rf"""WITH {DEADLINES} SELECT 'u' || id AS uid, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:u' || id || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || replace(due_date, '-', '') || chr(13) || chr(10) || 'SUMMARY:' || title || chr(13) || chr(10) ||
  CASE recurring WHEN 'weekly' THEN 'RRULE:FREQ=WEEKLY' || chr(13) || chr(10) WHEN 'monthly' THEN 'RRULE:FREQ=MONTHLY' || chr(13) || chr(10) WHEN 'quarterly' THEN 'RRULE:FREQ=MONTHLY;INTERVAL=3' || chr(13) || chr(10) WHEN 'yearly' THEN 'RRULE:FREQ=YEARLY' || chr(13) || chr(10) ELSE '' END || 'END:VEVENT' AS vevent
FROM deadlines WHERE due_date <> 'soon'"""
)
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.calendar(_deadlines(spark, sf_dir).filter("due_date <> 'soon'").withColumn("uid", F.concat(F.lit("u"), F.col("id").cast("string"))))


@query(
    r"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) ELSE 0 END ELSE 2005 END AS year, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN month(o_orderdate) ELSE 0 END AS month
FROM orders"""
)
def asked_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month with its year (years before 2000 are none), a bare year after "from", and two months (no period)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    q = F.when(k == 0, F.concat(F.lit("Invoices of "), F.date_format("o_orderdate", "MMMM yyyy"))).when(k == 1, "all bills from 2005").otherwise("January or February bills")
    p = D.asked_period(q)
    return o.select(F.col("o_orderkey").alias("id"), p["year"].cast("long").alias("year"), p["month"].cast("long").alias("month"))


