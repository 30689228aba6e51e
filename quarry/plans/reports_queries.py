"""Queries of compound and bulk questions, reports, reminders, shallow scans and empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import deadlines as D
from quarry.operators import questions as Q
from quarry.operators import reports as R
from quarry.operators import sheets as S
from quarry.plans.library_queries import FILES, files_of
from quarry.plans.registry import query, table

CONTROL = "chr(9) || chr(10) || chr(13) || ' '"


@query(
    f"""WITH t AS (SELECT conv_id AS id, turn, role, max(text) AS text FROM conversations GROUP BY ALL), w AS (SELECT id, arg_min(text, turn) AS whole FROM t WHERE role = 'user' AND text IS NOT NULL GROUP BY id),
p AS (SELECT u.id, u.turn AS n, trim(coalesce(u.text, ''), {CONTROL}) AS part, whole, a.text AS answer, ['s' || u.turn % 3, 'conversation'] AS sources
  FROM t u JOIN w USING (id) LEFT JOIN t a ON a.id = u.id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
f AS (SELECT id, part, min(n) AS n FROM p WHERE part <> '' AND lower(part) <> lower(trim(whole, {CONTROL})) GROUP BY id, part),
k AS (SELECT f.id, f.part, f.n, p.answer, p.sources, row_number() OVER (PARTITION BY f.id ORDER BY f.n, f.part) AS r FROM f JOIN p ON p.id = f.id AND p.part = f.part AND p.n = f.n),
c AS (SELECT id, count(*) AS parts FROM k WHERE r <= 4 GROUP BY id HAVING count(*) >= 2),
told AS (SELECT k.* FROM k JOIN c USING (id) WHERE r <= 4 AND trim(coalesce(answer, ''), {CONTROL}) <> ''),
a AS (SELECT id, string_agg(answer, chr(10) || chr(10) ORDER BY r) AS answer FROM told GROUP BY id),
s AS (SELECT id, source, min(r * 10 + i) AS pos FROM (SELECT id, r, unnest(sources) AS source, unnest([1, 2]) AS i FROM told) GROUP BY ALL),
l AS (SELECT id, string_agg(source, ',' ORDER BY pos) AS sources FROM s GROUP BY id)
SELECT id, parts, answer, l.sources FROM c JOIN a USING (id) JOIN l USING (id)"""
)
def compound_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns as the parts of one message, its assistant's as their answers; the first turn is the message."""
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id"), "turn", "role").agg(F.max("text").alias("text"))
    asked = t.filter("role = 'user'")
    whole = asked.filter("text IS NOT NULL").groupBy("id").agg(F.min_by("text", "turn").alias("whole"))
    told = t.filter("role = 'assistant'").select("id", (F.col("turn") - 1).alias("n"), F.col("text").alias("answer"))
    parts = asked.select("id", F.col("turn").alias("n"), F.col("text").alias("part")).join(whole, "id").join(told, ["id", "n"], "left")
    parts = parts.withColumn("sources", F.array(F.concat(F.lit("s"), (F.col("n") % 3).cast("string")), F.lit("conversation")))
    return Q.compound(parts).select("id", "parts", "answer", F.array_join("sources", ",").alias("sources"))


#: The bulk question's targets are the files of a folder; a third have no answer, or a blank one.
BULK = f"""{FILES}, targets AS (SELECT doc_id, path, file_name FROM files WHERE starts_with(path, '/lib/src3/')),
answers AS (SELECT path, CASE WHEN doc_id % 6 = 1 THEN ' ' ELSE 'Ask <' || file_name || '> & co' END AS value, CASE doc_id % 5 WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'UNVERIFIED' ELSE 'OK' END AS status, CASE WHEN doc_id % 5 = 1 THEN '"' || lang || '"' END AS evidence FROM files WHERE doc_id % 6 <> 0),
bulk AS (SELECT doc_id, t.path, file_name, CASE WHEN trim(coalesce(value, '')) <> '' THEN value END AS value, CASE WHEN trim(coalesce(value, '')) = '' THEN 'MISSING' ELSE status END AS status, CASE WHEN trim(coalesce(value, '')) <> '' THEN evidence END AS evidence FROM targets t LEFT JOIN answers USING (path))"""


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir)
    k = F.col("doc_id")
    answers = f.filter(k % 6 != 0).select(
        "path", F.when(k % 6 == 1, " ").otherwise(F.concat(F.lit("Ask <"), "file_name", F.lit("> & co"))).alias("value"),
        F.when(k % 5 == 1, "AMBIGUOUS").when(k % 5 == 2, "UNVERIFIED").otherwise("OK").alias("status"), F.when(k % 5 == 1, F.concat(F.lit('"'), "lang", F.lit('"'))).alias("evidence"),
    )
    return R.bulk_answers(f.filter(F.col("path").startswith("/lib/src3/")), answers)


@query(f"WITH {BULK} SELECT path, file_name, value, status, evidence FROM bulk")
def bulk_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question put to every file of a folder."""
    return _bulk(spark, sf_dir)


def _esc(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


@query(
    f"""WITH {BULK}, h AS (SELECT *, CASE WHEN status = 'MISSING' THEN '<td class="missing">—</td>' WHEN status = 'OK' THEN '<td>' || {_esc("value")} || '</td>'
  ELSE '<td class="ambiguous">' || {_esc("value")} || '<span class="flag">⚠ ' || lower(status) || '</span>' || CASE WHEN coalesce(evidence, '') <> '' THEN '<div class="note">' || {_esc("evidence")} || '</div>' ELSE '' END || '</td>' END AS td FROM bulk)
SELECT row_number() OVER (ORDER BY file_name, path) AS place, '<tr><td>' || file_name || '</td>' || td || '<td class="src">' || file_name || '</td></tr>' AS html FROM h
UNION ALL SELECT 0, '<!doctype html><html><head><meta charset="utf-8"></head><body><h1>Bulk Q&amp;A Report</h1><p>Question: “Who &lt;pays&gt;?”</p><table><thead><tr><th>Document</th><th>Answer</th><th>Source</th></tr></thead><tbody>'
UNION ALL SELECT count(*) + 1, '</tbody></table>' || CASE WHEN bool_or(status IN ('AMBIGUOUS', 'UNVERIFIED')) THEN '{R.LEGEND}' ELSE '' END || '</body></html>' FROM bulk"""
)
def bulk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bulk_report(_bulk(spark, sf_dir), "Who <pays>?")


#: Entries in five shapes below a root that itself has a denied name.
ENTRIES = """entries AS (SELECT '/target/lib/' || source || CASE doc_id % 8 WHEN 0 THEN '/build/f' WHEN 1 THEN '/.f' WHEN 2 THEN '/Restricted/sub/f' WHEN 3 THEN '/sub/f' WHEN 4 THEN '/.cache/f' ELSE '/f' END || doc_id AS path,
  doc_id % 8 = 6 AS is_dir, doc_id % 24 = 7 AS is_link FROM documents)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 8
    inside = F.when(k == 0, "/build/f").when(k == 1, "/.f").when(k == 2, "/Restricted/sub/f").when(k == 3, "/sub/f").when(k == 4, "/.cache/f").otherwise("/f")
    path = F.concat(F.lit("/target/lib/"), "source", inside, F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), (k == 6).alias("is_dir"), (F.col("doc_id") % 24 == 7).alias("is_link"), "source")


@query(f"WITH {ENTRIES} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, is_dir FROM entries WHERE regexp_matches(path, '^/target/lib/[^/]+/f[0-9]+$') AND NOT is_link")
def shallow_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loose files and subfolders directly in each source's folder."""
    e = _entries(spark, sf_dir)
    return A.shallow(e, e.select(F.concat(F.lit("/target/lib/"), "source").alias("folder")))


@query(f"WITH {ENTRIES} SELECT path, regexp_matches(path, '/build/|/[.]|/Restricted/') AS denied FROM entries")
def denied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a walk from the library's root skips; that the root lies in a folder "target" says nothing."""
    return _entries(spark, sf_dir).select("path", A.denied_under(F.col("path"), F.lit("/target/lib")).alias("denied"))


_FOLD = "CASE WHEN length({0}) <= 75 THEN {0} ELSE substr({0}, 1, 75) || regexp_replace(substr({0}, 76), '(.{{1,74}})', chr(13) || chr(10) || ' \\1', 'g') END"
_TITLE = r"replace(replace('Pay, then; ' || p_name, ',', '\,'), ';', '\;')"


@query(
    f"""WITH e AS (SELECT *, {_TITLE} AS title, '/c/' || p_brand || '/' || p_name || '.pdf' AS path FROM part),
l AS (SELECT p_partkey, 'file://' || replace(path, ' ', '%20') AS link, path, title, DATE '2025-01-01' + CAST(p_partkey % 300 AS INTEGER) AS day, p_size, p_type FROM e),
d AS (SELECT *, replace('DESCRIPTION:' || p_type || '\\nSource: ' || p_size || '.pdf\\n' || link, ',', '\\,') AS about FROM l)
SELECT 'u' || p_partkey AS uid, array_to_string(list_filter(['BEGIN:VEVENT', 'UID:u' || p_partkey, 'DTSTAMP:20250101T000000Z', 'DTSTART:' || strftime(day, '%Y%m%d') || CASE WHEN p_partkey % 2 = 0 THEN 'T233000' ELSE 'T090000' END,
  'DTEND:' || CASE WHEN p_partkey % 2 = 0 THEN strftime(day + 1, '%Y%m%d') || 'T003000' ELSE strftime(day, '%Y%m%d') || 'T100000' END, {_FOLD.format("('SUMMARY:' || title)")}, {_FOLD.format("about")}, {_FOLD.format("('URL:' || link)")},
  CASE p_partkey % 3 WHEN 0 THEN 'RRULE:FREQ=MONTHLY;INTERVAL=3' WHEN 1 THEN 'RRULE:FREQ=YEARLY' END, 'BEGIN:VALARM', 'ACTION:DISPLAY', {_FOLD.format("('DESCRIPTION:' || title)")},
  CASE p_partkey % 4 WHEN 0 THEN 'TRIGGER:PT0S' WHEN 1 THEN 'TRIGGER:-P7D' ELSE 'TRIGGER:-P3D' END, 'END:VALARM', 'END:VEVENT'], lambda x: x IS NOT NULL), chr(13) || chr(10)) AS vevent FROM d WHERE p_partkey % 13 <> 5"""
)
def reminder_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reminders; some dates are none."""
    k = F.col("p_partkey")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int"))
    e = table(spark, sf_dir, "part").select(
        F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.concat(F.lit("Pay, then; "), "p_name").alias("title"), F.col("p_type").alias("description"), F.when(k % 13 == 5, "soon").otherwise(day.cast("string")).alias("due_date"),
        F.when(k % 2 == 0, "23:30").alias("time"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 7).alias("lead_days"), F.when(k % 3 == 0, "QUARTERLY").when(k % 3 == 1, "yearly").alias("recurring"),
        F.concat(F.col("p_size").cast("string"), F.lit(".pdf")).alias("source_file"), F.concat(F.lit("/c/"), "p_brand", F.lit("/"), "p_name", F.lit(".pdf")).alias("source_path"),
    )
    return D.reminders(e, F.lit("2025-01-01 00:00:00").cast("timestamp"))


@query(
    """WITH q AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 3 AS s, c_custkey % 8 > 3 AS obligations FROM customer), n AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
SELECT id, coalesce(n, 0) AS rows, CASE WHEN n IS NULL THEN CASE k WHEN 0 THEN CASE s WHEN 0 THEN 'None of them are marked paid yet.' ELSE 'Nothing outstanding — you''re all settled up.' END
  WHEN 1 THEN CASE WHEN obligations THEN 'No deadlines in that period.' ELSE 'No dates found in that period.' END WHEN 2 THEN 'No matching documents found.' ELSE 'None found.' END END AS message FROM q LEFT JOIN n USING (id)"""
)
def empty_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per customer about their large orders, and what is said where there are none."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, "amounts").when(k % 4 == 1, "dates").when(k % 4 == 2, "documents").otherwise("parties").alias("select"),
        F.when(k % 3 == 0, "paid").when(k % 3 == 1, "unpaid").alias("status"), (k % 8 > 3).alias("obligations"),
    )
    rows = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("id"))
    return S.or_empty(q, rows, "id")
