"""Reports: one question put to many documents, and the HTML of extractions, bulk answers and chat answers.

A report is rows (place, html) in the order of their places, so that one of any length is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.extraction import AMBIGUOUS, MISSING, UNVERIFIED
from quarry.operators.library import listing
from quarry.sources.files import extract_tables

# Fixed values.
ANSWER_FIELD = "Answer"
FLAGS = {AMBIGUOUS: "⚠ ambiguous", UNVERIFIED: "⚠ unverified"}
NO_VALUE = "—"
# Fixed values end.
LEGEND = '<div class="legend">⚠ marks what stands here as it was written; look at the source before relying on it.</div>'


def bulk_answers(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Every target (path, file_name) with its answer's value, status and evidence; a target without one, or a blank one, is MISSING.

    answers: (path, value, status, evidence), one a path. Its value is null where it is missing.
    """
    a = targets.select("path", "file_name").join(answers.select("path", "value", "status", "evidence"), "path", "left")
    blank = T.strip(F.coalesce("value", F.lit(""))) == ""
    status = F.when(blank, MISSING).otherwise(F.coalesce("status", F.lit("OK")))
    return a.select("path", "file_name", F.when(~blank, F.col("value")).alias("value"), status.alias("status"), F.when(~blank, F.col("evidence")).alias("evidence"))


def cell(value: Column, status: Column, evidence: Column) -> Column:
    """A value as a table cell: a dash where it is missing, flagged with its evidence where it is uncertain."""
    shown = T.html_escape(F.coalesce(value, F.lit("")))
    flag = F.when(status == AMBIGUOUS, FLAGS[AMBIGUOUS]).when(status == UNVERIFIED, FLAGS[UNVERIFIED])
    note = F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(F.lit('<div class="note">'), T.html_escape(evidence), F.lit("</div>"))).otherwise("")
    marked = F.concat(F.lit('<td class="ambiguous">'), shown, F.lit('<span class="flag">'), flag, F.lit("</span>"), note, F.lit("</td>"))
    return F.when(F.coalesce(status, F.lit(MISSING)) == MISSING, f'<td class="missing">{NO_VALUE}</td>').when(flag.isNotNull(), marked).otherwise(F.concat(F.lit("<td>"), shown, F.lit("</td>")))


def _td(c: Column, kind: str = "") -> Column:
    return F.concat(F.lit(f'<td class="{kind}">' if kind else "<td>"), T.html_escape(F.coalesce(c, F.lit(""))), F.lit("</td>"))


def _escaped(s: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(raw, safe)
    return s


def _framed(rows: DataFrame, columns: list[str], title: str, subtitle: str | None) -> DataFrame:
    """Head, the rows (path, file_name, tds, uncertain) in the order of name and path, and foot with a legend where one is needed."""
    placed = listing(rows, F.col("file_name").asc_nulls_last(), F.col("path"))
    body = placed.select(F.col("place"), F.concat(F.lit("<tr>"), "tds", F.lit("</tr>")).alias("html"))
    total = placed.agg(F.count("*").alias("n"), F.coalesce(F.max("uncertain"), F.lit(False)).alias("uncertain"))
    sub = F.lit(_escaped(subtitle)) if subtitle else F.concat(F.col("n").cast("string"), F.lit(" document(s)"))
    heads = "".join(f"<th>{_escaped(c)}</th>" for c in columns)
    head = total.select(F.lit(0).cast("long").alias("place"), F.concat(F.lit(f'<!doctype html><html><head><meta charset="utf-8"></head><body><h1>{_escaped(title)}</h1><p>'), sub, F.lit(f"</p><table><thead><tr>{heads}</tr></thead><tbody>")).alias("html"))
    foot = total.select((F.col("n") + 1).alias("place"), F.concat(F.lit("</tbody></table>"), F.when(F.col("uncertain"), LEGEND).otherwise(""), F.lit("</body></html>")).alias("html"))
    return head.unionByName(body).unionByName(foot)


def bulk_report(rows: DataFrame, question: str | None = None, title: str = "Bulk Q&A Report") -> DataFrame:
    """(place, html) of bulk answers: document, answer, source."""
    tds = F.concat(_td(F.col("file_name")), cell(F.col("value"), F.col("status"), F.col("evidence")), _td(F.col("file_name"), "src"))
    subtitle = f"Question: “{question}”" if question else None
    return _framed(rows.select("path", "file_name", tds.alias("tds"), F.col("status").isin(*FLAGS).alias("uncertain")), ["Document", ANSWER_FIELD, "Source"], title, subtitle)


def extraction_report(cells: DataFrame, fields: list[str], title: str = "Extraction Report", subtitle: str | None = None) -> DataFrame:
    """(place, html) of cells (path, file_name, field, value, status, evidence): a row a document, a column a field."""
    c = cells.withColumn("td", cell(F.col("value"), F.col("status"), F.col("evidence"))).withColumn("_u", F.col("status").isin(*FLAGS))
    own = [F.coalesce(F.min(F.when(F.col("field") == f, F.col("td"))), F.lit(f'<td class="missing">{NO_VALUE}</td>')).alias(f"_f{i}") for i, f in enumerate(fields)]
    docs = c.groupBy("path", "file_name").agg(*own, F.max(F.col("_u") & F.col("field").isin(fields)).alias("uncertain"))
    tds = F.concat(*(F.col(f"_f{i}") for i in range(len(fields))), _td(F.col("file_name"), "src"))
    return _framed(docs.select("path", "file_name", tds.alias("tds"), "uncertain"), [*fields, "Source"], title, subtitle)


def _inline(c: Column) -> Column:
    return F.regexp_replace(T.html_escape(c), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def answer_report(answers: DataFrame, id_col: str, text_col: str, sources_col: str) -> DataFrame:
    """(id, html) of chat answers: pipe tables as tables, the rest as paragraphs with bold words, then the sources."""
    row = lambda tag: F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda x: F.concat(F.lit(f"<{tag}>"), T.html_escape(F.coalesce(x, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    t = extract_tables(answers, id_col, text_col).withColumn("tr", F.when(F.col("row") < 0, row("th")).otherwise(row("td")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "tr"))), lambda s: s["tr"]), "")
    tables = t.groupBy(id_col, "table").agg(joined("row").alias("tr")).withColumn("tr", F.concat(F.lit("<table>"), "tr", F.lit("</table>"))).groupBy(id_col).agg(joined("table").alias("tables"))
    a = answers.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t"), F.col(sources_col).alias("_s")).join(tables, id_col, "left")
    prose = F.when(F.col("tables").isNull(), F.col("_t")).otherwise(T.strip(F.regexp_replace("_t", r"(?m)^\s*\|.*$", "")))
    paragraphs = F.filter(F.split(prose, r"\n{2,}"), lambda p: p != "")
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), _inline(p), F.lit("</p>"))), "")
    cites = F.array_join(F.transform(F.coalesce("_s", F.array().cast("array<string>")), lambda s: F.concat(F.lit('<div class="cite">'), T.html_escape(F.coalesce(s, F.lit(""))), F.lit("</div>"))), "")
    return a.select(id_col, F.concat(F.lit('<div class="ans">'), F.coalesce("tables", F.lit("")), body, F.lit("</div>"), cites).alias("html"))
