"""Compound and bulk questions, reports, reminders, shallow scans and empty results on literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import analysis as A
from quarry.operators import deadlines as D
from quarry.operators import questions as Q
from quarry.operators import reports as R
from quarry.operators import sheets as S


def test_compound_parts(spark):
    one = lambda i, n, part, answer, *sources: (i, "How many AND who?", n, part, answer, list(sources))
    rows = [
        one(1, 0, " how many ", "Three.", "a", "b"), one(1, 1, "who", "Bo.", "b", "c"), one(1, 2, "who", "again", "z"), one(1, 3, " ", "blank", "z"), one(1, 4, "how many and WHO?", "whole", "z"),
        one(2, 0, "only", "x"), one(3, 0, "p", None, "a"), one(3, 1, "q", " ", "b"), one(5, 0, "p", None, "a"), one(5, 1, "q", "said", "b"), (6, None, 0, None, None, None), (6, None, 1, "m", "1", None), (6, None, 2, "n", "2", ["y"]),
    ] + [one(4, n, f"p{n}", str(n), "s") for n in range(6)]
    got = {r["id"]: (r["parts"], r["answer"], r["sources"]) for r in Q.compound(spark.createDataFrame(rows, "id long, whole string, n int, part string, answer string, sources array<string>")).collect()}
    assert got == {1: (2, "Three.\n\nBo.", ["a", "b", "c"]), 4: (4, "0\n\n1\n\n2\n\n3", ["s"]), 5: (2, "said", ["b"]), 6: (2, "1\n\n2", ["y"])}


def test_bulk_answers_and_reports(spark):
    targets = spark.createDataFrame([("/b", "b.pdf"), ("/a", "a.pdf"), ("/c", None), ("/d", "d.pdf")], "path string, file_name string")
    answers = spark.createDataFrame([("/a", "<x>", "AMBIGUOUS", "e&"), ("/b", " ", "OK", None), ("/d", "y", None, None), ("/z", "not asked", "OK", None)], "path string, value string, status string, evidence string")
    rows = R.bulk_answers(targets, answers)
    assert sorted((r["path"], r["value"], r["status"]) for r in rows.collect()) == [("/a", "<x>", "AMBIGUOUS"), ("/b", None, "MISSING"), ("/c", None, "MISSING"), ("/d", "y", "OK")]
    html = [r["html"] for r in R.bulk_report(rows).orderBy("place").collect()]
    assert len(html) == 6 and "<p>4 document(s)</p>" in html[0] and "Bulk Q&amp;A Report" in html[0] and "legend" in html[-1]
    assert html[1] == '<tr><td>a.pdf</td><td class="ambiguous">&lt;x&gt;<span class="flag">⚠ ambiguous</span><div class="note">e&amp;</div></td><td class="src">a.pdf</td></tr>'
    assert html[2] == '<tr><td>b.pdf</td><td class="missing">—</td><td class="src">b.pdf</td></tr>' and html[4].startswith("<tr><td></td>")
    assert [r["html"] for r in R.bulk_report(rows.limit(0)).orderBy("place").collect()][1] == "</tbody></table></body></html>"
    cells = spark.createDataFrame([("/a", "a", "No", "7", "OK", None), ("/a", "a", "Day", "1/2", "UNVERIFIED", None), ("/b", "b", "Other", "x", "AMBIGUOUS", None)], "path string, file_name string, field string, value string, status string, evidence string")
    html = [r["html"] for r in R.extraction_report(cells, ["No", "Day"], subtitle="s").orderBy("place").collect()]
    assert "<th>No</th><th>Day</th><th>Source</th>" in html[0] and "<p>s</p>" in html[0]
    assert html[1:3] == ['<tr><td>7</td><td class="ambiguous">1/2<span class="flag">⚠ unverified</span></td><td class="src">a</td></tr>', '<tr><td class="missing">—</td><td class="missing">—</td><td class="src">b</td></tr>']
    assert "legend" in html[3] and "legend" not in [r["html"] for r in R.extraction_report(cells.filter("file_name = 'b'"), ["No"]).orderBy("place").collect()][2]


def test_answer_report(spark):
    text = "Intro **b<**\n\n| a | b |\n|---|---|\n| 1 | <2> |\n| 3 | 4 |\n\nend"
    rows = spark.createDataFrame([(1, text, ["x.pdf", "a&b"]), (2, "one\n\ntwo **w**", []), (3, None, None), (4, "| no table", None)], "id int, text string, sources array<string>")
    got = {r["id"]: r["html"] for r in R.answer_report(rows, "id", "text", "sources").collect()}
    assert got[1] == '<div class="ans"><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr><tr><td>3</td><td>4</td></tr></table><p>Intro <strong>b&lt;</strong></p><p>end</p></div><div class="cite">x.pdf</div><div class="cite">a&amp;b</div>'
    assert got[2] == '<div class="ans"><p>one</p><p>two <strong>w</strong></p></div>' and got[3] == '<div class="ans"></div>' and got[4] == '<div class="ans"><p>| no table</p></div>'


def test_folding_and_reminders(spark):
    one = lambda s: spark.range(1).select(T.ics_fold(F.lit(s))).first()[0]
    for n in (0, 1, 75, 76, 149, 150, 300):
        s, want = "x" * n, ["x" * min(n, 75)]
        want += [" " + s[i : i + 74] for i in range(75, n, 74)]
        assert one(s) == "\r\n".join(want)
    rows = [("a", None, None, "2024-02-29", None, None, "QUARTERLY", "f.pdf", "/d/my f.pdf"), ("b", "t", "x\ny", "soon", None, 1, None, None, None), ("c", "t;1", "x\ny", "2024-12-31", "23:30", 0, "none", None, None)]
    df = spark.createDataFrame(rows, "uid string, title string, description string, due_date string, time string, lead_days int, recurring string, source_file string, source_path string")
    got = {r["uid"]: r["vevent"].split("\r\n") for r in D.reminders(df, F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()}
    assert got["a"] == ["BEGIN:VEVENT", "UID:a", "DTSTAMP:20240102T030405Z", "DTSTART:20240229T090000", "DTEND:20240229T100000", "SUMMARY:Reminder", "DESCRIPTION:Source: f.pdf\\nfile:///d/my%20f.pdf", "URL:file:///d/my%20f.pdf", "RRULE:FREQ=MONTHLY;INTERVAL=3", "BEGIN:VALARM", "ACTION:DISPLAY", "DESCRIPTION:Reminder", "TRIGGER:-P3D", "END:VALARM", "END:VEVENT"]
    assert set(got) == {"a", "c"} and got["c"][4:7] == ["DTEND:20250101T003000", "SUMMARY:t\\;1", "DESCRIPTION:x\\ny"] and "TRIGGER:PT0S" in got["c"] and not any(x.startswith(("URL", "RRULE")) for x in got["c"])


def test_shallow_scan_and_denied_names(spark):
    names = ["a.txt", ".h", "Thumbs.db", "sub/b.txt", "Target/c", "ok/.x/d", "ok/RESTRICTED/e", "thumbs.db", "target"]
    rows = [("/target/r/" + n,) for n in names] + [("/elsewhere/build/x",), (None,)]
    got = {r["path"]: r["d"] for r in spark.createDataFrame(rows, "path string").select("path", A.denied_under(F.col("path"), F.lit("/target/r/")).alias("d")).collect()}
    assert [got["/target/r/" + n] for n in names] == [False, True, True, False, True, True, True, False, False] and got["/elsewhere/build/x"] is True and got[None] is None
    entries = [("/r/a", False, False), ("/r/.h", False, None), ("/r/Thumbs.db", False, None), ("/r/Build", True, None), ("/r/s", True, None), ("/r/l", False, True), ("/r/s/x", False, None), ("/q/x", False, None), ("/r/target", False, None)]
    e = spark.createDataFrame(entries, "path string, is_dir boolean, is_link boolean")
    assert sorted(tuple(r) for r in A.shallow(e, spark.createDataFrame([("/r",), ("/r",)], "folder string")).collect()) == [("/r", "/r/a", False), ("/r", "/r/s", True), ("/r", "/r/target", False)]


def test_empty_messages(spark):
    want = [
        ("amounts", "paid", False, "None of them are marked paid yet."), ("amounts", "unpaid", False, "Nothing outstanding — you're all settled up."), ("amounts", None, None, "Nothing outstanding — you're all settled up."), ("dates", "", True, "No deadlines in that period."),
        ("dates", "", None, "No dates found in that period."), ("documents", None, True, "No matching documents found."), ("parties", None, False, "None found."), ("parties", None, False, None),
    ]
    q = spark.createDataFrame([(i, *w[:3]) for i, w in enumerate(want)], "id int, select string, status string, obligations boolean")
    got = {r["id"]: (r["rows"], r["message"]) for r in S.or_empty(q, spark.createDataFrame([(7,), (7,), (99,)], "id int"), "id").collect()}
    assert got == {i: (0 if w[3] else 2, w[3]) for i, w in enumerate(want)}
