"""Operators that SQL can't express, and edge cases of those that it can."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import money as M
from quarry.functions import text as T
from quarry.operators import chunking, deadlines, extraction, library, metering, model_port, retrieval, sheets
from quarry.plans.components import components
from quarry.plans.workspace import Workspace, broadcast_if_small
from quarry.sources import files
from quarry.streaming import usage
from tests import plain_dates


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Workspace(spark, "t")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", Workspace(spark, "t")).count() == 0


def test_broadcast_needs_a_checked_size(spark):
    d = spark.range(10)
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(d, limit=10)) and "broadcast" not in plan(broadcast_if_small(d, limit=9))


def test_sentences_and_packing():
    assert chunking.sentences("One. Two! three.\n\n\nFour\nfive.") == ["One.", "Two! three.", "Four", "five."]
    parts = [f"s{i} " + "x" * 95 for i in range(12)]
    got = chunking.pack(parts, 300, 100)
    assert all(len(c) <= 300 for c in got) and got[0].startswith("s0") and got[-1].endswith(parts[-1])
    assert all(any(p in b for p in parts if p in a) for a, b in zip(got, got[1:]))  # neighbours overlap
    assert chunking.pack(["y" * 5000, "z"], 1800, 200) == ["y" * 5000, "z"]
    assert chunking.pack([], 10, 2) == []


def test_events_in_texts():
    find = lambda t, **k: [(e["date"], e["title"]) for e in plain_dates.find_events(t, **k)]
    assert find("Payment due 5 March 2024.") == [("2024-03-05", "Payment due")]
    assert find("The fee was paid on 5 March 2024") == []
    assert find("Date of filing: 01/02/2024") == []
    assert find("Due date: 01/02/2024") == find("due by 01/02/2024") == [("2024-02-01", "Due")]
    assert find("due by 01/02/2024", month_first=True) == [("2024-01-02", "Due")]
    assert find("due by 13/02/2024", month_first=True) == [("2024-02-13", "Due")]
    assert find("expires 2024-02-30, deadline 2024-02-28") == [("2024-02-28", "Expires")]
    assert find("valid until 3rd of June 2031; valid until 3 June 2031") == [("2031-06-03", "Expires")]
    assert find("") == []


def test_primary_dates():
    assert plain_dates.primary_date("GST-Return-Mar2024.pdf", None) == "2024-03-01"
    assert plain_dates.primary_date("scan_2023-07.pdf", "x") == "2023-07-01"
    assert plain_dates.primary_date("a.pdf", "On 1 May 2020 we met. Invoice date: 02.06.2021") == "2021-06-02"
    assert plain_dates.primary_date("a.pdf", "nothing") is None


def test_next_occurrence_drifts(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, D.next_occurrence(d("2023-01-31"), F.lit("monthly"), d("2023-04-01"))) == datetime.date(2023, 4, 28)
    assert one(spark, D.next_occurrence(d("1990-01-01"), F.lit("weekly"), d("2023-04-01"))) == datetime.date(2023, 4, 3)
    assert one(spark, D.next_occurrence(d("2024-02-29"), F.lit("yearly"), d("2030-01-01"))) == datetime.date(2030, 2, 28)


def test_gaps_rules(spark):
    s = spark.createDataFrame([("m", i) for i in (1, 2, 5)] + [("q", i) for i in (0, 3, 9, 12)] + [("two", 0), ("two", 2)] + [("wide", 0), ("wide", 1), ("wide", 9)], "s string, idx int")
    got = {}
    for r in deadlines.gaps(s, ["s"]).collect():
        got.setdefault(r["s"], []).append(r["idx"])
    assert got == {"m": [3, 4], "q": [6], "two": [1]}


def test_relative_cut_and_diversify(spark):
    m = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.9), ("c", 1.0), ("d", 1.1), ("e", 1.2)], "f string, distance double").withColumn("query_id", F.lit(1))
    m = retrieval.with_position(m, "distance")
    cut = retrieval.relative_cut(m)
    assert [r["pos"] for r in cut.orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    assert cut.count() == retrieval.relative_cut(cut).count()
    assert retrieval.relative_cut(m.limit(4)).count() == 2  # fewer than five rows: the cut holds
    assert [r["f"] for r in retrieval.diversify(m, "f").orderBy("slot").collect()] == ["a", "b", "c", "d", "e", "a"]


def test_scope(spark):
    e = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "chunk_id long, file string, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "query_id long, vector array<double>")
    ids = lambda scope: [r["chunk_id"] for r in retrieval.top_k(e, q, scope=scope).orderBy("query_id", "pos").collect()]
    assert ids(None) == [1, 2] and ids(e.filter("file = 'y'").select("file")) == [2] and ids(e.limit(0).select("file")) == []


def test_money_rules(spark):
    p = lambda n, r, s="": {"name": n, "role": r, "side": s}
    a = lambda v, st, label="Total", role="": {"label": label, "value": v, "currency": "USD", "status": st, "role": role}
    me = p("My Firm LLC", "provider")
    rows = [
        (1, "Invoice", [me, p("Acme, Inc.", "client")], [a(100.0, "unpaid")]),
        (2, "Invoice", [me, p("ACME Incorporated Group", "client")], [a(50.0, "unpaid")]),
        (3, "Engagement letter", [me, p("Acme", "client")], [a(9999.0, "due")]),
        (4, "Invoice", [me, p("Bolt", "client")], [a(200.0, "partial"), a(80.0, "outstanding", "Remaining")]),
        (5, "Invoice", [me, p("Cleo", "client")], [a(300.0, "unpaid")]),
        (6, "Payment confirmation", [me, p("Cleo", "client")], [a(300.0, "paid")]),
        (7, "Invoice", [me, p("client", "client")], [a(5.0, "unpaid")]),
        (8, "Invoice", [me, p("Dora", "client")], [a(-10.0, "unpaid"), a(20.0, "refund due", "Refund", "refund")]),
    ]
    party = "array<struct<name:string,role:string,side:string>>"
    s = spark.createDataFrame([(i, t, "", ps, am) for i, t, ps, am in rows], f"ord long, doc_type string, category string, parties {party}, amounts array<struct<label:string,value:double,currency:string,status:string,role:string>>")
    got = {r["party"]: (r["billed"], r["paid"], r["owed"]) for r in sheets.money_table(s, ["my firm"], True).collect()}
    assert got["acme"] == (10099, 9999, 100) and got["bolt"] == (200, 120, 80) and got["cleo"] == (300, 300, 0)
    assert "client" not in got and "my firm" not in got


def test_sheet_parsing(spark):
    raw = spark.createDataFrame([(1, '{"doc_type":"Bill","orgs":[{"name":"A","side":"owed"},{"name":"B","side":"owed_to"}],"amounts":[{"value":"12"},{"value":3.5}]}'), (2, "no json"), (3, None)], "ord long, sheet string")
    got = {r["ord"]: r for r in sheets.parse(raw).collect()}
    assert [x["value"] for x in got[1]["amounts"]] == [3.5] and {x["side"] for x in got[1]["parties"]} == {""}
    assert 3 not in got


def test_amounts(spark):
    amount = lambda s: one(spark, M.parse_amount(F.lit(s)))
    assert [amount(s) for s in ("$1,200.50", "10 + 20", "Rs 5 + Rs 6", "none", "999999999999999999")] == [1201, 30, 11, None, None]
    assert one(spark, M.render(F.lit("₹"), F.lit(12345678))) == "₹1,23,45,678" and one(spark, M.render(F.lit("USD"), F.lit(-1234))) == "USD -1,234"
    assert [one(spark, M.whole(F.lit(s))) for s in ("-1,200.9", ".5", "x")] == [-1200, 0, None]


def test_validation(spark):
    check = lambda k, v: tuple(one(spark, extraction.validate(F.lit(k), F.lit(v), "$")))
    assert check("DATE", "05/06/2024") == ("05/06/2024", "AMBIGUOUS") and check("DATE", "25/06/2024")[1] == "OK"
    assert check("CURRENCY", "1200.456") == ("$1,200.45", "OK") and check("CURRENCY", "lots") == (None, "MISSING")
    assert check("BOOLEAN", "Unpaid") == ("No", "OK") and check("anything", " N/A ") == (None, "MISSING")
    assert one(spark, extraction.isolate_json(F.lit('x [{"a": 1}] y'))) == '[{"a": 1}]' and one(spark, extraction.isolate_json(F.lit("none"))) is None


def test_names(spark):
    assert one(spark, T.short_company(F.lit("Acme Foods Pvt. Ltd."))) == "Acme Foods" and one(spark, T.short_company(F.lit("Acme"))) is None and one(spark, T.short_company(F.lit("Ltd"))) is None
    assert one(spark, T.guard_formula(F.lit("-12.5"))) == "-12.5" and one(spark, T.guard_formula(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, T.csv_cell(F.lit('a"b,c'))) == '"a""b,c"'
    assert one(spark, T.safe_label(F.lit("a\n<b> ==== ```"))) == "a  b  = ="
    assert one(spark, T.folder_name(F.lit(' ..a/b:c*  d. '))) == "..a b c d"


def test_markdown_tables(spark):
    text = "| a | b |\n|---|:-:|\n| 1 | 2 | 3 |\n| x |\n\n```\n| n | o |\n|---|---|\n```\nc | d\n--|--\n5 | 6\\|7"
    assert files.markdown_tables(text) == [(["a", "b"], [["1", "2"], ["x", ""]]), (["c", "d"], [["5", "6|7"]])]
    got = files.extract_tables(spark.createDataFrame([(1, text), (2, None), (3, "a|b")], "id long, text string"), "id", "text")
    assert got.count() == 5


def test_file_scan(spark, tmp_path):
    for name, body in {"a.txt": "hi\r\n\r\n\r\n\r\nyou\x07", "sub/b.md": "b", "empty.txt": "", "node_modules/c.txt": "no", ".git/d.txt": "no", "e.bin": "x"}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body.encode())
    scan = files.scan(spark, [str(tmp_path / "root")], content=True)
    assert {r["file_name"] for r in scan.collect()} == {"a.txt", "b.md", "e.bin"}
    assert {r["file_name"]: r["text"] for r in files.read_text(scan).collect()} == {"a.txt": "hi\n\nyou", "b.md": "b"}
    known = spark.createDataFrame([], "path string, file_name string, size long, mtime long, hash string, status string")
    state = {r["file_name"]: r["state"] for r in library.admit(scan, known).collect()}
    assert state == {"a.txt": "process", "b.md": "process", "e.bin": "unsupported"}
    files.write_csv(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["a"] == "'=x"


def test_floored_counter(spark):
    deltas = [-1, 1, 1, -1, -1, -1, 1, 1, -1]
    got = [r["counter"] for r in metering.floored_sum(spark.createDataFrame(list(enumerate(deltas)), "i int, d int"), [], F.col("d"), "i").orderBy("i").collect()]
    want, n = [], 0
    for d in deltas:
        n = max(0, n + d)
        want.append(n)
    assert got == want


@pytest.mark.parametrize("kind", ["windows", "debounced", "quotas"])
def test_streams(spark, tmp_path, kind):
    t = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = [(i, t(m), 1, "click", float(i)) for i, m in enumerate([0, 0, 1, 30, 59])] + [(9, datetime.datetime(2024, 1, 5), 1, "click", 0.0)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    if kind == "windows":
        out, mode = usage.usage_windows(s), "append"
    elif kind == "debounced":
        out, mode = usage.debounced(s, ["user_id"], "5 minutes"), "append"
    else:
        out, mode = usage.quotas(s.withColumn("delta", F.when(F.col("event_id") == 1, -1).otherwise(1))), "update"
    q = out.writeStream.outputMode(mode).format("memory").queryName(f"t_{kind}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table(f"t_{kind}").collect()
    if kind == "windows":
        assert [(r["n"], r["total"]) for r in got] == [(5, 10.0)]
    elif kind == "debounced":
        assert sorted(r["n"] for r in got) == [1, 1, 3]
    else:
        assert {(r["day"], r["counter"]) for r in got} == {("2024-01-01", 3), ("2024-01-05", 1)}


def test_model_port(spark):
    d = spark.createDataFrame([(1, "q1"), (2, "q2")], "id long, p string")
    assert {r["reply"] for r in model_port.ask(d, "p", lambda xs: [x.upper() for x in xs]).collect()} == {"Q1", "Q2"}
    s = spark.createDataFrame([("From a.pdf: 5.", "a.pdf"), ("From a.pdf: 5.", "ba.pdf"), ("Which one?", "x.pdf"), ("All done.", "y.pdf")], "answer string, name string")
    assert {(r["answer"], r["name"]) for r in model_port.cited(s, "answer", "name").collect()} == {("From a.pdf: 5.", "a.pdf"), ("All done.", "y.pdf")}
    assert one(spark, model_port.scrub(F.lit("In the excerpts. " + model_port.REFUSAL))) == "In your files."
    assert [one(spark, model_port.summary_plan(F.lit(n))) for n in (5, 61, 400, 9000)] == [1, 2, 4, 4]


def test_entry_without_llm():
    """The entry module adds the llm queries only if their folder is there."""
    import importlib.util

    import __spark_entry__ as entry

    names = set(entry.queries())
    assert len([n for n in names if not n.startswith("op") and n != "pipeline"]) >= 80
    assert bool([n for n in names if n.startswith("op")]) == (importlib.util.find_spec("quarry.llm") is not None)


def test_near_vectors_in_blocks(spark, monkeypatch):
    """Against all pairs: small blocks, copies, opposite and zero vectors, clusters and sums."""
    import numpy as np

    from quarry.operators import vectors as V

    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 150)] + 0.25 * rng.normal(size=(150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[140:] = x[:10]
    x[77] = 0
    rows = [(int(i) + 1, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame([*rows, (900, None)], "id long, v array<double>")
    dist = np.round(1 - np.clip(x @ x.T, -1, 1), 6)
    for limit in (0.02, 0.1, 0.6):
        near = (dist <= limit) & ~np.eye(len(x), dtype=bool)
        same = np.array([[(a == b).all() for b in x] for a in x])
        klass = [int(np.flatnonzero(r)[0]) + 1 for r in same]
        assert {r["id"]: (r["class"], r["links"]) for r in V.near_links(d, "id", "v", limit).collect()} == {i + 1: (klass[i], int(near[i].sum())) for i in range(len(x))}
        up = list(range(len(x)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in zip(*np.nonzero(near)):
            p, q = root(int(a)), root(int(b))
            up[max(p, q)] = min(p, q)
        assert {r["id"]: r["cluster"] for r in V.clusters(d, "id", "v", limit).collect()} == {i + 1: root(i) + 1 for i in range(len(x))}
        sums: dict = {}
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            sums.setdefault(root(int(a)) + 1, []).append(dist[a, b])
        got = {r["cluster"]: r for r in V.cohesion(d, "id", "v", limit).collect()}
        assert got.keys() == sums.keys()
        for k, v in sums.items():
            assert (got[k]["links"], got[k]["widest"]) == (len(v), max(v)) and got[k]["mean"] == pytest.approx(sum(v) / len(v), abs=1.1e-6)
    firsts = [i for i in range(len(x)) if klass[i] == i + 1]
    want = {(i + 1, j + 1) for i in firsts for j in firsts if i < j and dist[i, j] <= 0.1}
    assert {(r["a"], r["b"]) for r in V.near_pairs(d, "id", "v", 0.1).collect()} == want
    assert V.near_links(d.limit(0), "id", "v", 0.1).count() == V.clusters(d.limit(0), "id", "v", 0.1).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)).round(1)
    x[50:60] = x[7]
    d = spark.createDataFrame([(int(i), f"f{i % 4}", v.tolist()) for i, v in enumerate(x)] + [(500, "f0", None), (501, "f0", [0.0] * 5), (502, "f0", [1.0])], "chunk_id long, file string, embedding array<double>").repartition(5)
    q = d.filter("chunk_id % 10 = 7 and chunk_id < 120").select(d.chunk_id.alias("query_id"), d.embedding.alias("vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = np.round(1 - np.clip(u @ u.T, -1, 1), 6)
    got: dict = {}
    for r in retrieval.top_k(d, q, k=9).collect():
        got.setdefault(r["query_id"], {})[r["pos"]] = (r["chunk_id"], r["distance"])
    for i in range(7, 120, 10):
        want = sorted(range(120), key=lambda j: (dist[i, j], j))[:9]
        assert [got[i][p] for p in range(1, 10)] == [(j, pytest.approx(dist[i, j], abs=1e-9)) for j in want]


def test_repeated_dates_by_steps(spark):
    """Against steps of one period: late days, leap years, and series of a hundred years."""
    import datetime as dt

    from quarry.functions import dates as D

    def add(d, months):
        y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
        last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day
        return dt.date(y, m + 1, min(d.day, last))

    days = [dt.date(y, m, k) for y in (1891, 1896, 1996, 2023) for m, k in ((1, 29), (1, 30), (1, 31), (2, 28), (3, 31), (5, 31), (8, 30), (12, 31), (6, 15))] + [dt.date(1896, 2, 29), dt.date(2000, 2, 29), dt.date(2030, 1, 31)]
    rows = [(d, e) for d in days for e in ("weekly", "monthly", "quarterly", "yearly", "none")]
    for today in (dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(1996, 3, 1)):
        got = spark.createDataFrame(rows, "d date, e string").select("d", "e", D.next_occurrence(F.col("d"), F.col("e"), F.lit(today)).alias("n")).collect()
        for d, e, n in got:
            want = d
            while e != "none" and want < today:
                want = want + dt.timedelta(7) if e == "weekly" else add(want, {"monthly": 1, "quarterly": 3, "yearly": 12}[e])
            assert n == want, (d, e, today)


def test_pages_in_parts(spark, monkeypatch):
    import random
    import re

    rng = random.Random(4)
    monkeypatch.setattr(chunking, "PAGE_PART", 5)
    monkeypatch.setattr(chunking, "CHUNK_PART", 4)
    pages, chunks = [], []
    for f in ("a", "b", None):
        texts = [" ".join(rng.choice(["Tax", "bill", "of", "May", "12", "x"]) for _ in range(rng.randrange(0, 30))) for _ in range(23)]
        pages += [(f, i + 1, t) for i, t in enumerate(texts)]
        chunks += [(f, i, rng.choice([" ".join(texts[i : i + 2])[5:], texts[i], "not found anywhere at all", "", "é!"])) for i in range(22)]
    squash = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    want = {}
    for f, i, t in chunks:
        flat = squash(t)
        if flat and f:
            own = [(p, squash(x)) for g, p, x in pages if g == f]
            ends = []
            for cut, pick in ((lambda n: flat[:n], min), (lambda n: flat[-n:], max)):
                hits = next((h for n in (60, 44, 28, 12) if (h := [p for p, x in own if cut(n) in x])), None)
                ends.append(pick(hits) if hits else None)
            want[f, i] = tuple(ends)
    got = chunking.locate_pages(spark.createDataFrame(chunks, "f string, chunk_index long, text string"), spark.createDataFrame(pages, "f string, page long, text string"), "f")
    assert {(r["f"], r["chunk_index"]): (r["page_start"], r["page_end"]) for r in got.filter("f is not null").collect()} == want


def test_file_predicates_and_sinks(spark, tmp_path):
    assert [one(spark, files.needs_ocr(F.lit(c), F.lit(p))) for c, p in ((50, 1), (500, 2), (0, 0))] == [True, False, False]
    events = spark.createDataFrame([("u1", "BEGIN:VEVENT\r\nUID:u1\r\nEND:VEVENT")], "uid string, vevent string")
    files.write_calendar(events, str(tmp_path / "calendar"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "calendar")).collect())
    assert text.startswith("BEGIN:VCALENDAR") and "UID:u1" in text and "END:VCALENDAR" in text
    rows = spark.createDataFrame([("<b>", 1), (None, 2)], "a string, b int")
    assert {r["html"] for r in files.html_report(rows, ["a", "b"]).collect()} == {"<tr><td>&lt;b&gt;</td><td>1</td></tr>", "<tr><td></td><td>2</td></tr>"}


def test_fence(spark):
    got = one(spark, model_port.fence(F.lit("a<b>\n"), F.lit("text << end"), F.lit("n1")))
    assert got.startswith("<<n1 ") and got.endswith("\n<<end n1>>") and "<b>" not in got


def test_library_tables(spark):
    from quarry.operators import questions

    f = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4")], "path string, hash string")
    v = lambda rows: spark.createDataFrame(rows, "path string, vec array<double>")
    cached = spark.createDataFrame([("a", "h1", "m", [1.0], 3), ("b", "old", "m", [2.0], 3), ("c", "h3", "other", [3.0], 3)], "path string, hash string, model string, vec array<double>, chunks int")
    got = library.file_vectors(f, cached, v([("a", [9.0]), ("b", [4.0])]), v([("b", [8.0]), ("c", [5.0])]), "m").collect()
    assert {(r["path"], r["vec"][0], r["name_only"]) for r in got} == {("a", 1.0, False), ("b", 4.0, False), ("c", 5.0, True)}
    assert [r["path"] for r in library.current_model(cached, "m").orderBy("path").collect()] == ["a", "b"]
    t = spark.createDataFrame([(1, " ", None), (2, "x", None)], "id int, series string, period string")
    assert [r["id"] for r in library.clear_blank(t, ["series", "period"]).collect()] == [2]
    states = spark.createDataFrame([("a", "INDEXED"), ("b", "FAILED")], "path string, status string")
    assert library.reset_if_drifted(states, f).count() == 2 and library.reset_if_drifted(states, f.limit(0)).count() == 1
    q = F.col("q")
    rows = spark.createDataFrame([("in general, what does Sharma owe",), ("what is his daughter's PAN",), ("all clients please",), (None,)], "q string")
    assert [r[0] for r in rows.select(questions.broadens(q, q.contains("Sharma"))).collect()] == [False, True, True, False]
