"""Clients, injection and reorganisation: edge cases against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarry.operators import clients as C
from quarry.operators import injection as I
from quarry.operators import reorg as R


def found(text: str, key: str) -> bool:
    hay = re.sub(r"[ \t\n\r]+", " ", text or "").strip().lower()
    return re.search(r"(?<![^\W_])" + re.escape(key) + r"(?![^\W_])", hay) is not None


def test_identifiers_occur_as_whole_words(spark):
    names = [(1, "Verma Textiles LLP", ["29ABCDE1234F1Z5"]), (2, "M/s  Gupta & Sons", None), (3, "Ab", ["é à"]), (4, "(Rao) Foods", ["x"]), (5, None, None)]
    idents = C.identifiers(spark.createDataFrame(names, "client_id long, name string, aliases array<string>"))
    keys = {(r["client_id"], r["norm"]) for r in idents.collect()}
    assert keys == {(1, "verma textiles llp"), (1, "verma textiles"), (1, "29abcde1234f1z5"), (2, "m/s gupta & sons"), (2, "m/s gupta"), (3, "é à"), (4, "rao) foods")}
    rng = random.Random(4)
    pieces = ["Verma", "textiles", "LLP", "m/s", "gupta", "&", "sons", "é", "à", "(Rao)", "foods", "29abcde1234f1z5", "vermas", "_x", "\n", ", "]
    texts = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "&"), (903, "verma textiles" + " y" * 30_000)]
    got = {(r["id"], r["client_id"]) for r in C.matches(spark.createDataFrame(texts, "id long, t string"), idents, "id", "t").collect()}
    assert got == {(i, c) for i, t in texts for c, k in keys if found(t, k)} and (903, 1) in got
    assert C.matches(spark.createDataFrame(texts, "id long, t string"), idents.limit(0), "id", "t").count() == 0


def test_membership_and_scope(spark):
    clients = spark.createDataFrame([(1, "Verma Textiles"), (2, "Verma Exports"), (3, "Orion Pvt Ltd"), (4, "Orion Private Limited")], "client_id long, name string")
    idents = C.identifiers(clients)
    docs = spark.createDataFrame([(1, "for Verma Exports only"), (2, "Verma Exports and Verma Textiles"), (3, "nothing"), (4, "verma textiles"), (5, None)], "id long, t string")
    pins = spark.createDataFrame([(4, 9)], "id long, client_id long")
    got = {r["id"]: (r["client_id"], r["state"]) for r in C.membership(docs, idents, pins, "id", "t").collect()}
    assert got == {1: (2, "assigned"), 2: (None, "conflicted"), 3: (None, "unmatched"), 4: (9, "pinned"), 5: (None, "unmatched")}
    q = [(1, "what about exports?", False, None, False), (2, "Verma?", False, None, False), (3, "orion bills", False, None, False), (4, "and his PAN?", False, 7, True), (5, "in general, Verma Exports", True, 7, True), (6, "hello", False, 7, False)]
    q = spark.createDataFrame(q, "id long, t string, broaden boolean, focus long, continues boolean")
    got = {r["id"]: (r["scope"], r["client_id"]) for r in C.resolve(q, C.question_matches(q, idents, "id", "t"), clients, "id").collect()}
    assert got == {1: ("SCOPED", 2), 2: ("CLARIFY", None), 3: ("SCOPED", 3), 4: ("SCOPED", 7), 5: ("NONE", None), 6: ("NONE", None)}


def test_injection_needs_its_question(spark):
    files = spark.createDataFrame([(1, "GuptaNotice.pdf", 5, None, "Gupta A"), (2, "template_notice.docx", 9, None, None), (3, "x.pdf", 7, "Notice", "Gupta B"), (4, "fee tracker.csv", 2, None, "gupta b"), (5, None, 8, None, None)], "f long, file_name string, size long, doc_type string, entity string")
    pool = spark.createDataFrame([(1, 9), (2, 3)], "query_id long, f long")
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id long, question string")
    ids = lambda d: [r["f"] for r in d.orderBy("query_id", "place").collect()]
    assert ids(I.by_kind(pool, files, ask("which notices?"), "f")) == [3, 1] and ids(I.by_kind(pool, files, ask("hello"), "f")) == []
    assert ids(I.by_entity(pool, files, ask("are all the Guptas the same?"), "f")) == [3, 1] and ids(I.by_entity(pool, files, ask("gupta"), "f")) == []
    assert ids(I.ledgers(pool, files, ask("what is unpaid?"), "f")) == [4] and ids(I.ledgers(pool, files, ask("what?"), "f")) == []


def test_pair_checks_do_not_depend_on_blocks(spark):
    rng = random.Random(1)
    words = ["tax", "return", "gst", "IMG"]
    rows = []
    for i in range(60):
        v = [rng.gauss(0, 1) for _ in range(3)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((f"g{i % 4}", i, " ".join(rng.sample(words, rng.randint(1, 3))) + f"{i}.pdf", [x / n for x in v]))
    rows.append(("alone", 99, "img.png", [1.0, 0.0, 0.0]))
    m = spark.createDataFrame(rows, "group string, id long, file_name string, vec array<double>")
    tok = lambda n: {t for t in re.findall("[a-z]{3,}", n.rsplit(".", 1)[0].lower()) if t not in R.NOISE}
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        want[g] = (len(own), round(min([sum(x * y for x, y in zip(a[3], b[3])) for a, b in pairs] or [1.0]), 6), all(tok(a[2]) & tok(b[2]) for a, b in pairs))
    for block in (4, 512):
        assert {r["group"]: (r["members"], r["least"], r["share"]) for r in R.pair_checks(m, block).collect()} == want


def test_destinations_scope_and_loners(spark):
    p = spark.createDataFrame([(1, "Tax: 2024"), (2, "TAX 2024"), (3, "bills"), (4, " .Bills. ")], "ord long, name string")
    got = {r["ord"]: (r["destination"], r["is_new"]) for r in R.destinations(p, spark.createDataFrame([("Bills",)], "folder string")).collect()}
    assert got == {1: ("Tax 2024", True), 2: ("Tax 2024", True), 3: ("Bills", False), 4: (".Bills", True)}
    d = spark.createDataFrame([("a", 50), ("b", 51), ("c", 99)], "folder string, decisions long")
    s = spark.createDataFrame([("b", "x", 3), ("b", "y", 9), ("b", "z", 4), ("b", "w", 0), ("c", "v", 0)], "folder string, sub string, files long")
    assert {r["folder"]: r["hints"] for r in R.scope(d, s).collect()} == {"a": None, "b": ["y (9)", "z (4)"], "c": []}
    j = spark.createDataFrame([("solo", 1, 0.79, True), ("two", 2, 0.9, False), ("two", 3, 0.85, True), ("mix", 4, 0.61, True), ("mix", 5, 0.59, True)], "folder string, id long, confidence double, has_preview boolean")
    assert {r["folder"]: (r["files"], r["overrides"]) for r in R.judge_loners(j).collect()} == {"two": (2, True), "mix": (1, False)}
    names = spark.createDataFrame([("Screenshot 2024.png",), ("AADHAR2022_front.JPG",), (None,), (".env",)], "n string")
    assert [r[0] for r in names.select(R.name_tokens(F.col("n"))).collect()] == [[], ["aadhar", "front"], [], ["env"]]
