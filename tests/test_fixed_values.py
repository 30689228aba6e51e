"""Fixed values against literals, and operators on the cases that departed from them."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import extraction, library, model_port, questions, retrieval, sheets, vectors


def values(spark, rows, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_extension_families(spark):
    want = {
        "document": ["a.pdf", "a.DOCX", "b.pages", "c.epub", "d.tex", "e.md"], "image": ["a.heif", "b.ico", "c.RAW", "d.cr2", "e.nef", "f.tif", "g.heic"], "video": ["a.m4v", "b.flv", "c.wmv", "d.mpeg"],
        "audio": ["a.opus", "b.wma", "c.aac"], "archive": ["a.tgz", "b.bz2", "c.xz", "d.iso", "e.dmg"], "code": ["a.kt", "b.swift", "c.scala", "d.php", "e.lua", "f.r", "g.jsx", "h.hpp", "i.rb"],
        "sheet": ["a.numbers", "b.ods", "c.tsv"], "slides": ["a.odp", "b.key"], "other": ["a.html", "b.css", "c.zzz", "noext", ".bashrc", "trailing."],
    }
    names = [(n, k) for k, ns in want.items() for n in ns]
    assert values(spark, names, "n string, k string", "n", T.extension_family(F.col("n")), T.extension(F.col("n"))) == [(n, k, n.rpartition(".")[2].lower() if "." in n[1:] and n[-1] != "." else "") for n, k in names]


def test_compatible_by_extension_outside_of_families(spark):
    files = spark.createDataFrame([("f1", "x.zzz"), ("f2", "y.qqq"), ("f3", "noext"), ("f4", "a.docx")], "file string, file_name string")
    folders = spark.createDataFrame([("g1", "y.qqq"), ("g2", "b.pdf"), ("g3", "plain")], "folder string, file_name string")
    assert {tuple(r) for r in questions.compatible_files(files, folders).collect()} == {("f2", "g1"), ("f4", "g2"), ("f3", "g3")}


def test_admission_lists(spark):
    skipped = ["node_modules", "target", "build", "dist", "out", "bin", "obj", "venv", "__pycache__", "vendor", "Pods", "bower_components", "coverage", "Library", ".git", ".venv"]
    supported = "pdf docx doc txt md xlsx xls pptx ppt odt ods odp html htm rtf csv jpg jpeg png tif tiff bmp webp gif".split()
    rows = [(f"/a/{d}/x.pdf", "x.pdf", 1, 1, "h") for d in skipped] + [(f"/a/b/x.{e}", f"x.{e}", 1, 1, "h") for e in [*supported, "tsv", "json", "xml", "yaml", "log", "properties", "exe"]] + [("/a/library/Out.pdf", "Out.pdf", 1, 1, "h")]
    known = spark.createDataFrame([], "path string, mtime long, hash string, status string")
    got = {r["path"]: r["state"] for r in library.admit(spark.createDataFrame(rows, "path string, file_name string, size long, mtime long, hash string"), known).collect()}
    assert {p for p, s in got.items() if s == "skipped"} == {f"/a/{d}/x.pdf" for d in skipped}
    assert {p for p, s in got.items() if s == "unsupported"} == {f"/a/b/x.{e}" for e in ("tsv", "json", "xml", "yaml", "log", "properties", "exe")}


def test_placeholder_names(spark):
    party = "array<struct<name:string,role:string,side:string>>"
    rows = [([(n, "client", "owes"), ("Real Person", "client", "owes")],) for n in ("Policyholder", "account holder", "N.A.", "The Client", "Payer", "me", "Recipient, Inc.")]
    got = values(spark, rows, f"p {party}", sheets.counterparty(sheets._facts(F.col("p"), []), True))
    assert got == [("Real Person",)] * len(rows)


def test_refusals_and_scrubbing(spark):
    said = ["I could not find relevant information in your files.", "i could NOT find relevant information in your files", " Sorry — I could not find relevant information in your files. ", "It is red. " * 12 + "I could not find relevant information in your files.", "I couldn't find that in your files.", "", None]
    assert [r[0] for r in values(spark, [(x,) for x in said], "a string", model_port.is_refusal(F.col("a")))] == [True, True, True, False, False, False, False]
    pairs = [
        ("From a.pdf:\n- works at Sprinklr.\nI could not find relevant information in your files.", "From a.pdf:\n- works at Sprinklr."),
        ("I could not find relevant information in your files.", "I could not find relevant information in your files."),
        ("here is a fact. I couldn't find relevant information in your files.", "here is a fact."),
        ("something useful. I cannot find relevant information in your files.", "something useful."),
        ("From the excerpts, R. is a designer.", "From your files, R. is a designer."),
        ("The excerpts do not mention it.", "Your files do not mention it."),
        ("Based on the provided excerpts, the rent is 40,000.", "Based on your files, the rent is 40,000."),
        ("these excerpts provided show two resumes.", "Your files show two resumes."),
        (None, None),
    ]
    assert values(spark, pairs, "a string, b string", model_port.scrub(F.col("a")), "b") == [(b, b) for _, b in pairs]


def test_templates_stay_if_asked_for(spark):
    f = spark.createDataFrame([("resume_Template.docx",), ("lease.pdf",), ("sample-invoice.pdf",)], "file_name string")
    kept = lambda q: {r[0] for r in retrieval.drop_templates(f, "file_name", q).collect()}
    for q in ("show me the templates", "list the examples", "any SAMPLES?", "the demo", "blank forms", "boilerplate"):
        assert len(kept(q)) == 3, q
    assert kept("Which lease is longest?") == {"lease.pdf"}


def test_names_are_compared_normalised(spark):
    t = spark.createDataFrame([("acme", 5), ("beta", 7)], "party string, billed long")
    assert [r["party"] for r in sheets.compare_parties(t, ["Acme Inc.", "The Beta Group"]).collect()] == ["beta", "acme"]
    assert sheets.compare_parties(t, []).count() == 0


def test_shared_tokens_are_stems(spark):
    m = spark.createDataFrame([(1, "GST Returns May.pdf"), (1, "gst-return-june.pdf"), (2, "a.pdf")], "id long, name string")
    assert {tuple(r) for r in questions.common_name_tokens(m, "id", "name").collect()} == {(1, "return")}


def test_nullish_words_of_replies(spark):
    reply = '{"documents":[{"doc":1,"series":"none","period":"2024-01","entity":"N/A"},{"doc":2,"series":"rent","period":"null","entity":"Z"},{"doc":3,"series":"rent","period":"2024"}]}'
    got = extraction.parse_documents(spark.createDataFrame([(1, reply)], "id long, reply string"), "reply").collect()
    assert [(r["doc"], r["series"], r["period"], r["entity"]) for r in got] == [(2, None, None, "Z"), (3, "rent", "2024", None)]


def test_first_seen_firm(spark):
    party = "array<struct<name:string,role:string,side:string>>"
    s = spark.createDataFrame([(1, [("Zeta", "provider", "")]), (2, [("Alpha", "biller", "")]), (3, [("Zeta", "issuer", "")]), (4, [("Alpha", "provider", "")])], f"ord long, parties {party}")
    assert [tuple(r) for r in sheets.owner_firm(s).collect()] == [("Zeta", 2)]


def test_whole_listing(spark):
    rows = [(i, random.Random(i).randint(0, 50)) for i in range(3000)]
    got = {r["id"]: r["place"] for r in library.listing(spark.createDataFrame(rows, "id long, x int").repartition(7), F.desc("x"), F.col("id")).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


BAD = [[1.0, 2.0], None, [], [0.0, 0.0, 0.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 2.0], [1.0, None, 2.0], [1.0, 2.0, 3.0, 4.0]]


@pytest.mark.parametrize("at", [0, 4, 9])
@pytest.mark.parametrize("bad", [0, 1, 4, 6, 7])
def test_search_beside_malformed_vectors(spark, at, bad):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=3).tolist() for _ in range(9)]
    rows = [(i, v) for i, v in enumerate(good)]
    rows.insert(at, (100, BAD[bad]))
    chunks = spark.createDataFrame([(i, "f", v) for i, v in rows], "chunk_id long, file string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, good[0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan")] * 3)], "query_id long, vector array<double>")
    got = [(r["query_id"], r["chunk_id"]) for r in retrieval.top_k(chunks, asked, 5).orderBy("query_id", "pos").collect()]
    x = np.array(good) / np.linalg.norm(good, axis=1, keepdims=True)
    want = sorted((round((1 - float(x[0] @ y)) * 1e6), i) for i, y in enumerate(x))[:5]
    assert got == [(1, i) for _, i in want] + ([(2, 100)] if bad == 0 else [])


def test_near_vectors_beside_malformed_ones(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(20, 3))
    good /= np.linalg.norm(good, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(BAD + BAD)]
    random.Random(4).shuffle(rows)
    e = spark.createDataFrame(rows, "id long, v array<double>")
    near = {(a, b) for a, b in itertools.combinations(range(20), 2) if round((1 - float(good[a] @ good[b])) * 1e6) <= 300_000}
    links = {r["id"]: r["links"] for r in vectors.near_links(e, "id", "v", 0.3).collect()}
    for i in range(20):
        assert links[i] == sum(i in p for p in near)
    assert all(n == 0 for i, n in links.items() if i >= 100 and BAD[(i - 100) % 8] != [0.0, 0.0, 0.0])
    assert {(r["a"], r["b"]) for r in vectors.near_pairs(e, "id", "v", 0.3).collect()} == near
    assert vectors.clusters(e, "id", "v", 0.3).count() == len([1 for _, v in rows if v is not None])
    folders = spark.createDataFrame([(7, good[0].tolist()), (8, [1.0, 2.0]), (9, None)], "folder long, vec array<double>")
    fits = {r["id"]: r["folder"] for r in vectors.best_folder(e.select("id", F.col("v").alias("vec")), folders, 0.9).collect()}
    assert fits[0] == 7 and fits[100] == 8 and set(fits.values()) == {7, 8}
