"""Spanning forests, gated clusters, folder profiles, and plans, against brute force."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import analysis, reorg, spanning

MEMBERS = "group string, id long, file_name string, vec array<double>, name_only boolean"


def kruskal(rows, distance):
    """The forest of one group by Kruskal over all pairs."""
    edges = []
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        if a[3] is None or b[3] is None or not any(a[3]) or not any(b[3]):
            continue
        x, y = np.array(a[3]) / np.linalg.norm(a[3]), np.array(b[3]) / np.linalg.norm(b[3])
        micro = round((1 - max(-1, min(1, float(x @ y)))) * 1e6)
        tokens = lambda n: set(re.findall("[a-z]{3,}", n.rsplit(".", 1)[0].lower())) - set(reorg.NOISE)
        if micro <= round(distance * 1e6) and (not (a[4] or b[4]) or tokens(a[2]) & tokens(b[2])):
            edges.append((micro, a[1], b[1]))
    up = {r[1]: r[1] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for micro, a, b in sorted(edges):
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
            out.append((a, b, micro))
    return set(out), {x: root(x) for x in up}


def members(seed=1):
    rng = np.random.default_rng(seed)
    names = ["tax return", "tax bill", "lease", "IMG_1", "lease copy", "return"]
    rows = []
    for g, n in (("x", 40), ("y", 7), ("z", 1), ("w", 25)):
        for i in range(n):
            v = rng.normal(size=4) if i % 9 else np.zeros(4)
            rows.append((g, len(rows) * 3 + 5, f"{names[int(rng.integers(6))]}.pdf", None if i % 11 == 10 else v.tolist(), bool(rng.random() < 0.4)))
    rows += [("x", 1000, "lease.pdf", rows[1][3], False), ("x", 1001, "lease.pdf", rows[1][3], False)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_forests(spark, block):
    rows = members()
    m = spark.createDataFrame(rows, MEMBERS)
    got = {(r["group"], r["a"], r["b"], r["micro"]) for r in spanning.forest(m, 0.4, block=block).collect()}
    want, roots = set(), {}
    for g in {r[0] for r in rows}:
        tree, root = kruskal([r for r in rows if r[0] == g], 0.4)
        want |= {(g, *e) for e in tree}
        roots |= root
    assert got == want
    c = {r["id"]: (r["cluster"], r["widest"]) for r in spanning.clusters(m, 0.4, block=block).collect()}
    assert {i: x[0] for i, x in c.items()} == roots
    for i, (root, widest) in c.items():
        own = [e[3] for e in want if roots[e[1]] == root]
        assert widest == max(own, default=0) / 1e6
    spans = {r["group"]: r for r in spanning.cohesion(m, 0.6, block=block).collect()}
    for g in "xyzw":
        own = [r for r in rows if r[0] == g]
        n = len(own) - len(kruskal(own, 0.4)[0])
        assert (spans[g]["members"], spans[g]["trees"], spans[g]["spans"]) == (len(own), n, n <= 1 or any(r[3] is None for r in own))


def test_profiles(spark):
    rows = [("/t/tax/2024/q1/a.pdf", [1.0, 0.0]), ("/t/tax/b.txt", [0.0, 1.0]), ("/t/tax/.git/c.pdf", [9.0, 0.0]), ("/t/tax/build/d.pdf", [9.0, 0.0]), ("/t/tax/1/2/3/4/deep.pdf", [9.0, 0.0]), ("/t/tax/Thumbs.db", None), ("/t/tax/x.zzz", None), ("/t/build/e.pdf", [5.0, 5.0])]
    got = {r["folder"]: r for r in analysis.profiles(spark.createDataFrame(rows, "path string, vec array<double>")).collect()}
    tax = got["/t/tax"]
    assert (tax["files"], tax["families"]) == (3, [".zzz", "document"]) and np.allclose(tax["vec"], [2**-0.5, 2**-0.5])
    assert np.allclose(got["/t/build"]["vec"], [2**-0.5, 2**-0.5])  # what is above the profiled folder doesn't count
    many = spark.range(500).select(F.format_string("/h/%04d.md", F.col("id")).alias("path"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    h = next(r for r in analysis.profiles(many).collect() if r["folder"] == "/h")
    assert h["files"] == 200 and np.isclose(h["vec"][0] / h["vec"][1], np.mean(range(200)))


FILES = "id long, path string, vec array<double>, name_only boolean"


def _unit(angle):
    return [float(np.cos(np.radians(angle))), float(np.sin(np.radians(angle)))]


def test_analysis_and_plan(spark):
    rows = [
        (1, "/t/Tax/a.pdf", _unit(0), False), (2, "/t/Tax/b.pdf", _unit(4), False), (3, "/t/Pics/p.png", _unit(0), False),
        (10, "/t/fits.docx", _unit(10), False), (11, "/t/noise.zzz", _unit(1), False), (12, "/t/none.pdf", None, False), (13, "/t/.hidden.pdf", _unit(0), False),
        (20, "/t/lease one.pdf", _unit(90), False), (21, "/t/lease two.pdf", _unit(100), False), (22, "/t/lease.png", _unit(95), False),
        (30, "/t/rent a.pdf", _unit(180), True), (31, "/t/bill b.pdf", _unit(181), True),
        (40, "/t/chain1.md", _unit(240), False), (41, "/t/chain2.md", _unit(270), False), (42, "/t/chain3.md", _unit(300), False),
        (50, "/u/x.pdf", _unit(5), False),
    ]
    files = spark.createDataFrame(rows, FILES)
    a = analysis.analyse(files, spark.createDataFrame([("/t",), ("/u",)], "target string")).cache()
    got = {r["id"]: (r["outcome"], r["folder"], r["cluster"], r["reason"]) for r in a.collect()}
    assert got == {
        10: ("fit", "/t/Tax", None, "like its contents"), 11: ("loner", None, None, "alone"), 12: ("no_vector", None, None, "no vector"),
        20: ("cluster", None, "20|document", "related files"), 21: ("cluster", None, "20|document", "related files"), 22: ("loner", None, None, "alone"),
        30: ("loner", None, None, "alone"), 31: ("loner", None, None, "alone"),
        40: ("loner", None, None, "dissolved"), 41: ("loner", None, None, "dissolved"), 42: ("loner", None, None, "dissolved"), 50: ("loner", None, None, "alone"),
    }
    few = analysis.analyse(files, spark.createDataFrame([("/t",)], "target string"), most_loose=5)
    assert {(r["outcome"], r["reason"]) for r in few.collect()} == {("out_of_scope", "too many loose files")}

    names = spark.createDataFrame([("20|document", "Leases: ", 0.9)], "cluster string, name string, confidence double")
    say = [(11, "existing", "tax", 0.7, True), (22, "new", "LEASES", 0.85, False), (30, "new", "Misc", 0.9, True), (31, "new", "...", 0.9, True), (40, "new", "Chains", 0.7, True), (41, "new", "chains", 0.5, True), (50, "existing", "Tax", 0.9, True)]
    judged = spark.createDataFrame(say, "id long, placement string, folder_name string, confidence double, has_preview boolean")
    have = spark.createDataFrame([("/t", "Tax"), ("/t", "Pics")], "target string, name string")
    plan = {r["id"]: (r["outcome"], r["destination"], r["is_new"], r["reason"]) for r in analysis.build_plan(a, names, judged, have).collect()}
    assert plan == {
        10: ("move", "/t/Tax", False, "fits"), 11: ("move", "/t/Tax", False, "fits"), 12: ("left", None, None, "no vector"),
        20: ("move", "/t/Leases", True, "group"), 21: ("move", "/t/Leases", True, "group"), 22: ("move", "/t/Leases", True, "group"),
        30: ("dropped", None, None, "generic name"), 31: ("dropped", None, None, "unusable name"),
        40: ("dropped", None, None, "peers dropped"), 41: ("dropped", None, None, "below cutoff"), 42: ("left", None, None, "not judged"), 50: ("dropped", None, None, "no such folder"),
    }
    apart = spark.createDataFrame([(30, "new", "Bills", 0.8, True), (31, "new", "bills", 0.9, True), (11, "leave", None, 0.9, True)], judged.schema)
    plan = {r["id"]: r["reason"] for r in analysis.build_plan(a, names, apart, have).collect()}
    assert plan[30] == plan[31] == "not coherent" and plan[11] == "leave" and plan[20] == "group"
    sure = spark.createDataFrame([(30, "new", "Bills", 0.86, True), (31, "new", "bills", 0.9, False)], judged.schema)
    assert {r["id"]: r["destination"] for r in analysis.build_plan(a, names, sure, have).collect()}[31] == "/t/Bills"
    assert analysis.build_plan(a, names.limit(0), judged.limit(0), have.limit(0)).count() == 12
    assert analysis.analyse(files.limit(0), spark.createDataFrame([("/t",)], "target string")).count() == 0
