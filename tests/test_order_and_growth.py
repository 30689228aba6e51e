"""Rows whose order a query's keys leave open, and steps whose rows must not grow faster than the input."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quarry.operators import chunking, clients, date_scan, injection, model_batches, questions, sheets, vectors
from quarry.plans import catalog
from quarry.plans.workspace import Workspace


def test_facts_of_one_place_have_an_order(spark):
    """Two facts with one ord: the larger value is first, in whatever order they are read."""
    rows = [(1, "K", "a", 5, None, "overdue", "s1", "/p"), (2, "K", "a", 7, 3, "overdue", "s2", "/p"), (2, "K", "b", 9, 4, "overdue", "s3", "/p")]
    cols = "ord long, key string, subject string, value long, balance long, status string, source_name string, source_path string"
    for order in (rows, rows[::-1]):
        f = spark.createDataFrame(order, cols).coalesce(1)
        assert [tuple(r) for r in sheets.conflicts(f).collect()] == [("k:k", 5, "s1", 9, "s3")]
        (merged,) = sheets.merge_facts(f.filter("ord = 2")).collect()
        assert tuple(merged) == ("k:k", "b", 9, 4, "overdue", "s3")


def test_amounts_are_added_as_they_arrived(spark):
    """Sums of doubles that should end in .5: equal to a plain loop over the rows as they arrived, however they are read and dealt."""
    rng = np.random.default_rng(11)
    want, rows = {}, []
    for k in range(80):
        v = [int(x) for x in rng.integers(100, 9_999_999, 40)]
        v.append(50 - sum(v) % 100 + 1000)  # in hundredths; the whole sum ends in .50
        x = 0.0
        for c in v:
            x += c / 100
        want[f"p{k}"] = int(np.floor(x + 0.5))
        rows += [(f"P{k}", c / 100) for c in v]
    assert len({want[f"p{k}"] - -(-sum(round(v * 100) for p, v in rows if p == f"P{k}") // 100) for k in range(80)}) == 2  # both up and down
    seen = rng.permutation(len(rows)).tolist()
    cols = "ord long, seen struct<file:string,row:long>, doc_type string, category string, parties array<struct<name:string,role:string,side:string>>, amounts array<struct<label:string,value:double,currency:string,status:string,role:string>>"
    sheet = lambda i: (seen[i], (f"f{i // 1000}", i % 1000), "bill", "", [(rows[i][0], "client", "")], [("Line", rows[i][1], "", "unpaid", "")])
    for order, parts in ((range(len(rows)), 1), (seen, 7)):
        t = sheets.money_table(spark.createDataFrame([sheet(i) for i in order], cols).repartition(parts), [], True)
        assert {r["party"]: (r["billed"], r["owed"]) for r in t.collect()} == {p: (v, v) for p, v in want.items()}


def test_tied_facts_come_as_they_arrived(spark, tmp_path):
    """Facts whose keys are all equal: the first row of the table counts, as in the SQL, in whatever order Spark reads its files."""
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string"
    line = lambda k, price, tax, flag, n=2: (k, 7, 1, n, 20.0, price, tax, flag, "O")
    first = [line(3, 10.0, 0.05, "A"), line(3, 90.0, 0.06, "A"), line(7, 50.0, 0.0, "A"), line(4, 30.0, 0.05, "R")]
    second = [line(7, 80.0, 0.08, "R"), line(7, 99.0, 0.09, "R"), line(4, 40.0, 0.05, "R"), line(4, 5.0, 0.05, "N", 3), *[line(8, 1.0, 0.0, "N", n) for n in range(50)]]
    at = tmp_path / "lineitem.parquet"
    at.mkdir()
    for n, rows in enumerate((first, second)):  # the larger file is read first
        names, types = zip(*(c.split(" ") for c in cols.split(", ")))
        pa.parquet.write_table(pa.table([pa.array(v, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for v, t in zip(zip(*rows), types)], names), at / f"part-{n}.parquet")
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/*.parquet'")
    for name in ("facts_conflicts", "facts_merge"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = duck.sql(catalog.ORACLE_SQL[name]).project(", ".join(df.columns)).fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def counted(monkeypatch):
    """Rows of the tables that are staged, by name."""
    rows, stage = {}, Workspace.stage

    def run(self, df, name):
        out = stage(self, df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Workspace, "stage", run)
    return rows


def test_entities_that_meet_questions_are_bounded(spark, monkeypatch):
    rows = counted(monkeypatch)
    files = spark.range(600).selectExpr("id f", "concat('lease-', id, '.pdf') file_name", "id size", "if(id % 3 = 0, concat('lease ', id % 30), null) entity")
    pool = spark.createDataFrame([(1, 599), (1, 597), (2, 598)], "query_id long, f long")
    asked = spark.createDataFrame([(1, "are all the leases the same?"), (2, "compare all the leases"), (3, "lease")], "query_id long, question string")
    got = {(r["query_id"], r["f"], r["place"]) for r in injection.by_entity(pool, files, asked, "f").collect()}
    # 597 covers its entity, 599 and 598 are in the pool.
    assert got == {(1, f, p) for p, f in enumerate((598, 596, 595, 594, 593, 592), 1)} | {(2, f, p) for p, f in enumerate((599, 597, 596, 595, 594, 593), 1)}
    assert rows["best"] <= (injection.ENTITY_FILES + 2) * 3  # of one stem, with a pool of two files


def test_questions_of_entities_are_spread(spark, monkeypatch):
    """What meets the questions is made in as many tasks as they need, though they were staged in one file."""
    monkeypatch.setattr(injection, "ASKED_PART", 50)
    files = spark.range(60).selectExpr("id f", "concat('lease-', id, '.pdf') file_name", "id size", "cast(null as string) entity")
    asked = spark.range(0, 300, 1, 1).selectExpr("id query_id", "'compare all the leases' question")
    found = injection.by_entity(asked.selectExpr("query_id", "query_id % 60 f"), files, asked, "f")
    got = found.withColumn("task", F.spark_partition_id()).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "f"))).alias("x"), F.max("task").alias("task")).collect()
    assert {r["query_id"]: [x["f"] for x in r["x"]] for r in got} == {q: [f for f in range(59, -1, -1) if f != q % 60][:6] for q in range(300)}
    assert len({r["task"] for r in got}) > 3


def test_completed_inventories_are_not_gathered(spark, monkeypatch):
    """Files times questions come out of the joins as they are; only rows of files that share an id are put together."""
    files = spark.range(60).selectExpr("id file", "concat('lease-', id, '.pdf') file_name", "cast(null as string) entity", "cast(null as string) doc_type", "if(id < 20, '2004-03-05', '2005-01-01') date")
    files = files.unionByName(files.filter("file in (1, 4)").withColumn("file_name", F.lit("other.pdf")).withColumn("date", F.lit("2004-03-07")))
    asked = spark.createDataFrame([(q, "What came in during March 2004?" if q == 3 else "List the papers", "papers") for q in range(5)], "query_id long, question string, subject string")
    matched = spark.createDataFrame([(q, f) for q in range(4) for f in (0, 2, 58)] + [(0, 0), (2, 4), (3, 1)], "query_id long, file long")
    gathered, call = [], DataFrame.groupBy

    def run(self, *by):
        if by == ("query_id", "file"):
            gathered.append(self.count())
        return call(self, *by)

    monkeypatch.setattr(DataFrame, "groupBy", run)
    got = [(r["query_id"], r["file"], r["added"]) for r in questions.complete_inventory(asked, matched, files).collect()]
    want = {(q, f, f not in (0, 2, 58)) for q in (0, 1) for f in range(60)}
    want |= {(2, f, False) for f in (0, 2, 4, 58)}  # the second name of 4 shares no stem
    want |= {(3, f, f not in (0, 1, 2)) for f in range(20)}
    assert sorted(got) == sorted(want)
    assert gathered and sum(gathered) <= 20


def test_a_vector_is_sent_to_few_groups(spark, monkeypatch):
    """All pairs of random vectors: a vector goes to as many tasks as there are groups at most, not to each block."""
    monkeypatch.setattr(vectors, "BLOCK", 5)
    monkeypatch.setattr(vectors, "GROUPS", 4)
    x = np.random.default_rng(3).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    sent, call = [], DataFrame.sortWithinPartitions

    def run(self, *by):
        sent.append(self.count())
        return call(self, *by)

    monkeypatch.setattr(DataFrame, "sortWithinPartitions", run)
    got = {(r["a"], r["b"]): r["distance"] for r in vectors.near_pairs(d, "id", "v", 0.8).collect()}
    dist = np.round(1 - np.clip(x @ x.T, -1, 1), 6)
    assert got == {(a, b): dist[a, b] for a, b in zip(*np.nonzero(np.triu(dist <= 0.8, 1)))}
    assert len(sent) == 1 and sent[0] <= 5 * len(x)


@pytest.mark.parametrize("size", [1 << 20, 300, 64])
def test_files_are_looked_through_together(monkeypatch, size):
    """Pages of many files at a time, and a large file in pieces; batches may cut files anywhere."""
    monkeypatch.setattr(chunking, "SLICE", size)
    rng, sizes, rows, want = np.random.default_rng(size), [60, 44, 28, 12], [], []
    for f in [None, *range(40)]:
        pages = ["".join(rng.choice(list("abab0"), rng.integers(0, 90))) for _ in range(rng.integers(0, 9))]
        chunks = [p[rng.integers(0, 9) :] + x for p in pages for x in ("", "zz", "b" * 20)] + ["", "nowhere"]
        rows += [(f, 0, 0, 0, n, p + "\n", "", "") for n, p in enumerate(pages)] + [(f, 0, 0, 1, n, "", c[:60], c[-60:]) for n, c in enumerate(chunks)]
        for n, c in enumerate(chunks):
            hits = [[[k for k, p in enumerate(pages) if s in p] for s in (c[:size], c[-size:])] for size in sizes]
            first, last = (next((pick(h[i]) for h in hits if h[i]), -1) for i, pick in ((0, min), (1, max)))
            want += [(f, n, first, last)] * bool(c)
    names = ["file", "p", "c", "side", "number", "page_text", "head", "tail"]
    types = [pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.string()] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
    made, init = [], chunking._Pages.__init__
    monkeypatch.setattr(chunking._Pages, "__init__", lambda self, *a: made.append(1) or init(self, *a))
    for step in (len(rows), 7):
        got = []
        for b in chunking._locate(sizes)(batch.slice(a, step) for a in range(0, len(rows), step)):
            got += [(r["file"], r["chunk_index"], *(next((x for x in r[k] if x >= 0), -1) for k in ("first", "last"))) for r in b.to_pylist()]
        assert got == want
        assert size < 1000 or step == 7 or len(made) <= 2  # the file that a batch may not end is held back


def test_a_text_is_computed_once_for_its_dates(spark):
    """A computed name or text would be computed again wherever the expression names it."""
    for c in (date_scan.primary_date(F.col("its_name"), F.col("its_text")), date_scan.found(F.col("its_text"), date_scan.CUE)):
        assert str(c).count("its_text") == 1 and str(c).count("its_name") <= 1


def test_shared_words_meet_no_clients_where_one_is_named(spark, monkeypatch):
    """A question with a client's own word is joined with that client, not with all that share another word."""
    rows = counted(monkeypatch)
    names = spark.range(50).selectExpr("id client_id", "concat('Orion w', char(97 + id div 26), char(97 + id % 26), 'xx') name")
    q = spark.createDataFrame([(1, "what of orion waaxx?"), (2, "Orion?"), (3, "hello")], "id long, t string")
    got = {(r["id"], r["client_id"]) for r in clients.question_matches(q, clients.identifiers(names), "id", "t").collect()}
    assert got == {(1, 0)} | {(2, i) for i in range(50)}
    assert rows["said"] == 4  # two words and the name of question 1, one word of question 2; not fifty rows of each


def test_replies_of_a_frame_come_in_one():
    """However small the batches: each frame that a worker gives back has a cost of its own."""
    f = pd.DataFrame({"batch": ["a", "b", "c"], "size": [2, 2, 1], "hashes": [["h", "i"], ["j", "k"], ["l"]], "texts": [["x", "y"], ["bad", "z"], ["w"]]})
    (got,) = model_batches._asked(lambda texts: None if "bad" in texts else [t.upper() for t in texts])(iter([f]))
    assert [tuple(r) for r in got[["hash", "reply", "size", "batch"]].itertuples(index=False)] == [("h", "X", 2, "a"), ("i", "Y", 2, "a"), ("j", None, 2, "b"), ("k", None, 2, "b"), ("l", "W", 1, "c")]


def test_runs_begin_at_first_words_only(spark, monkeypatch):
    """Texts are taken apart once, and runs are made where an identifier may begin; more first words than a limit change nothing."""
    texts = spark.createDataFrame([(1, "the Acme-Foods of acme foods, acme"), (2, "Zen (Lite) co. and zen lite"), (3, ""), (4, None), (5, "- acme"), (6, "foods")], "id long, t string")
    keys = spark.createDataFrame([(1, "acme"), (2, "acme-foods"), (3, "zen (lite) co"), (4, "zen lite")], "client_id long, norm string")
    want = [(1, 1), (1, 2), (2, 3), (2, 4), (5, 1)]
    for most in (2000, 1):
        monkeypatch.setattr(clients, "FIRST_WORDS", most, raising=False)
        found = clients.matches(texts, keys, "id", "t")
        assert sorted(tuple(r) for r in found.collect()) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and ("acme,zen" in plan or "zen,acme" in plan or "acme, zen" in plan or "IN (" in plan) == (most > 1)
