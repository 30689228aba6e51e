"""What follows indexing: tables kept by changes equal those of a run over everything, and only changed files are read."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import clients
from quarry.streaming import hook
from quarry.streaming.library_tables import LibraryTables, index_changes

TEXTS = {
    "/l/a.txt": "TAX INVOICE\nInvoice no 7 for Zenlite Traders. Payment due 12 March 2024. GSTIN 27ABCDE1234F1Z5",
    "/l/b.txt": "Lease agreement between landlord and Blue Harbor Inc. Expires on 1 May 2025.",
    "/l/sub/Bank statement June 2023.txt": "Statement of account of Zenlite Traders and Blue Harbor",
    "/l/c.txt": "",
    "/l/d.txt": "PAN ABCDE1234F, nothing else",
}
NAMES = {"1": "Zenlite Traders", "2": "Blue Harbor Inc."}


class Folder:
    """Files in memory, looked up as a store would."""

    def __init__(self, spark):
        self.spark, self.files, self.asked = spark, dict(TEXTS), []

    def all(self):
        rows = [(p, os.path.basename(p), len(t), 1, t) for p, t in self.files.items()]
        return self.spark.createDataFrame(rows, "path string, file_name string, size long, mtime long, text string").withColumn("hash", F.sha2("text", 256))

    def look(self, paths):
        return self.all().join(paths.select("path"), "path").drop("text")

    def read(self, files):
        self.asked.append(sorted(r["path"] for r in files.select("path").collect()))
        return files.select("path", "file_name").join(self.all().select("path", "text"), "path")


def _idents(spark, names):
    rows = [(k, v) for k, v in names.items()]
    return clients.identifiers(spark.createDataFrame(rows, "client_id string, name string"))


def _rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def _same(tables, folder, derive):
    """Every table equals the one made of all files at once."""
    texts = folder.all().select("path", "file_name", "text")
    for name, make in derive.items():
        assert _rows(tables.read(name)) == _rows(make(texts)), name
    assert sorted(r["path"] for r in tables.read("files").collect()) == sorted(folder.files)


def test_tables_follow_changes_only(spark, tmp_path):
    folder, reports, names = Folder(spark), [], dict(NAMES)
    pins = [("/l/d.txt", "2")]
    pinned = lambda: spark.createDataFrame(pins, "path string, client_id string")
    derive = hook.passes(lambda: _idents(spark, names), pinned)
    tables = LibraryTables(spark, str(tmp_path / "tables"), hook.SCHEMAS, buckets=4)
    sink = index_changes(tables, folder.look, derive, folder.read, reports.append)
    say = lambda *paths: spark.createDataFrame([(p, "changed") for p in paths], "path string, change string")
    sink(say(*TEXTS), 0)
    _same(tables, folder, derive)
    assert reports[-1]["read"] == 5 and reports[-1]["asked"] == 5
    assert {r["path"]: (r["client_id"], r["state"]) for r in tables.read("clients").collect()} == {
        "/l/a.txt": ("1", "assigned"), "/l/b.txt": ("2", "assigned"), "/l/sub/Bank statement June 2023.txt": (None, "conflicted"), "/l/c.txt": (None, "unmatched"), "/l/d.txt": ("2", "pinned"),
    }
    assert {r["path"]: r["pan"] for r in tables.read("identities").collect()} == {"/l/a.txt": "ABCDE1234F", "/l/d.txt": "ABCDE1234F"}
    assert ("/l/a.txt", "2024-03-12") in [(r["path"], r["date"]) for r in tables.read("dates").collect()]
    # One file is changed, one moved, one deleted, one only touched; the same batch again does nothing.
    folder.asked.clear()
    folder.files["/l/b.txt"] += " Zenlite Traders pays. Renewal due 3 June 2026."
    folder.files["/l/new name.txt"] = folder.files.pop("/l/a.txt")
    del folder.files["/l/c.txt"]
    sink(say("/l/a.txt", "/l/b.txt", "/l/new name.txt", "/l/c.txt", "/l/d.txt"), 1)
    assert folder.asked == [["/l/b.txt"]] and (reports[-1]["read"], reports[-1]["kept"], reports[-1]["moved"]) == (1, 2, 1)
    n = len(reports)
    sink(say("/l/b.txt"), 1)
    assert len(reports) == n
    # A client's identifier goes and another comes: only the files that have one of them are matched again.
    old = dict(names)
    names.update({"1": "Harbor", "2": "Blue Harbor Inc."})
    done = hook.reassign(tables, folder.read, _idents(spark, old), _idents(spark, names), pinned())
    assert done["files"] == 3
    _same(tables, folder, derive)
    assert hook.reassign(tables, folder.read, _idents(spark, names), _idents(spark, names), pinned())["files"] == 0
    # The stream goes on after it, and a batch that fails changes nothing.
    state = tables.pointer()

    def broken(files):
        raise ValueError("broken")

    with pytest.raises(ValueError):
        index_changes(tables, folder.look, derive, broken)(say("/l/d.txt", "/l/b.txt"), 2)
    assert tables.pointer() == state
    folder.files["/l/d.txt"] = "Zenlite Traders, Harbor"
    sink(say("/l/d.txt"), 2)
    _same(tables, folder, derive)


def test_no_clients_and_first_ones(spark, tmp_path):
    folder = Folder(spark)
    tables = LibraryTables(spark, str(tmp_path / "tables"), hook.SCHEMAS, buckets=2)
    index_changes(tables, folder.look, hook.passes(), folder.read)(folder.all().select("path"), 0)
    assert tables.read("clients").isEmpty() and tables.read("types").count() == 5
    none = spark.createDataFrame([], "client_id string, norm string")
    nobody = spark.createDataFrame([], "path string, client_id string")
    assert hook.reassign(tables, folder.read, none, _idents(spark, NAMES), nobody)["files"] == 5
    _same(tables, folder, hook.passes(lambda: _idents(spark, NAMES)))
