"""The watching source and the bucketed tables that it keeps: deletes, moves, restarts and failures."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import date_scan
from quarry.sources import files as S
from quarry.streaming import watch
from quarry.streaming.library_tables import FILES, LibraryTables, index_changes


def _put(path, text, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def _run(spark, root, state, check, sink):
    q = spark.readStream.format("watch").option("state", str(state)).option("parts", 3).load(str(root)).writeStream.foreachBatch(sink).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    if q.exception():
        raise q.exception()


def _changes(spark, root, tmp_path):
    got = []
    _run(spark, root, tmp_path / "state", tmp_path / "check", lambda b, n: got.extend((r["path"].removeprefix(str(root) + "/"), r["change"]) for r in b.collect()))
    return sorted(got)


def test_creates_changes_and_deletes(spark, tmp_path):
    spark.dataSource.register(watch.WatchSource)
    root = tmp_path / "lib"
    for n in ("a.txt", "b/c.PDF", "b/x.exe", ".hidden.txt", "node_modules/d.txt", ".git/e.txt", "Library/f.txt"):
        _put(root / n, "one", 1_700_000_000)
    assert _changes(spark, root, tmp_path) == [("a.txt", "created"), ("b/c.PDF", "created")]
    assert _changes(spark, root, tmp_path) == []
    _put(root / "a.txt", "three", 1_700_000_000)
    _put(root / "n.md", "new")
    (root / "b/c.PDF").unlink()
    # A batch that fails is run again as it was, even if the folder has changed since.
    def fail(b, n):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        _run(spark, root, tmp_path / "state", tmp_path / "check", fail)
    _put(root / "later.md", "x")
    seen = []
    for _ in range(2):
        seen += _changes(spark, root, tmp_path)
    assert sorted(seen) == [("a.txt", "changed"), ("b/c.PDF", "deleted"), ("later.md", "created"), ("n.md", "created")]
    assert len(watch.Listings(str(tmp_path / "state"), 3).numbers()) <= 2


TABLES = {"files": FILES, "dates": "path string, date string, title string, excerpt string"}


def test_index_follows_the_folder(spark, tmp_path):
    spark.dataSource.register(watch.WatchSource)
    root, made = tmp_path / "lib", []
    tables = LibraryTables(spark, str(tmp_path / "tables"), TABLES, buckets=8)

    def look(paths):
        there = [p for p in (r["path"] for r in paths.collect()) if os.path.exists(p)]
        return S.scan(spark, there, content=True).withColumn("path", F.regexp_replace("path", "^file:/+", "/")) if there else spark.createDataFrame([], "path string, file_name string, size long, mtime long, content binary, hash string")

    def dates(files):
        texts = look(files.select("path")).withColumn("text", F.decode("content", "UTF-8"))
        made.extend(r["path"].removeprefix(str(root) + "/") for r in files.select("path").collect())
        return date_scan.scan_events(texts, "path", "text")

    sink = index_changes(tables, look, {"dates": dates})
    step = lambda: (made.clear(), _run(spark, root, tmp_path / "state", tmp_path / "check", sink), sorted(made))[2]
    rel = lambda df, *cols: sorted((r["path"].removeprefix(str(root) + "/"), *(r[c] for c in cols)) for r in df.collect())
    for i in range(12):
        _put(root / f"f{i}.txt", f"Payment due {i + 1} March 2024")
    assert len(step()) == 12 and len(rel(tables.read("files"))) == 12
    before = tables.pointer()
    # One file changes, one is deleted, one is moved, one is only touched: only the changed one is looked into.
    _put(root / "f0.txt", "Payment due 1 April 2024")
    (root / "f1.txt").unlink()
    (root / "sub").mkdir()
    os.rename(root / "f2.txt", root / "sub/g.txt")
    _put(root / "f3.txt", "Payment due 4 March 2024", 1_600_000_000)
    assert step() == ["f0.txt"]
    names = [f"f{i}.txt" for i in range(12) if i not in (1, 2)] + ["sub/g.txt"]
    assert [p for p, in rel(tables.read("files"))] == sorted(names)
    assert rel(tables.read("dates"), "date") == sorted([("f0.txt", "2024-04-01"), ("sub/g.txt", "2024-03-03")] + [(f"f{i}.txt", f"2024-03-{i + 1:02d}") for i in range(3, 12)])
    # Untouched buckets are where they were.
    after = tables.pointer()
    stay = [b for b, e in after["tables"]["files"].items() if e == before["epoch"]]
    assert stay and after["epoch"] > before["epoch"]
    # The derived table equals one made from all files at once.
    whole = date_scan.scan_events(look(tables.read("files").select("path")).withColumn("text", F.decode("content", "UTF-8")), "path", "text")
    assert rel(whole, "date", "title", "excerpt") == rel(tables.read("dates"), "date", "title", "excerpt")
    # A batch that fails leaves the state, and is applied when the stream starts again.
    _put(root / "z.txt", "Payment due 9 May 2025")

    def broken(files):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        _run(spark, root, tmp_path / "state", tmp_path / "check", index_changes(tables, look, {"dates": broken}))
    assert tables.pointer() == after
    assert step() == ["z.txt"]
    tables.vacuum(1)
    assert len(rel(tables.read("dates"))) == 12 and tables.apply(0, tables.read("files").select("path"), {})["buckets"] == 0
    for f in root.rglob("*.txt"):
        f.unlink()
    step()
    assert tables.read("files").count() == tables.read("dates").count() == 0
