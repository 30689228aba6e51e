"""The library's tables, kept by a stream: buckets by key, of which a batch rewrites only those it touches.

A table's row belongs to the bucket of its file's path. A batch writes new versions of the touched buckets of all tables
and then one pointer file, so all tables switch together, and a batch that fails leaves the state before it. What a batch
reads and writes grows with its changes (times a bucket's size), not with the library. A batch that was applied is not
applied again. Other writers (``hook.reassign``) add states between two batches; one writer at a time.

``index_changes`` is the stream's sink: it looks at each changed file as it is now, recognises moves by content, and has
the derived tables of changed files, and of those only, made anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.plans.workspace import Workspace, broadcast_if_small

BUCKETS = 256


class LibraryTables:
    """Tables (name to schema; every one has a column ``path``) below a folder."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.buckets = spark, root.rstrip("/"), schemas, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    # -- the pointer

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop.Path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def pointer(self) -> dict:
        """The last state: its version, the stream's last batch in it, and for each table the version in which each bucket was written."""
        done = [int(n) for n in self._names(f"{self.root}/pointer") if n.isdigit()]
        if not done:
            return {"epoch": -1, "version": -1, "tables": {t: {} for t in self.schemas}}
        stream = self._fs.open(self._hadoop.Path(f"{self.root}/pointer/{max(done)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        made, at = (self._hadoop.Path(f"{self.root}/pointer/{n}") for n in (f".new-{state['version']}", state["version"]))
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(made, at):
            raise RuntimeError(f"{at} could not be written")

    # -- rows

    def read(self, name: str, state: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        at = (state or self.pointer())["tables"][name]
        paths = [f"{self.root}/{name}/epoch={e}/bucket={b}" for b, e in at.items() if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def apply(self, epoch: int | None, gone: DataFrame, new: dict[str, DataFrame]) -> dict:
        """Replace all rows of the paths ``gone`` (path) by the new rows of each table, and point to the result.

        ``epoch`` is the stream's batch; None for a change that is no batch. Returns what was read and written: rows and
        buckets.
        """
        state = self.pointer()
        if epoch is not None and state["epoch"] >= epoch:
            return {"epoch": state["epoch"], "buckets": 0, "rows": 0}
        ws = Workspace(self.spark, "library")
        gone = ws.stage(gone.select("path").distinct(), "gone")
        new = {t: ws.stage(d.select(*self.spark.createDataFrame([], self.schemas[t]).columns), t) for t, d in new.items()}
        keys = gone
        for d in new.values():
            keys = keys.union(d.select("path"))
        touched = sorted(r["b"] for r in keys.select(self.bucket(F.col("path")).alias("b")).distinct().collect())  # as many as buckets at most
        rows, version = 0, state["version"] + 1
        for t in self.schemas:
            old = self.read(t, state, touched).join(broadcast_if_small(gone), "path", "left_anti")
            all_ = old.unionByName(new[t]) if t in new else old
            at = f"{self.root}/{t}/epoch={version}"
            all_.withColumn("bucket", self.bucket(F.col("path"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            for b in touched:
                state["tables"][t].pop(str(b), None)
            filled = [n.partition("=")[2] for n in self._names(at) if n.startswith("bucket=")]
            state["tables"][t] |= {b: version for b in filled}
            rows += self.read(t, state, touched).count()
        state["version"] = version
        if epoch is not None:
            state["epoch"] = epoch
        self._point(state)
        return {"epoch": state["epoch"], "buckets": len(touched), "rows": rows}

    def vacuum(self, keep: int = 2) -> None:
        """Delete pointers but the last ones, and the buckets to which none of these points."""
        done = sorted(int(n) for n in self._names(f"{self.root}/pointer") if n.isdigit())
        for n in done[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.root}/pointer/{n}"), False)
        used = set()
        for n in done[-keep:]:
            stream = self._fs.open(self._hadoop.Path(f"{self.root}/pointer/{n}"))
            used |= {(t, str(e), b) for t, bs in json.loads(bytes(stream.readAllBytes()).decode())["tables"].items() for b, e in bs.items()}
            stream.close()
        for t in self.schemas:
            for e in (n.partition("=")[2] for n in self._names(f"{self.root}/{t}") if n.startswith("epoch=")):
                for b in (n.partition("=")[2] for n in self._names(f"{self.root}/{t}/epoch={e}") if n.startswith("bucket=")):
                    if (t, e, b) not in used:
                        self._fs.delete(self._hadoop.Path(f"{self.root}/{t}/epoch={e}/bucket={b}"), True)


FILES = "path string, file_name string, size long, mtime long, hash string, status string"
#: From changed paths (path, ...) to the files that are there now: path, file_name, size, mtime, hash.
Look = Callable[[DataFrame], DataFrame]
Derive = Callable[[DataFrame], DataFrame]


def index_changes(tables: LibraryTables, look: Look, derive: dict[str, Derive], prepare: Derive | None = None, report: Callable[[dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for changes (path, ...): the table ``files``, and the derived tables of changed files.

    What a change said is no matter: a path is looked up as it is when the batch runs, and is indexed if there is a file
    and removed if there is none. A file that is there with the hash it had keeps its derived rows. One whose content
    is that of a file removed in the same batch was moved: the derived rows follow it (each removed file is one move's).
    ``derive`` makes a table's rows (path, ...) from files; it sees new and changed ones only, as ``prepare`` read them
    (once for all tables). ``report`` gets the numbers of paths asked for, files read, kept and moved, and of what was
    written.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ws = Workspace(spark, "changes")
        state = tables.pointer()
        if state["epoch"] >= epoch:
            return
        asked = ws.stage(batch.select("path").distinct(), "paths")
        buckets = [r["b"] for r in asked.select(tables.bucket(F.col("path")).alias("b")).distinct().collect()]
        known = ws.stage(tables.read("files", state, buckets).join(broadcast_if_small(asked), "path", "left_semi"), "known")
        now = ws.stage(look(asked).select("path", "file_name", "size", "mtime", "hash"), "now")
        same = now.join(known.select("path", F.col("hash").alias("was")), "path").filter(F.col("hash").eqNullSafe(F.col("was"))).select("path")
        removed = known.join(now.select("path"), "path", "left_anti").select(F.col("path").alias("from"), "hash")
        fresh = now.join(known.select("path"), "path", "left_anti").select("path", "hash")
        # The n-th removed file of a content becomes the n-th new one of it.
        nth = lambda c: F.row_number().over(W.partitionBy("hash").orderBy(c))
        moved = ws.stage(removed.withColumn("n", nth("from")).join(fresh.withColumn("n", nth("path")), ["hash", "n"]).select("from", "path"), "moved")
        kept = ws.stage(same.select(F.col("path").alias("from"), "path").union(moved), "kept")
        work = now.join(kept.select("path"), "path", "left_anti")
        if prepare or report:
            work = ws.stage(prepare(work) if prepare else work, "work")
        new = {"files": now.withColumn("status", F.lit("INDEXED"))}
        for name, make in derive.items():
            held = tables.read(name, state, buckets).withColumnRenamed("path", "from").join(broadcast_if_small(kept), "from").drop("from")
            new[name] = make(work).unionByName(held)
        done = tables.apply(epoch, asked, new)
        if report:
            report({"asked": asked.count(), "read": work.count(), "kept": kept.count(), "moved": moved.count(), **done})

    return sink
