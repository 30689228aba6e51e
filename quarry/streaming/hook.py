"""What follows indexing: type, dates, primary date, tax identity and client of each changed file.

``passes`` are the derivations that ``index_changes`` runs on a batch's new and changed files; ``prepare`` reads each of
these files once for all of them. Files that were only touched or moved keep their rows and are not read. So the tables
equal those of a run over the whole library, while a batch reads only what changed (``report`` tells how much).

The client pass runs only while there are clients. When clients or their identifiers change, ``reassign`` makes the client
table anew for the files concerned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import chunking, clients, date_scan, extraction
from quarry.plans.workspace import Workspace, broadcast_if_small
from quarry.streaming.library_tables import FILES, Derive, LibraryTables

SCHEMAS = {
    "files": FILES,
    "types": "path string, doc_type string",
    "dates": "path string, date string, title string, excerpt string",
    "primary_dates": "path string, date string",
    "identities": "path string, gstin string, pan string",
    "clients": "path string, client_id string, state string",
}


def passes(idents: Callable[[], DataFrame] | None = None, pinned: Callable[[], DataFrame] | None = None) -> dict[str, Derive]:
    """Derivations from prepared files (path, file_name, text); idents (client_id, norm) and pinned (path, client_id) are read at each batch."""

    def assigned(texts: DataFrame) -> DataFrame:
        empty = texts.sparkSession.createDataFrame([], "path string, client_id string")
        if idents is None or (known := idents()).isEmpty():
            return texts.sparkSession.createDataFrame([], SCHEMAS["clients"])
        out = clients.membership(texts, known, pinned() if pinned else empty, "path", "text")
        return out.select("path", F.col("client_id").cast("string").alias("client_id"), "state")

    return {
        "types": lambda t: chunking.with_doc_type(t, "file_name", "text").select("path", "doc_type"),
        "dates": lambda t: date_scan.scan_events(t, "path", "text"),
        "primary_dates": lambda t: t.select("path", date_scan.primary_date(F.col("file_name"), F.col("text")).cast("string").alias("date")).filter("date IS NOT NULL"),
        "identities": lambda t: t.withColumn("ids", extraction.tax_ids(F.col("text"))).filter("ids IS NOT NULL").select("path", "ids.gstin", "ids.pan"),
        "clients": assigned,
    }


def reassign(tables: LibraryTables, read: Callable[[DataFrame], DataFrame], old: DataFrame, new: DataFrame, pinned: DataFrame) -> dict:
    """Clients of files after identifiers changed from ``old`` to ``new`` (client_id, norm each); returns what was written.

    A file's client can only change if it has an identifier that came or went, so all texts are searched for these alone,
    and only the files found are matched with all identifiers. Files without a row yet (no clients before) get theirs.
    """
    ws = Workspace(tables.spark, "reassign")
    state = tables.pointer()
    files = tables.read("files", state).select("path", "file_name")
    texts = ws.stage(read(files).select("path", "text"), "texts")
    pair = ["client_id", "norm"]
    differ = old.select(pair).exceptAll(new.select(pair)).union(new.select(pair).exceptAll(old.select(pair))).select("norm").distinct()
    bare = files.select("path").join(tables.read("clients", state).select("path"), "path", "left_anti")
    found = clients.occurrences(texts, differ, "path", "text", "norm").select("path")
    concerned = ws.stage(found.union(bare).distinct(), "concerned")
    rows = clients.membership(texts.join(broadcast_if_small(concerned), "path", "left_semi"), new, pinned, "path", "text")
    rows = rows.select("path", F.col("client_id").cast("string").alias("client_id"), "state")
    rest = {n: tables.read(n, state).join(broadcast_if_small(concerned), "path", "left_semi") for n in tables.schemas if n != "clients"}
    done = tables.apply(None, concerned, {**rest, "clients": rows})
    return {**done, "files": concerned.count()}
