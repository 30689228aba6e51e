"""The library's tables: admission, change detection, keyed writes, caches, dismissals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.workspace import Workspace

# Extensions that are indexed, and folders that are skipped.
SUPPORTED = "pdf docx doc txt md xlsx xls pptx ppt odt ods odp html htm rtf csv jpg jpeg png tif tiff bmp webp gif".split()
SKIP_DIRS = "node_modules target build dist out bin obj venv __pycache__ vendor Pods bower_components coverage Library".split()
BINARY = "jpg jpeg png gif bmp tiff heic svg ico mp3 mp4 mov wav zip exe dll".split()
RAW_TEXT = "csv tsv txt md".split()
# Fixed values end.
MAX_BYTES = 50 << 20
RAW_BYTES = 512 * 1024
FILE_TOKENS, TOTAL_TOKENS = 500_000, 200_000_000


def admit(scanned: DataFrame, known: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each scanned file's state, by the checks in their order; empty files have none (null). Hidden folders are skipped, too.

    scanned: path, file_name, size, mtime, hash. known: path, mtime, hash, status.
    """
    k = known.select("path", F.col("mtime").alias("k_mtime"), F.col("hash").alias("k_hash"), F.col("status").alias("k_status"))
    done = F.coalesce(F.col("k_status") == "INDEXED", F.lit(False))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    state = (
        F.when(F.exists(folders, lambda f: f.isin(SKIP_DIRS) | f.startswith(".")), "skipped")
        .when(~T.extension(F.col("file_name")).isin(SUPPORTED), "unsupported")
        .when(F.col("size") > max_bytes, "too_large")
        .when(F.col("size") == 0, F.lit(None))
        .when(done & (F.col("mtime") == F.col("k_mtime")), "unchanged")
        .when(done & (F.col("hash") == F.col("k_hash")), "touched")
        .otherwise("process")
    )
    return scanned.join(k, "path", "left").withColumn("state", state).drop("k_mtime", "k_hash", "k_status")


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def budget(files: DataFrame, order: list[str], blocks: int = 64, per_file: int = FILE_TOKENS, total: int = TOTAL_TOKENS) -> DataFrame:
    """in_budget by file size and by the running total over admitted files, in the given order.

    The running total is summed in two levels, so that no task orders all
    files: within ranges of the first column of the order, cut at its
    approximate quantiles, and over the ranges' sums.
    """
    fits = F.col("tokens") <= per_file
    cuts = files.agg(F.percentile_approx(order[0], [i / blocks for i in range(1, blocks)]).alias("cuts"))
    f = files.join(F.broadcast(cuts), F.lit(True), "left").withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col(order[0])))).drop("cuts")
    f = f.withColumn("counted", F.when(fits, F.col("tokens")).otherwise(F.lit(0)))
    sums = f.groupBy("block").agg(F.sum("counted").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
    run = F.sum("counted").over(W.partitionBy("block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = f.join(F.broadcast(before), "block").withColumn("running", F.col("before") + run)
    return out.withColumn("in_budget", fits & (F.col("running") <= total)).drop("block", "before", "counted")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of their keys."""
    return table.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(events: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: an aggregation, so a key of very many rows is combined before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def rename_paths(table: DataFrame, renames: DataFrame, key: str = "path") -> DataFrame:
    """renames: old, new. Apply to each table that holds the path."""
    r = renames.select(F.col("old").alias(key), F.col("new"))
    return table.join(r, key, "left").withColumn(key, F.coalesce("new", key)).drop("new").select(table.columns)


def patch(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of the changes win."""
    fields = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *(F.col(x).alias(f"__{x}") for x in fields))
    joined = table.join(c, keys, "left")
    return joined.select(*(F.coalesce(f"__{x}", x).alias(x) if x in fields else F.col(x) for x in table.columns))


def mark_failed(files: DataFrame, failures: DataFrame, most: int = 500) -> DataFrame:
    """failures: path, reason."""
    f = failures.select("path", F.substr("reason", F.lit(1), F.lit(most)).alias("failed_reason"))
    return files.join(f, "path", "left").withColumn("status", F.when(F.col("failed_reason").isNotNull(), "FAILED").otherwise(F.col("status")))


def cache_hits(cache: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries whose keys (path, hash, version) are all equal, and what is missing."""
    return wanted.join(cache, keys, "inner"), wanted.join(cache.select(keys), keys, "left_anti")


def canonical_dedupe(files: DataFrame) -> DataFrame:
    """Per canonical path the exact match, else the largest; ties by path."""
    rest = [c for c in files.columns if c != "canonical"]
    order = F.struct((F.col("path") == F.col("canonical")).cast("int"), F.col("size"), F.col("path"))
    return files.groupBy("canonical").agg(F.max_by(F.struct(*rest), order).alias("r")).select("canonical", "r.*")


def undismissed(items: DataFrame, dismissed: DataFrame, key: str) -> DataFrame:
    return items.join(dismissed.select(key).distinct(), key, "left_anti")


def undo_batches(log: DataFrame, n: int) -> DataFrame:
    """The last n batches with their number of moves."""
    return log.groupBy("batch_id").agg(F.count("*").alias("moves"), F.max("moved_at").alias("last_at")).orderBy(F.desc("last_at"), "batch_id").limit(n)


def target_selection(files: DataFrame, paths: DataFrame | None = None, folder: str | None = None, client_paths: DataFrame | None = None) -> DataFrame:
    """Explicit paths, else a folder, else a client's files, else all."""
    if paths is not None:
        return files.join(paths.select("path").distinct(), "path", "left_semi")
    if folder is not None:
        return files.filter(F.col("path").startswith(folder.rstrip("/") + "/"))
    if client_paths is not None:
        return files.join(client_paths.select("path").distinct(), "path", "left_semi")
    return files


def is_binary(name: Column) -> Column:
    return T.extension(name).isin(BINARY)


def content(files: DataFrame, chunks: DataFrame, raw: DataFrame) -> DataFrame:
    """(path, content): the raw text of small text files (path, text), else the file's chunks (path, chunk_index, text) joined in order."""
    small = T.extension(F.col("file_name")).isin(RAW_TEXT) & (F.col("size") <= RAW_BYTES)
    f = files.select("path", small.alias("small")).join(raw.select("path", F.col("text").alias("raw")), "path", "left").withColumn("raw", F.when(F.col("small"), F.col("raw")))
    rest = f.filter("raw is null").select("path")
    joined = chunks.join(rest, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    joined = joined.select("path", F.concat(F.array_join(F.transform("c", lambda x: x["text"]), "\n"), F.lit("\n")).alias("joined"))
    return f.join(joined, "path", "left").select("path", F.coalesce("raw", "joined").alias("content"))


def snippet_gather(chunks: DataFrame, file_col: str, most: int = 16_000) -> DataFrame:
    """A file's leading chunks until a number of characters; the last one is cut there. A line break follows each."""
    w = W.partitionBy(file_col).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    c = chunks.withColumn("before", before).filter(F.col("before") < most)
    return c.withColumn("text", F.substr("text", F.lit(1), (F.lit(most) - F.col("before")).cast("int"))).drop("before")


def file_vectors(files: DataFrame, cached: DataFrame, pooled: DataFrame, named: DataFrame, model: str) -> DataFrame:
    """(path, vec, name_only): the cached vector of the same hash and model, else the pooled one, else that of the name.

    files: path, hash. cached: path, hash, model, vec, chunks (0 marks a vector of the name alone). pooled, named: path, vec.
    """
    hit = cached.filter(F.col("model") == model).select("path", "hash", F.col("vec").alias("c"), F.col("chunks"))
    f = files.select("path", "hash").join(hit, ["path", "hash"], "left").join(pooled.select("path", F.col("vec").alias("p")), "path", "left").join(named.select("path", F.col("vec").alias("n")), "path", "left")
    name_only = F.when(F.col("c").isNotNull(), F.col("chunks") == 0).otherwise(F.col("p").isNull())
    return f.select("path", F.coalesce("c", "p", "n").alias("vec"), name_only.alias("name_only")).filter("vec is not null")


def reset_if_drifted(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """The files without those that count as indexed, if there are such and no vector at all; else as they are."""
    if vectors.isEmpty():
        return files.filter(~F.coalesce(F.col("status") == "INDEXED", F.lit(False)))
    return files


def current_model(rows: DataFrame, model: str) -> DataFrame:
    """Rows made with the current model; all others are to be made anew."""
    return rows.filter(F.col("model") == model)


def clear_blank(table: DataFrame, fields: list[str]) -> DataFrame:
    """After an upsert: without rows of which every field is null or blank."""
    some = F.lit(False)
    for f in fields:
        some = some | (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "")
    return table.filter(some)


def listing(rows: DataFrame, *order: Column) -> DataFrame:
    """All rows with their place in an order, from 1.

    Spark sorts by ranges; a row's place is its number within its range and the rows of the ranges before, which are
    counted: one row a range. The order should tell all rows apart.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "listing")
    staged = ws.stage(rows.orderBy(*order).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("nth")), "sorted")
    # The id's low bits count the rows of a task.
    sizes = staged.groupBy("range").agg(F.count("*").alias("rows"))
    before = sizes.select("range", (F.sum("rows").over(W.orderBy("range")) - F.col("rows")).alias("before"))
    return staged.join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("nth").bitwiseAND((1 << 33) - 1) + 1).drop("range", "nth", "before")


def salted(hash_: Column, version: str) -> Column:
    """A hash of the scan's version and the content: a new version makes every file new to the scan."""
    return F.concat(F.lit(version + ":"), hash_)


def unscanned(files: DataFrame, scanned: DataFrame, version: str) -> DataFrame:
    """Files (path, hash) whose salted hash isn't among those of their path (path, scan_key)."""
    f = files.withColumn("scan_key", salted(F.col("hash"), version))
    return f.join(scanned.select("path", "scan_key"), ["path", "scan_key"], "left_anti").drop("scan_key")


def untyped(files: DataFrame) -> DataFrame:
    """Files that classification has still to look at."""
    return files.filter(F.trim(F.coalesce("doc_type", F.lit(""))) == "")


def undo_outcomes(log: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of each move (seq, from_path, to_path) that is undone, the last first: undo, or why it is skipped.

    existing: (path, is_dir). Folders above the original have to be there.
    """
    here = existing.select("path", "is_dir")
    at = lambda name, path: here.select(F.col("path").alias(path), F.lit(True).alias(name))
    o = log.withColumn("parent", F.regexp_extract("from_path", r"(?s)^(.*)/[^/]*$", 1))
    o = o.join(at("found", "to_path"), "to_path", "left").join(at("taken", "from_path"), "from_path", "left").join(here.filter("is_dir").select(F.col("path").alias("parent"), F.lit(True).alias("folder")), "parent", "left")
    outcome = F.when(F.col("found").isNull(), "missing").when(F.col("taken").isNotNull(), "occupied").when((F.col("parent") != "") & F.col("folder").isNull(), "orphaned").otherwise("undo")
    return o.select("seq", "from_path", "to_path", outcome.alias("outcome"))
