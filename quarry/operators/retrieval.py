"""Retrieval: nearest chunks, and the filters that follow in a fixed order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.workspace import Workspace, broadcast_if_small

#: Distance at which a match is no longer relevant; distances are 1 - cosine, in [0, 2].
MAX_DISTANCE = 1.5
RELATIVE_DELTA = 0.6
MIN_KEEP = 5
PER_FILE, IN_CONTEXT, TOP_K = 4, 10, 40


#: Queries that are answered in one pass over the chunks, and chunks whose distances to them are held at a time.
QUERY_BLOCK, CHUNK_BLOCK = 4096, 1024


def norm(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def in_scope(chunks: DataFrame, key: str, scope: DataFrame | None) -> DataFrame:
    """Chunks of files in the scope: all without a scope, none with an empty one."""
    return chunks if scope is None else chunks.join(scope.select(key).distinct(), key, "left_semi")


def matrix(arr: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column, all of one length, without nulls."""
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(arr), len(flat) // max(1, len(arr)))


def unit_rows(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a length over their norms, and which rows have one: finite numbers only, and not only zeros."""
    ok = np.asarray(pc.list_value_length(arr).fill_null(-1)) == (size or -2)
    x = matrix(arr.filter(pa.array(ok))).reshape(int(ok.sum()), size)
    good = np.isfinite(x).all(1) & x.any(1)
    ok[ok] = good
    x = x[good]
    return x / np.linalg.norm(x, axis=1, keepdims=True), ok


def by_length(names: np.ndarray, arr: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, unit vectors) of an Arrow list column for each length that it has."""
    out = []
    for size in sorted(set(pc.list_value_length(arr).drop_null().to_pylist()) - {0}):
        q, ok = unit_rows(arr, size)
        if len(q):
            out.append((names[ok], q))
    return out


def _nearest(shared, k: int):
    """For each query of a block, the k nearest of a partition's chunks, as (query_id, id, micro)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        best = [(np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)) for _, q in groups]
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_BLOCK):
                part = batch.slice(a, CHUNK_BLOCK)
                for g, (_, q) in enumerate(groups):
                    x, ok = unit_rows(part.column(1), q.shape[1])
                    if len(x):
                        best[g] = closest(q, x, np.asarray(part.column(0))[ok], k, *best[g])
        for (names, _), (d, i) in zip(groups, best):
            d, i = _first(d, i, k)
            if d.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, d.shape[1])), pa.array(i.ravel()), pa.array(d.ravel())], ["query_id", "id", "micro"])

    return run


def micro_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of unit vectors in millionths."""
    return np.rint((1 - np.clip(q @ x.T, -1, 1)) * 1e6).astype(np.int64)


def closest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, best_d: np.ndarray, best_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the best rows so far (some more than k) after these rows."""
    order = np.argsort(ids, kind="stable")
    # Distance first, then the place in the order of ids: no two are alike.
    key = (micro_distance(q, x[order]) << 20) | np.arange(len(ids))
    if len(ids) > k:
        key = np.partition(key, k - 1, 1)[:, :k]
    best_d = np.concatenate([best_d, key >> 20], 1)
    best_i = np.concatenate([best_i, ids[order][key & 0xFFFFF]], 1)
    return _first(best_d, best_i, k) if best_d.shape[1] > 4 * k else (best_d, best_i)


def _first(d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((i, d), 1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def top_k(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "chunk_id", vec_col: str = "embedding", scope: DataFrame | None = None, key: str = "file") -> DataFrame:
    """For each query (query_id, vector), its k nearest chunks: query_id, the chunk's id and key, distance, and pos from 1.

    Distances are 1 - cosine, in six digits; ties go by id. The scope applies before. Queries come in blocks: a block is
    broadcast (QUERY_BLOCK vectors), every partition keeps k chunks for each of its queries, and Spark merges those.
    Vectors that are null, zero, of another length or with something that is no number are near to nothing; queries may
    have several lengths. Chunks without id are left out.
    """
    spark = chunks.sparkSession
    ws = Workspace(spark, "top-k")
    near = in_scope(chunks, key, scope).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v")).filter("query_id is not null and v is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        groups = by_length(own.column("query_id").to_numpy(), own.column("v").combine_chunks()) if own.num_rows else []
        found.append(near.mapInArrow(_nearest(spark.sparkContext.broadcast(groups), k), "query_id long, id long, micro long"))
    every = ws.stage(reduce(DataFrame.union, found), "nearest")
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("micro", "id")).cast("long")
    best = every.withColumn("pos", pos).filter(F.col("pos") <= k).select("query_id", F.col("id").alias(id_col), (F.col("micro") / 1e6).alias("distance"), "pos")
    best = broadcast_if_small(ws.stage(best, "best"))
    return chunks.select(F.col(id_col).cast("long").alias(id_col), key).join(best, id_col).select("query_id", id_col, key, "distance", "pos")


def with_position(matches: DataFrame, *order: str) -> DataFrame:
    """pos from 1; for the at most k rows of each query's search."""
    return matches.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))


def relative_cut(matches: DataFrame, delta: float = RELATIVE_DELTA, keep: int = MIN_KEEP) -> DataFrame:
    """Each query's matches within delta of its best; the first ``keep`` if fewer stay and there were as many."""
    w = W.partitionBy("query_id")
    near = F.col("distance") <= F.min("distance").over(w) + F.lit(delta)
    m = matches.withColumn("near", near)
    m = m.withColumn("n_near", F.sum(F.col("near").cast("int")).over(w)).withColumn("n_all", F.count("*").over(w))
    few = (F.col("n_near") < keep) & (F.col("n_all") >= keep)
    return m.filter(F.when(few, F.col("pos") <= keep).otherwise(F.col("near"))).drop("near", "n_near", "n_all")


def diversify(matches: DataFrame, file_col: str, per_file: int = PER_FILE, total: int = IN_CONTEXT) -> DataFrame:
    """For each query, round-robin over files in order of first appearance."""
    own = W.partitionBy("query_id", file_col)
    m = matches.withColumn("round", F.row_number().over(own.orderBy("pos"))).withColumn("first_pos", F.min("pos").over(own)).filter(F.col("round") <= per_file)
    return m.withColumn("slot", F.row_number().over(W.partitionBy("query_id").orderBy("round", "first_pos")).cast("long")).filter(F.col("slot") <= total).drop("round", "first_pos")


def _asked(questions: DataFrame, tokens: Column) -> DataFrame:
    return questions.select("query_id", F.explode(tokens).alias("token"))


def lexical_focus(matches: DataFrame, questions: DataFrame, file_col: str, text_col: str, name_col: str) -> DataFrame:
    """Of each question's matches (query_id, ...), those of files of which a match or the name shares a stemmed token with it (query_id, question).

    All of them if the question has no tokens, nothing shares one, or there is one match.
    """
    asked = questions.select("query_id", T.stems(T.significant_tokens(F.col("question"))).alias("asked"))
    own = T.stems(F.array_union(T.significant_tokens(F.col(text_col)), T.significant_tokens(T.split_camel(F.col(name_col)))))
    m = matches.join(broadcast_if_small(asked, limit=50_000), "query_id", "left").withColumn("hit", F.coalesce(F.arrays_overlap(own, "asked"), F.lit(False)).cast("int"))
    # A query has at most k matches.
    m = m.withColumn("file_hit", F.max("hit").over(W.partitionBy("query_id", file_col))).withColumn("any_hit", F.max("hit").over(W.partitionBy("query_id"))).withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    return m.filter((F.col("any_hit") == 0) | (F.col("n") <= 1) | (F.col("file_hit") == 1)).drop("asked", "hit", "file_hit", "any_hit", "n")


def drop_templates(matches: DataFrame, name_col: str, question: str) -> DataFrame:
    """Without template files, unless the question has a word for templates (as part of a word, too) or names the file."""
    asked = F.lit(any(w in question.lower() for w in T.TEMPLATE_WORDS))
    named = F.lit(question.lower()).contains(F.lower(F.col(name_col)))
    return matches.filter(asked | named | ~F.col(name_col).rlike(T.TEMPLATE_NAME))


def answer_overlap(chunks: DataFrame, answers: DataFrame, id_col: str, file_col: str, text_col: str, name_col: str) -> DataFrame:
    """For each answer (query_id, answer), and file, the chunks whose token overlap with it is at least 0.6 of the file's best.

    Rows are (query_id, chunk, file, overlap); tokens of a file's name don't count.
    """
    ws = Workspace(chunks.sparkSession, "answer-overlap")
    asked = ws.stage(_asked(answers, T.overlap_tokens(F.col("answer"))), "tokens")
    own = F.array_except(T.overlap_tokens(F.col(text_col)), T.overlap_tokens(F.col(name_col)))
    shared = chunks.select(id_col, file_col, F.explode(own).alias("token")).join(broadcast_if_small(asked), "token")
    counts = ws.stage(shared.groupBy("query_id", id_col, file_col).agg(F.count("*").alias("overlap")), "overlaps")
    best = ws.stage(counts.groupBy("query_id", file_col).agg(F.max("overlap").alias("best")), "best")
    return counts.join(broadcast_if_small(best), ["query_id", file_col]).filter(F.col("overlap") >= F.ceil(F.col("best") * 0.6)).select("query_id", id_col, file_col, "overlap")


def first_chunks(chunks: DataFrame, file_col: str, id_col: str, k: int, salts: int = 64) -> DataFrame:
    """The first k chunks of each file in the order of their ids, with chunk_index from 0.

    Each file is cut into salted parts of which k rows go on, so a file with very many chunks is no single task's sort.
    """
    part = F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt")
    some = chunks.select("*", part).withColumn("place", F.row_number().over(W.partitionBy(file_col, "salt").orderBy(id_col))).filter(F.col("place") <= k)
    index = (F.row_number().over(W.partitionBy(file_col).orderBy(id_col)) - 1).cast("long")
    return some.drop("salt", "place").withColumn("chunk_index", index).filter(F.col("chunk_index") < k)


def named_files(files: DataFrame, question: str, name_col: str = "file_name", most: int = 5) -> DataFrame:
    """Files that a question names by a distinctive token; none if more than ``most`` would do."""
    kinds = F.array(*map(F.lit, T.DOC_TYPE_WORDS))
    q = F.array_except(T.significant_tokens(F.lit(question)), kinds)
    hit = files.filter(F.arrays_overlap(F.array_except(T.significant_tokens(F.col(name_col)), kinds), q))
    n = hit.agg(F.count("*").alias("n"))
    return hit.join(F.broadcast(n.filter(F.col("n") <= most)), F.lit(True), "left_semi")


def inject(pool: DataFrame, extra: DataFrame, file_col: str) -> DataFrame:
    """The pool and extra rows of files that aren't in it yet."""
    return pool.unionByName(extra.join(pool.select(file_col).distinct(), file_col, "left_anti"))


def group_sources(matches: DataFrame, file_col: str, most_pages: int = 50) -> DataFrame:
    """A row for each query and file among its matches (k at most): snippets in order, and the pages of its chunks (at most 50 of a range)."""
    pages = F.when(F.col("page_start") > 0, F.sequence("page_start", F.least(F.greatest("page_end", "page_start"), F.col("page_start") + most_pages - 1))).otherwise(F.array().cast("array<int>"))
    return matches.groupBy("query_id", file_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", T.snippet(F.col("text")).alias("s")))), lambda x: x["s"]).alias("snippets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))).alias("pages")
    )


def mean_by_file(vectors: DataFrame, file_col: str, vec_col: str) -> DataFrame:
    """Element-wise mean and L2 norm of a file's vectors; a tiny mean stays as it is."""
    flat = vectors.select(file_col, F.posexplode(vec_col).alias("i", "x"))
    mean = flat.groupBy(file_col, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy(file_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"))
    size = norm("vec")
    return packed.withColumn("vec", F.when(size > 1e-12, F.transform("vec", lambda x: x / size)).otherwise(F.col("vec")))



def content_preview(chunks: DataFrame, file_col: str, most: int) -> DataFrame:
    """(file, preview): a file's leading chunks, single-spaced, cut after so many characters; files without text have none."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy(file_col).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = chunks.filter("text is not null").withColumn("before", before).filter(F.col("before") <= most)
    flat = F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " "), r"\s+", " "))
    p = c.groupBy(file_col).agg(flat.alias("flat")).filter("flat <> ''")
    return p.select(file_col, F.when(F.length("flat") > most, F.concat(F.trim(F.substr("flat", F.lit(1), F.lit(most))), F.lit("…"))).otherwise(F.col("flat")).alias("preview"))
