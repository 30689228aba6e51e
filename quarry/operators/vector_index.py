"""An inverted-file index for nearest vectors, with residual codes and exact re-ranking.

``fit`` draws a bounded sample of unit vectors by hash (``SAMPLE``), clusters it into cells (k-means on angles) and takes
the spread of what is left of a vector after its cell's centre, dimension by dimension. ``build`` gives every vector a row
(cell, id, code): its cell and the rest in one byte a dimension, written in the order of cells, so that a search's
filter on cells skips row groups. A search looks into the nearest cells of each query only, ranks by codes, and compares
the best ``OVER`` times k exactly.

How many cells have to be looked into depends on the vectors (near random ones need many), so it is measured: for some of
the sample's vectors the nearest of the sample are found exactly, and the index looks into as many cells as it takes to
find the share ``RECALL`` of them. The exact search (``retrieval.top_k``) stays.

Vectors that are null, zero, malformed or of another length than most of the sample have no row, as they are near to
nothing; rows without id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.retrieval import QUERY_BLOCK, TOP_K, by_length, closest, unit_rows
from quarry.plans.workspace import Workspace, broadcast_if_small

SAMPLE = 32_768
#: Vectors of the sample to a cell, and the most cells; a centre and its broadcast copy take 8 bytes a dimension.
PER_CELL, CELLS = 16, 2048
ROUNDS = 12
TRIALS = 256
RECALL = 0.97
OVER = 4


@dataclass
class Model:
    """Unit centres of the cells, a step per dimension for the codes, and the number of cells to look into."""

    centres: np.ndarray
    step: np.ndarray
    probes: int

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (x @ self.centres.T).argmax(1)
        return cell.astype(np.int32), np.clip(np.rint((x - self.centres[cell]) / self.step), -127, 127).astype(np.int8)

    def near(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query looks into, as a matrix of booleans."""
        s = q @ self.centres.T
        out = np.zeros(s.shape, bool)
        np.put_along_axis(out, np.argpartition(-s, self.probes - 1, 1)[:, : self.probes], True, 1)
        return out


def _cells(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        some = size > 1e-12  # an empty cell keeps its centre
        centres[some] = total[some] / size[some, None]
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The least number of cells in which the share RECALL of the nearest vectors lies, over some of the sample as queries."""
    n = min(TRIALS, len(x))
    q = x[:n]
    s = q @ x.T
    s[np.arange(n), np.arange(n)] = -2
    nearest = np.argsort(-s, 1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(q @ centres.T), 1).argsort(1)  # each cell's place for a query
    place = np.sort(np.take_along_axis(order, (x @ centres.T).argmax(1)[nearest], 1).ravel())
    return int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))))]) + 1 if len(place) else 1


def fit(vectors: DataFrame, vec_col: str = "embedding", k: int = TOP_K, sample: int = SAMPLE, seed: int = 7) -> Model | None:
    """A model from at most about ``sample`` vectors, chosen by hash; None if no row has a vector."""
    v = vectors.select(F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    rows = v.count()
    share = min(1.0, sample / max(1, rows))
    some = v.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample).toArrow()  # the limit binds only if one vector fills the sample
    if not some.num_rows:
        return None
    groups = by_length(np.arange(some.num_rows), some.column("v").combine_chunks())
    if not groups:
        return None
    x = np.unique(max(groups, key=lambda g: len(g[0]))[1], axis=0)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    centres = _cells(x, max(1, min(CELLS, len(x) // PER_CELL)), rng)
    rest = x - centres[(x @ centres.T).argmax(1)]
    step = np.maximum(np.abs(rest).max(0), 1e-6) * 1.25 / 127  # vectors outside of the sample may lie a little farther
    return Model(centres, step, _probes(x, centres, k))


def build(vectors: DataFrame, model: Model, path: str, id_col: str = "chunk_id", vec_col: str = "embedding", files: int | None = None) -> DataFrame:
    """Write the index of all vectors and return it: (cell, id, code)."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)  # CELLS centres at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, ok = unit_rows(part.column(1), m.centres.shape[1])
                cell, code = m.code(x)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.centres.shape[1]), len(x), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0).filter(pa.array(ok)), codes], ["cell", "id", "code"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    coded = rows.mapInArrow(run, "cell int, id long, code binary")
    # Ranges of (cell, hash of id): a cell that holds most vectors is split over files.
    spread = coded.withColumn("spot", F.xxhash64("id"))
    spread = spread.repartitionByRange(files, "cell", "spot") if files else spread.repartitionByRange("cell", "spot")
    spread.sortWithinPartitions("cell").drop("spot").write.parquet(path)
    return spark.read.schema("cell int, id long, code binary").parquet(path)


def _scan(shared, k: int):
    """The best rows of a partition by their codes for each query that looks into their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, names, q, looks = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(len(ids), -1)
            for c in np.unique(cell).tolist():
                rows, mine = np.flatnonzero(cell == c), np.flatnonzero(looks[:, c])
                for a in range(0, len(rows) if len(mine) else 0, 1024):
                    r = rows[a : a + 1024]
                    x = m.centres[c] + code[r] * m.step
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    none = np.zeros((len(mine), 0), np.int64)
                    d, i = closest(q[mine], x, ids[r], k, none, none)
                    for n, dn, i_n in zip(mine.tolist(), d, i):
                        had = best.get(n)
                        best[n] = (dn, i_n) if had is None else (np.concatenate([had[0], dn]), np.concatenate([had[1], i_n]))
                        if len(best[n][0]) > 4 * k:
                            best[n] = _least(*best[n], k)
        for n, (d, i) in best.items():
            d, i = _least(d, i, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), names[n])), pa.array(i), pa.array(d)], ["query_id", "id", "rough"])

    return run


def _least(d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((i, d))[:k]
    return d[order], i[order]


def search(index: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "chunk_id", vec_col: str = "embedding", over: int = OVER) -> DataFrame:
    """(query_id, the vector's id, distance, pos): for each query (query_id, vector) about its k nearest, distances exact.

    Queries come in broadcast blocks. Of each block, cells that no query looks into are filtered out of the scan.
    """
    spark: SparkSession = index.sparkSession
    ws = Workspace(spark, "vector-index")
    asked = ws.stage(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q")).filter("query_id is not null and q is not null"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = [index.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0).cast("long").alias("rough"))]
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        for names, q in by_length(own.column("query_id").to_numpy(), own.column("q").combine_chunks()) if own.num_rows else []:
            if q.shape[1] != model.centres.shape[1]:
                continue
            looks = model.near(q)
            cells = np.flatnonzero(looks.any(0)).tolist()
            part = index if len(cells) == len(model.centres) else index.filter(F.col("cell").isin(cells))
            found.append(part.mapInArrow(_scan(spark.sparkContext.broadcast((model, names, q, looks)), over * k), "query_id long, id long, rough long"))
    rough = ws.stage(reduce(DataFrame.union, found), "rough")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rough", "id"))
    some = ws.stage(rough.withColumn("nth", nth).filter(F.col("nth") <= over * k).select("query_id", "id"), "candidates")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))))
    exact = v.join(broadcast_if_small(some), "id").join(broadcast_if_small(asked, limit=50_000), "query_id").select("query_id", "id", F.rint((1 - cosine) * 1e6).cast("long").alias("micro"))
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("micro", "id")).cast("long")
    return exact.withColumn("pos", pos).filter(F.col("pos") <= k).select("query_id", F.col("id").alias(id_col), (F.col("micro") / 1e6).alias("distance"), "pos")


def recall(exact: DataFrame, found: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, recall): the share of the exact search's rows that were found."""
    hit = found.select("query_id", id_col, F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", id_col], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
