"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set holds hashes of its distinct 5-word shingles. Its signature
has 64 symbols of 16 bits, the low bits of 64 minima. Two sets of similarity
0.85 differ in 9.6 symbols on average. The largest distance that is looked at
follows from the percentage that links need: it is the least odd one that
misses a pair just there with a chance of at most ``MISS``. For 85 percent it
is 23 (missed with 8.8e-6), for 80 percent 29 (1.2e-6); closer pairs are missed
more rarely still.

The signature is cut into half as many chunks, 12 for a distance of 23. Two
signatures within the distance have, by the pigeonhole principle, a chunk with
at most one differing symbol; each chunk is therefore indexed once for every
symbol left out, and all such pairs share one of 64 keys. No bucket is capped.

1. Equal sets fold into one representative.
2. The smallest representative of every shared key is found by an aggregation
   with map-side combine; every other one of that key is joined with it (a star,
   not all pairs). Both ends of every pair within the distance are connected by
   such edges.
3. Each representative goes to the smallest one with which it shares most keys,
   in groups of about ``BLOCK``. All pairs of a group are compared, first by
   signature and then on full sets. The components of these links are the
   families; large groups of near copies end up in one family here.
4. Only where star edges lead from one family to another, representatives
   are compared further, and only across families: a large family is cut into
   blocks that never meet each other, small families share blocks, and each other
   pair of blocks is a small group of its own. So a set is sent as often as there
   are blocks outside its own family among the connected ones.
5. The components of all links are the result. Groups return only links that
   join two so far separate trees.

Defined cases: a document without words (or a null text) has an empty set and
is its own component; a text of fewer than five words has one shingle, the
whole sequence. Rows that share a doc_id are one document: they have one
component, to which the links of each of their texts lead; n_shingles is that of
the row's own text. A null doc_id gets the component of its equal texts if they
have one, else null, and is kept only without such. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import arrow_text as at
from quarry.plans.components import components
from quarry.plans.workspace import Workspace, broadcast_if_small

WORDS = 5
SYMBOLS = 64
BLOCK = 192
#: So many rows of placed documents may be broadcast.
PLACES = 300_000
#: What op6 asks for; other callers give their own.
PERCENT = 85
#: The largest chance that the signatures of a pair at the limit lie too far apart.
MISS = 1e-5


def chunks_for(percent: int) -> int:
    """How many chunks of the signature find pairs of this similarity; their distance is up to 2 * chunks - 1."""
    p = percent / 100
    for chunks in range(1, SYMBOLS // 2):
        if sum(math.comb(SYMBOLS, k) * (1 - p) ** k * p ** (SYMBOLS - k) for k in range(2 * chunks, SYMBOLS + 1)) <= MISS:
            return chunks
    raise ValueError(f"signatures of {SYMBOLS} symbols can't find pairs of {percent} percent")


CHUNKS = chunks_for(PERCENT)
MAX_DISTANCE = 2 * CHUNKS - 1

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)


def shingle_sets(t: at.Texts, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    t.data = at.LOWER[t.data]
    w = at.words(t, at.NOT_SPACE)
    h = at.byte_hashes(t.data, w.starts, w.lens)
    out = []
    every = at.shingle_hashes(h, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            x = np.sort(every[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(at.mix(at.shingle_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64 symbols for each set, none of which may be empty."""
    if not sets:
        return np.zeros((0, SYMBOLS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    v = np.empty_like(x)
    for k in range(SYMBOLS):
        np.bitwise_xor(x, _B[k], out=v)
        np.multiply(v, _A[k], out=v)
        out[:, k] = np.minimum.reduceat(v, starts) & np.uint32(0xFFFF)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for t in at.slices(batch.column(1)):
            sets = shingle_sets(t)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full])):
                sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(t.first, len(t)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(sig, pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sig"],
            )


def _chunks(chunks: int) -> list[list[int]]:
    return [list(map(int, c)) for c in np.array_split(np.arange(SYMBOLS), chunks)]


def index_keys(sigs: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """Keys of each signature: for every chunk and every symbol of it left out, a hash of the others."""
    out = []
    for c, chunk in enumerate(_chunks(chunks)):
        for left in chunk:
            h = np.full(len(sigs), c * 1000 + left + 1, np.uint64)
            for s in chunk:
                if s != left:
                    h = at.mix(h * at.BASE + sigs[:, s].astype(np.uint64))
            out.append(h)
    return np.stack(out, 1)


def _keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = index_keys(sigs, chunks).view(np.int64)
                ids = np.repeat(np.asarray(part.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], ["doc_id", "key"])

    return run


def _sets(text_at: int):
    """The rows with their last column, the text, replaced by its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in at.slices(batch.column(text_at)):
                sets = shingle_sets(t)
                names = [*batch.schema.names[:text_at], "members"]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(t.first, len(t)) for c in range(text_at)] + [pa.array([s.tobytes() for s in sets], pa.binary())], names)

    return run


class _Trees:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def links(ids: list, side: np.ndarray, sets: list[np.ndarray], across: bool, percent: int = PERCENT, family: np.ndarray | None = None) -> list[tuple]:
    """Confirmed links between the rows (across: only between the two sides) that join separate trees.

    With families, rows of one family are not compared.
    """
    sigs, most = signatures(sets), 2 * chunks_for(percent) - 1
    sizes = np.array([len(s) for s in sets])
    tree, found, out = _Trees(len(ids)), [], []
    left = np.flatnonzero(side == 0) if across else np.arange(len(ids))
    right = np.flatnonzero(side == 1) if across else left
    for n, a in enumerate(left):
        rest = right if across else right[n + 1 :]
        if family is not None:
            rest = rest[family[rest] != family[a]]
        rest = rest[(100 * sizes[rest] >= percent * sizes[a]) & (100 * sizes[a] >= percent * sizes[rest])]
        if not len(rest):
            continue
        far = (sigs[rest] != sigs[a]).sum(1)
        near = np.flatnonzero(far <= most)
        found += zip(far[near].tolist(), [int(a)] * len(near), rest[near].tolist())
    for _, a, b in sorted(found):
        x, y = tree.root(a), tree.root(b)
        if x == y:
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            tree.join(x, y)
            out.append((ids[a], ids[b]))
    return out


def _links(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows of cluster, bi, bj, block, family, doc_id and members, sorted by the first three: one group is held at a time."""
    key, rows = None, []

    def done():
        got = []
        if len(rows) > 1:
            block, family, doc, members = zip(*rows)
            sets = [np.frombuffer(m, np.uint64) for m in members]
            families = None if family[0] is None else np.array(family)
            got = links(list(doc), (np.array(block) != key[1]).astype(int), sets, key[1] != key[2], percent, families)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

    for batch in batches:
        cluster, bi, bj, *rest = (batch.column(i).to_pylist() for i in range(7))
        for now, row in zip(zip(cluster, bi, bj), zip(*rest)):
            if now != key:
                if len(rows) > 1:
                    yield done()
                key, rows = now, []
            rows.append(row)
    if len(rows) > 1:
        yield done()


#: A document of one or more groups of a cluster: one for each number from lo to before hi, without those from skip to
#: before after. A group's blocks are that number and the document's own, which is that number itself where block is null.
PLACE = ["doc_id", "family", "cluster", "block", "lo", "hi", "skip", "after"]


def _compare(texts: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links within the groups of staged rows of ``PLACE``."""
    kinds = "doc_id long, family long, cluster long, block int, lo int, hi int, skip int, after int"
    members = texts.join(broadcast_if_small(placed, limit=PLACES), "doc_id").select(*PLACE, "text").mapInArrow(_sets(len(PLACE)), f"{kinds}, members binary")
    others = F.filter(F.sequence("lo", F.col("hi") - 1), lambda o: F.col("skip").isNull() | (o < F.col("skip")) | (o >= F.col("after")))
    spread = members.withColumn("other", F.explode(others)).withColumn("block", F.coalesce("block", "other"))
    spread = spread.select("cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "family", "doc_id", "members")
    spread = spread.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
    return spread.mapInArrow(lambda batches: _links(batches, percent), "a long, b long")


def _near_groups(stars: DataFrame) -> DataFrame:
    """Every document with the smallest one with which it shares most keys; that one is in all groups around it."""
    nearest = stars.groupBy("doc_id").agg(F.max_by("low", F.struct("n", F.negative("low"))).alias("low"))
    around = nearest.groupBy("low").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    no = F.lit(None).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    own = nearest.join(around, "low").select("doc_id", F.lit(None).cast("long"), "low", block.alias("block"), block.alias("lo"), (block + 1).alias("hi"), no, no)
    middle = around.select("low", F.lit(None).cast("long"), "low", no, F.lit(0), "blocks", no, no)
    return own.union(middle).toDF(*PLACE)


def _cross_groups(stars: DataFrame, families: DataFrame, ws: Workspace) -> DataFrame | None:
    """Blocks of families between which star edges lead (None if there are no such edges)."""
    x, y = (families.select(F.col("node").alias(c), F.col("component").alias(f)) for c, f in (("doc_id", "x"), ("low", "y")))
    # A document in no link is a family of its own.
    edges = stars.join(x, "doc_id", "left").join(y, "low", "left").select(F.coalesce("x", "doc_id").alias("x"), F.coalesce("y", "low").alias("y"))
    edges = ws.stage(edges.filter("x <> y").distinct(), "between")
    if edges.isEmpty():
        return None
    clusters = ws.stage(components(edges, "x", "y", ws).select(F.col("node").alias("family"), F.col("component").alias("cluster")), "clusters")
    members = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    alone = clusters.join(members.select("family").distinct(), "family", "left_anti").select(F.col("family").alias("doc_id"), "family", "cluster")
    docs = ws.stage(members.join(clusters, "family").select("doc_id", "family", "cluster").union(alone), "between-members")
    sizes = docs.groupBy("cluster", "family").agg(F.count("*").alias("n"))
    small = F.col("n") < BLOCK
    # Small families share the first blocks of a cluster; then each large one has a range of its own. The window sees a
    # row for each large family, so it is at least BLOCK times smaller than the cluster.
    shared = sizes.groupBy("cluster").agg(F.ceil(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)) / BLOCK).cast("int").alias("shared"))
    large = sizes.filter(~small).select("cluster", "family", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    large = large.withColumn("end", F.sum("k").over(W.partitionBy("cluster").orderBy("family")).cast("int"))
    total = shared.join(large.groupBy("cluster").agg(F.sum("k").cast("int").alias("own")), "cluster", "left").select("cluster", "shared", (F.col("shared") + F.coalesce("own", F.lit(0))).alias("hi"))
    placed = docs.join(total, "cluster").join(large, ["cluster", "family"], "left").withColumn("after", F.col("shared") + F.col("end")).withColumn("skip", F.col("after") - F.col("k"))
    block = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("family"), F.col("shared"))).otherwise(F.col("skip") + F.pmod(F.xxhash64("doc_id"), F.col("k"))).cast("int")
    return placed.withColumn("block", block).withColumn("lo", F.lit(0)).select(PLACE)


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module's text); links need this percentage."""
    ws = Workspace(spark, "minhash")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    feats = ws.stage(texts.mapInArrow(_features, "doc_id long, n_shingles long, digest binary, sig binary"), "features")

    reps = feats.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    reps = ws.stage(reps, "representatives")
    # Ids of several rows with different sets: all their representatives belong together.
    ids = feats.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max(F.col("digest").isNull()).alias("bare"))
    mixed = ws.stage(ids.filter("lo is not null and (lo <> hi or bare)").select("doc_id", "lo"), "mixed-ids")
    n_mixed = mixed.count()
    none = spark.createDataFrame([], "a long, b long")
    same = none
    if n_mixed:
        several = feats.filter("digest is not null").join(broadcast_if_small(mixed.select("doc_id"), n_mixed), "doc_id").select("doc_id", "digest")
        mine = several.join(reps.select("digest", "rep"), "digest").select("doc_id", "rep")
        same = ws.stage(mine.join(mine.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").distinct(), "same-ids")

    keys = reps.select("rep", "sig").mapInArrow(_keys(chunks_for(percent)), "doc_id long, key long")
    first = ws.stage(keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key", "low"), "shared-keys")
    stars = ws.stage(keys.join(broadcast_if_small(first), "key").filter("doc_id <> low").groupBy("doc_id", "low").agg(F.count("*").alias("n")), "stars")

    ws.drop(first)
    near = ws.stage(_compare(texts, ws.stage(_near_groups(stars), "near-groups"), percent).union(same), "links")
    comps = ws.stage(components(near, "a", "b", ws), "families")
    across = _cross_groups(stars, comps, ws)  # staged, so the stars can go
    ws.drop(stars)
    if across is not None:
        more = ws.stage(_compare(texts, ws.stage(across, "cross-groups"), percent), "cross-links")
        if not more.isEmpty():
            comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b", ws)

    named = reps.select("digest", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    if n_mixed:
        own = mixed.join(named.withColumnRenamed("digest", "lo"), "lo").select("doc_id", F.col("component").alias("own"))
        out = out.join(broadcast_if_small(ws.stage(own, "components-of-mixed-ids"), n_mixed), "doc_id", "left")
        component = F.coalesce("own", "component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("component").isNull()).alias("kept"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
