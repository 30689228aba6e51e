"""File vectors, threshold clusters and folder fit.

Near vectors are found exactly. Equal vectors fold into one. Up to ``PIVOTS``
vectors chosen by hash are pivots; each vector is at home in the cell of the
nearest one. Angles obey the triangle inequality, so a vector has to visit a cell
only if its angle to the pivot is within the cell's radius and the limit; of two
cells, the vectors of the first visit the second. Cells are cut into blocks of
about ``BLOCK``, and neighbouring blocks put together into up to ``GROUPS`` groups
(more only where a group would be larger than ``HELD`` bytes), so a vector is sent
to so many tasks at most, however many vectors there are. A task holds one group and
streams its visitors past the blocks that each has to visit; of the pairs it finds,
it gives what is asked for: the pairs themselves, those that join separate trees,
counts per vector, or sums per cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import by_length, matrix, mean_by_file, norm, unit_rows
from quarry.plans.components import components
from quarry.plans.workspace import Workspace, broadcast_if_small

CLUSTER_DISTANCE = 0.22
FOLDER_SIMILARITY = 0.70
BLOCK = 2048
PIVOTS = 1024
#: Groups of blocks; what a task holds of one, in bytes of its vectors.
GROUPS, HELD = 48, 32 << 20
#: Folders whose vectors are broadcast at a time.
FOLDER_BLOCK = 4096


def normalise(c: Column) -> Column:
    size = norm(c)
    return F.when(size > 1e-12, F.transform(c, lambda x: x.cast("double") / size)).otherwise(F.transform(c, lambda x: x.cast("double")))


def fuse(content: str, name: str, w: float = 0.7) -> Column:
    """Weighted sum of two vectors, normalised; the one there is if the other is null."""
    both = F.zip_with(content, name, lambda a, b: w * a + (1 - w) * b)
    return normalise(F.when(F.col(content).isNull(), F.col(name)).when(F.col(name).isNull(), F.col(content)).otherwise(both))


def similarity(a: str | Column, b: str | Column) -> Column:
    """Inner product of unit vectors, clamped to [-1, 1]."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _home(shared):
    """Adds each vector's cell and its angle to the pivot; a zero vector has no direction and is at home nowhere (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = matrix(part.column(1))
                angle = _angles(x, pivots)
                cell = np.where(x.any(1), angle.argmin(1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(angle.min(1))], names=[*part.schema.names, "cell", "angle"])

    return run


class _Layout:
    """Blocks in the order of their cells, and the group of each."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray, theta: float):
        self.pivots, self.radius, self.theta = pivots, radius, theta
        self.blocks = -(-sizes // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])  # a cell's first block
        self.cell = np.repeat(np.arange(len(sizes)), self.blocks)
        rows = np.repeat(sizes / np.maximum(self.blocks, 1), self.blocks)
        most = max(BLOCK, min(-(-int(sizes.sum()) // GROUPS), HELD // (8 * max(1, pivots.shape[1]))))
        self.group = (np.cumsum(rows) // most).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.groups = int(self.group[-1]) + 1 if len(rows) else 1

    def home(self, cell: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """The block that each vector is at home in; -1 without a cell."""
        return np.where(cell >= 0, self.first[cell] + spot % np.maximum(self.blocks[cell], 1), -1)

    def open(self, x: np.ndarray, cell: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector has to visit each of the cells: later ones in reach, and its own (the later blocks of it)."""
        near = (_angles(x, self.pivots[cells]) <= self.radius[cells] + self.theta) | (cell < 0)[:, None]
        return near & (cells > cell[:, None]) | (cells == cell[:, None])


def _visits(shared):
    """A row for each group that a vector is at home in (side 0) or visits (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Layout = shared.value
        cells = np.flatnonzero(at.blocks)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                x, cell = matrix(part.column(1)), np.asarray(part.column("cell")).astype(np.int64)
                home = at.home(cell, np.asarray(part.column("spot")))
                row, c = np.nonzero(at.open(x, cell, cells))
                lo, hi = np.maximum(at.first[cells[c]], home[row] + 1), at.first[cells[c] + 1]  # the blocks that are visited
                row, lo, hi = (v[lo < hi] for v in (row, lo, hi))
                steps = np.zeros((len(x), at.groups + 1), np.int32)  # up where a run of groups begins, down after it
                np.add.at(steps, (row, at.group[lo]), 1)
                np.add.at(steps, (row, at.group[hi - 1] + 1), -1)
                near = steps[:, :-1].cumsum(1) > 0
                own = np.where(home >= 0, at.group[home], -1) if len(at.group) else home
                near[np.flatnonzero(home >= 0), own[home >= 0]] = True
                row, group = np.nonzero(near)
                got = part.take(pa.array(row, pa.int64()))
                more = (home[row], group, group != own[row])
                yield pa.RecordBatch.from_arrays([*(got.column(n) for n in ("id", "v", "copies", "label", "cell")), *(pa.array(m.astype(np.int32)) for m in more)], names=["id", "v", "copies", "label", "cell", "home", "grp", "side"])

    return run


class _Trees:
    """Union-find over ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def joined(self, a: int, b: int) -> bool:
        """Whether this joins two so far separate trees."""
        x, y = self._root(a), self._root(b)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def _root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y]
            x = y
        return x


SHAPES = {"pairs": "a long, b long, micro long", "trees": "a long, b long", "counts": "id long, n long", "sums": "label long, links long, widest long, micro decimal(38,0)"}


def _compare(shared, distance: float, give: str):
    """Rows of ``_visits`` sorted by (grp, side, home): a group is held, its visitors pass."""
    most = round(distance * 1e6)

    def found(one, block, trees):
        """What pairs between some vectors and a block's (or within the block) give: each (ids, vectors, copies, labels)."""
        ids, x, copies, labels = one
        hid, hx, hcopies, _ = block
        d = np.rint((1 - np.clip(x @ hx.T, -1, 1)) * 1e6).astype(np.int64)
        near = d <= most
        if one is block:
            near &= np.arange(len(ids))[:, None] < np.arange(len(ids))
        i, j = np.nonzero(near)
        if give == "counts":
            return [np.concatenate([ids[i], hid[j]]), np.concatenate([hcopies[j], copies[i]])]
        if give == "sums":
            w = copies[i] * hcopies[j]
            return [labels[i], w, d[i, j], d[i, j] * w]
        a, b = np.minimum(ids[i], hid[j]), np.maximum(ids[i], hid[j])
        if give == "pairs":
            return [a, b, d[i, j]]
        keep = np.array([trees.joined(p, q) for p, q in zip(a.tolist(), b.tolist())], bool)
        return [a[keep], b[keep]]

    def out(cols):
        if give == "counts":
            ids, where = np.unique(cols[0], return_inverse=True)
            cols = [ids, np.bincount(where, cols[1], len(ids)).astype(np.int64)]
        elif give == "sums":
            labels, where = np.unique(cols[0], return_inverse=True)
            widest = np.zeros(len(labels), np.int64)
            np.maximum.at(widest, where, cols[2])
            micro = [int(m) for m in np.bincount(where, cols[3], len(labels))]
            return pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.bincount(where, cols[1], len(labels)).astype(np.int64)), pa.array(widest), pa.array(micro, pa.decimal128(38, 0))], ["label", "links", "widest", "micro"])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [n.split()[0] for n in SHAPES[give].split(", ")])

    def columns(t):
        v = t.column("v")
        return np.asarray(t.column("id")), matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v), np.asarray(t.column("copies")), np.asarray(t.column("label"))

    def meet(part, home, cell, blocks, trees):
        """Vectors, in slices of up to 1024, with those later blocks of the held ones that they have to visit."""
        at: _Layout = shared.value
        cells = np.unique(at.cell[[b for b, _ in blocks]])
        reach = at.open(part[1], cell, cells)
        for b, block in blocks:
            if block is part:
                yield found(part, part, trees)
                continue
            mine = np.flatnonzero(reach[:, np.searchsorted(cells, at.cell[b])] & (home < b))
            if len(mine):
                yield found(part if len(mine) == len(home) else tuple(c[mine] for c in part), block, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Layout = shared.value
        key, held, blocks, trees = None, [], None, None

        def settle():
            nonlocal held, blocks
            t = pa.Table.from_batches(held)
            held, home, cell, rows = [], np.asarray(t.column("home")), np.asarray(t.column("cell")).astype(np.int64), columns(t)
            cuts = np.flatnonzero(np.diff(home, prepend=home[:1] - 1)).tolist()
            spans = list(zip(cuts, [*cuts[1:], len(home)]))
            blocks = [(int(home[a]), tuple(c[a:b] for c in rows)) for a, b in spans]
            for k, (a, b) in enumerate(spans):
                for got in meet(blocks[k][1], home[a:b], cell[a:b], blocks[k:], trees):
                    if len(got[0]):
                        yield out(got)

        for batch in batches:
            group, side = np.asarray(batch.column("grp")), np.asarray(batch.column("side"))
            cuts = np.flatnonzero((np.diff(group, prepend=group[:1] - 1) != 0) | (np.diff(side, prepend=side[:1]) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if int(group[a]) != key:
                    if held:
                        yield from settle()
                    key, held, blocks, trees = int(group[a]), [], None, _Trees()
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append(part)
                    continue
                if held:
                    yield from settle()
                for s in range(0, part.num_rows if blocks else 0, 1024):
                    v = part.slice(s, 1024)
                    for got in meet(columns(v), np.asarray(v.column("home")), np.asarray(v.column("cell")).astype(np.int64), blocks, trees):
                        if len(got[0]):
                            yield out(got)
        if held:
            yield from settle()

    return run


class Near:
    """Unit vectors with all that lie within a distance of each other; nulls are left out.

    Vectors of another length than most, or with something that is no finite number, are near nothing, not even their like.
    ``reps`` has a row for each different vector: id (the smallest), v, copies.
    """

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, distance: float):
        self.distance, self.ws = distance, Workspace(vectors.sparkSession, "near")
        v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
        v = self.ws.stage(v, "vectors")
        size = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
        size = size["n"] if size else 0
        well = (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        key = F.when(well, F.sha2(F.col("v").cast("string"), 256)).otherwise(F.sha2(F.concat(F.lit("malformed "), F.col("id").cast("string")), 256))
        self.members = self.ws.stage(v.select("id", F.when(well, F.col("v")).otherwise(F.array_repeat(F.lit(0.0), size)).alias("v"), key.alias("key")), "members")
        folded = self.members.groupBy("key").agg(F.min("id").alias("id"), F.min("v").alias("v"), F.count("*").alias("copies"))
        self.reps = self.ws.stage(folded, "different")
        self._homes()

    def _homes(self) -> None:
        spark = self.reps.sparkSession
        rows = self.reps.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, math.isqrt(self.reps.count())))).toArrow()
        self.pivots = matrix(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((1, 0))
        at_home = self.reps.select("id", "v", "copies", F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1)).alias("spot"))
        if rows.num_rows:
            at_home = at_home.mapInArrow(_home(spark.sparkContext.broadcast(self.pivots)), "id long, v array<double>, copies long, spot long, cell int, angle double")
        else:
            at_home = at_home.select("*", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
        self.homes = self.ws.stage(at_home, "homes")
        cells = self.homes.filter("cell >= 0").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # PIVOTS rows at most
        self.radius, self.sizes = np.full(len(self.pivots), -4.0), np.zeros(len(self.pivots), np.int64)
        for r in cells:
            self.radius[r["cell"]], self.sizes[r["cell"]] = r["radius"], r["n"]

    def find(self, give: str, labels: DataFrame | None = None) -> DataFrame:
        """What the pairs give (see ``SHAPES``); ``labels`` (id, label) are those that sums go by."""
        rows = self.homes.withColumn("label", F.lit(0).cast("long")) if labels is None else self.homes.join(labels, "id")
        rows = rows.select("id", "v", "copies", "spot", "cell", "label")
        theta = math.acos(max(-1.0, min(1.0, 1 - self.distance - 1e-6))) + 1e-6
        layout = _Layout(self.pivots, self.radius, self.sizes, theta)
        shared = rows.sparkSession.sparkContext.broadcast(layout)
        visits = rows.mapInArrow(_visits(shared), "id long, v array<double>, copies long, label long, cell int, home int, grp int, side int")
        # More partitions than groups, so that few groups share one.
        return visits.repartition(2 * layout.groups, "grp").sortWithinPartitions("grp", "side", "home").mapInArrow(_compare(shared, self.distance, give), SHAPES[give])


def near_pairs(vectors: DataFrame, id_col: str, vec_col: str, distance: float) -> DataFrame:
    """(a, b, distance) of all pairs of different unit vectors within a distance, a < b; equal ones count as the smallest id."""
    return Near(vectors, id_col, vec_col, distance).find("pairs").select("a", "b", (F.col("micro") / 1e6).alias("distance"))


def near_links(vectors: DataFrame, id_col: str, vec_col: str, distance: float) -> DataFrame:
    """For every vector its class (the smallest id of equal ones) and its number of links, copies included."""
    near = Near(vectors, id_col, vec_col, distance)
    n = near.find("counts").groupBy("id").agg(F.sum("n").alias("n"))
    reps = near.ws.stage(near.reps.select("key", "id", "copies").join(n, "id", "left").select("key", F.col("id").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    return near.members.select("id", "key").join(broadcast_if_small(reps, limit=200_000), "key").select("id", "class", "links")


def _clusters(near: Near) -> DataFrame:
    """(key, id, cluster) of the different vectors."""
    ws = near.ws
    comps = components(ws.stage(near.find("trees"), "trees"), "a", "b", ws)
    return ws.stage(near.reps.select("key", "id", "copies").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "copies", F.coalesce("component", "id").alias("cluster")), "clusters")


def clusters(vectors: DataFrame, id_col: str, vec_col: str, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """Single-linkage clusters: (id, cluster), the cluster being its smallest id; a loner is its own."""
    near = Near(vectors, id_col, vec_col, distance)
    return near.members.select("id", "key").join(broadcast_if_small(_clusters(near).select("key", "cluster"), limit=200_000), "key").select("id", "cluster")


def cohesion(vectors: DataFrame, id_col: str, vec_col: str, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """Per cluster with a link: the number of its links, the largest and the mean distance (cut to six digits); copies of a vector are links of distance 0."""
    near = Near(vectors, id_col, vec_col, distance)
    c = _clusters(near)
    sums = near.find("sums", c.select("id", F.col("cluster").alias("label"))).select(F.col("label").alias("cluster"), "links", "widest", "micro")
    copies = c.select("cluster", (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("links"), F.lit(0).cast("long").alias("widest"), F.lit(0).cast("decimal(38,0)").alias("micro")).filter("links > 0")
    both = sums.union(copies).groupBy("cluster").agg(F.sum("links").alias("links"), F.max("widest").alias("widest"), F.sum("micro").alias("micro"))
    return both.select("cluster", "links", (F.col("widest") / 1e6).alias("widest"), (F.floor(F.col("micro") / F.col("links")).cast("long") / 1e6).alias("mean"))


def _best(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x, good = unit_rows(part.column(1), centres.shape[1])
                if not len(x):
                    continue
                sim = np.round(np.clip(x @ centres.T, -1, 1), 6)
                top = sim.argmax(1)  # names ascend: of equals, the smallest
                best = sim[np.arange(len(top)), top]
                ok = best >= least
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)).filter(pa.array(ok)), pa.array(names[top[ok]]), pa.array(best[ok])], ["id", "folder", "sim"])

    return run


def best_folder(files: DataFrame, folders: DataFrame, least: float = FOLDER_SIMILARITY) -> DataFrame:
    """For each (id, vec) the most similar folder (folder, vec) of at least a similarity, the smallest of equals.

    Folders are broadcast in blocks; every block is one pass over the files, and the best of the passes is taken. Vectors
    that are zero, malformed or of another length than a folder's fit none.
    """
    spark = files.sparkSession
    rows = files.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    centres = folders.select(F.col("folder").cast("long").alias("folder"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    centres = Workspace(spark, "folders").stage(centres, "centres")
    blocks = max(1, -(-centres.count() // FOLDER_BLOCK))
    passes = []
    for b in range(blocks):
        own = centres.filter(F.pmod(F.xxhash64("folder"), F.lit(blocks)) == b).orderBy("folder").toArrow()  # about FOLDER_BLOCK rows
        for group in by_length(own.column("folder").to_numpy(), own.column("vec").combine_chunks()) if own.num_rows else []:
            passes.append(rows.mapInArrow(_best(spark.sparkContext.broadcast(group), least), "id long, folder long, sim double"))
    if not passes:
        return rows.limit(0).select("id", F.lit(0).cast("long").alias("folder"), F.lit(0.0).alias("sim"))
    s = reduce(DataFrame.union, passes)
    return s.groupBy("id").agg(F.max_by(F.struct("folder", "sim"), F.struct("sim", F.negative("folder"))).alias("b")).select("id", "b.*")


__all__ = ["Near", "best_folder", "clusters", "cohesion", "fuse", "mean_by_file", "near_links", "near_pairs", "normalise", "similarity"]
