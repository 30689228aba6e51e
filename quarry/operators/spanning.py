"""Minimum spanning forests of the near pairs within groups of files, and what follows from them.

Members are (group, id, file_name, vec, name_only); ids are unique over all groups. Two
members may be joined if their unit vectors are within a distance and, where either has
nothing but its name, the names share a token.

Groups are cut into blocks of members, a pair of blocks to a task. A task keeps the
minimum spanning forest of its own pairs: any other edge is the largest of a cycle there,
hence of a cycle of the whole, so it is in no minimum spanning forest. What is left are
fewer edges than twice a block for a pair of blocks. Groups of one block are done; the
others are put together in Borůvka rounds: every tree chooses its least edge, trees that
chosen edges connect become one, until no edge leaves a tree. Edges are ordered by
(distance in millionths, a, b), so the forest is unique.

Null, zero and malformed vectors have no edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.reorg import BLOCK, name_tokens
from quarry.plans.components import components
from quarry.plans.workspace import Workspace

CLUSTER_DISTANCE = 0.22
GROUP_SIMILARITY = 0.65


def shared_tokens(tokens: pd.Series) -> np.ndarray:
    """How many tokens each pair of members shares."""
    words = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
    has = np.zeros((len(tokens), len(words) + 1), dtype=np.float32)
    for i, t in enumerate(tokens):
        has[i, [words[w] for w in t]] = 1
    return has @ has.T


def unit_matrix(vecs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the most frequent length, and which members have one."""
    size = [0 if v is None else len(v) for v in vecs]
    most = max(set(size) - {0}, key=lambda n: (size.count(n), n), default=0)
    x = np.array([v if n == most else np.zeros(most) for v, n in zip(vecs, size)], dtype=np.float64).reshape(len(size), most)
    ok = np.isfinite(x).all(1) & x.any(1)
    x[~ok] = 0
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1), ok


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Which of the edges, in their order, join two trees of n nodes."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for e, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
        r, s = root(p), root(q)
        if r != s:
            up[r] = s
            out.append(e)
            if len(out) == n - 1:
                break
    return out


def _block_edges(distance: float):
    most = round(distance * 1e6)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        x, ok = unit_matrix(f["vec"])
        micro = np.rint((1 - np.clip(x @ x.T, -1, 1)) * 1e6).astype(np.int64)
        only = f["name_only"].fillna(False).to_numpy(bool)
        own = f["own"].to_numpy()
        near = np.triu(micro <= most, 1) & ok[:, None] & ok
        near &= ~(only[:, None] | only) | (shared_tokens(f["tokens"]) > 0)
        if key[1] != key[2]:
            near &= own[:, None] != own
        i, j = np.nonzero(near)
        order = np.lexsort((j, i, micro[i, j]))  # rows go by id, so places are in the order of ids
        i, j = i[order], j[order]
        kept = _forest(i, j, len(f))
        i, j = i[kept], j[kept]
        ids = f["id"].to_numpy()
        return pd.DataFrame({"group": key[0], "a": ids[i], "b": ids[j], "micro": micro[i, j], "blocks": f["blocks"].iloc[0]})

    return run


def _edges(members: DataFrame, distance: float, block: int) -> DataFrame:
    n = members.groupBy("group").agg(F.count("*").alias("members"))
    m = members.filter("id is not null").join(n, "group").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    m = m.select("group", F.col("id").cast("long").alias("id"), "blocks", F.coalesce("name_only", F.lit(False)).alias("name_only"), name_tokens(F.col("file_name")).alias("tokens"), F.col("vec").cast("array<double>").alias("vec"))
    m = m.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return m.groupBy("group", "lo", "hi").applyInPandas(_block_edges(distance), "group string, a long, b long, micro long, blocks int")


def forest(members: DataFrame, distance: float = CLUSTER_DISTANCE, ws: Workspace | None = None, block: int = BLOCK, rounds: int = 64) -> DataFrame:
    """(group, a, b, micro): the edges of each group's minimum spanning forest within a distance."""
    ws = ws or Workspace(members.sparkSession, "forest")
    edges = ws.stage(_edges(members, distance, block), "edges")
    tree = edges.filter("blocks = 1").select("group", "a", "b", "micro")
    live = ws.stage(edges.filter("blocks > 1").select("group", "a", "b", "micro", F.col("a").alias("p"), F.col("b").alias("q")), "live")
    for _ in range(rounds):
        if live.isEmpty():
            return tree
        edge = F.struct("micro", "a", "b", "p", "q", "group").alias("e")
        ends = live.select(F.col("p").alias("tree"), edge).union(live.select(F.col("q").alias("tree"), edge))
        chosen = ws.stage(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
        tree = tree.union(chosen.select("group", "a", "b", "micro"))
        now = components(chosen, "p", "q", ws)
        for end in ("p", "q"):
            live = live.join(now.select(F.col("node").alias(end), F.col("component").alias("into")), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        live = ws.stage(live.filter("p <> q").select("group", "a", "b", "micro", "p", "q"), "live")
    raise RuntimeError("the forest did not converge")


def clusters(members: DataFrame, distance: float = CLUSTER_DISTANCE, ws: Workspace | None = None, block: int = BLOCK) -> DataFrame:
    """(group, id, cluster, widest): single-linkage clusters, each named by its least id, with its widest tree edge (0 for a loner)."""
    ws = ws or Workspace(members.sparkSession, "gated-clusters")
    tree = ws.stage(forest(members, distance, ws, block), "tree")
    named = ws.stage(components(tree, "a", "b", ws), "named")
    widest = tree.join(named.withColumnRenamed("node", "a"), "a").groupBy("component").agg((F.max("micro") / 1e6).alias("widest"))
    c = members.select("group", F.col("id").cast("long").alias("id")).join(named.withColumnRenamed("node", "id"), "id", "left").join(widest, "component", "left")
    return c.select("group", "id", F.coalesce("component", "id").alias("cluster"), F.coalesce("widest", F.lit(0.0)).alias("widest"))


def cohesion(members: DataFrame, least: float = GROUP_SIMILARITY, ws: Workspace | None = None, block: int = BLOCK) -> DataFrame:
    """(group, members, trees, loosest, spans): whether edges of at least a similarity span a group.

    ``loosest`` is the similarity of the widest edge of its trees (null without an edge). A group of one is spanned, and
    so is one in which a vector is missing: that is no fault of the group.
    """
    edges = forest(members, 1 - least, ws, block).groupBy("group").agg(F.count("*").alias("edges"), F.max("micro").alias("micro"))
    m = members.groupBy("group").agg(F.count("*").alias("members"), F.bool_or(F.col("vec").isNull()).alias("gap"))
    c = m.join(edges, "group", "left").withColumn("trees", F.col("members") - F.coalesce("edges", F.lit(0)))
    return c.select("group", "members", "trees", (1 - F.col("micro") / 1e6).alias("loosest"), (F.col("gap") | (F.col("trees") <= 1)).alias("spans"))
