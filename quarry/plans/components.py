"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with v < u, as edges of the same kind.

    Every node's smallest neighbour comes from an aggregation with map-side
    combine, so a node with very many neighbours is no single task's list.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).withColumn("h", F.hash("u"))
    # With the hash as a second key, the aggregate is exchanged once more and not joined where it was computed: its size
    # is known then, and Spark broadcasts it or splits the rows of a node with very many neighbours over tasks.
    met = both.withColumn("h", F.hash("u")).join(low, ["u", "h"])
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, ws: Workspace, limit: int = 60) -> DataFrame:
    """(node, component): component is the smallest id reachable; only nodes with an edge appear.

    Edges may repeat, come in either direction or be loops. Nulls are ignored.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = ws.stage(e.distinct(), "edges")
    seen = None
    for _ in range(limit):
        nxt = ws.stage(_star(_star(e, True), False), "edges")
        sign = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(e)
        e = nxt
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
