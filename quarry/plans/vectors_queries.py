"""Queries over embeddings: labels stand in for files and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import vector_index as I
from quarry.operators import vectors as V
from quarry.plans.registry import query, table
from quarry.plans.workspace import Workspace

MEANS = """
flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM flat GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label),
c AS (SELECT label, list(x / size ORDER BY i) AS vec FROM m JOIN n USING (label) GROUP BY label)
"""


@query(f"WITH {MEANS} SELECT label, unnest(range(1, len(vec) + 1)) - 1 AS i, round(unnest(vec), 6) AS x FROM c")
def file_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a file's vectors, normalised."""
    m = V.mean_by_file(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("vec").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


PAIRS = "pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("vec", V.normalise(F.col("embedding")))


@query(
    f"""WITH {PAIRS}, l AS (SELECT a AS vec_id FROM pairs WHERE distance <= 0.62 UNION ALL SELECT b FROM pairs WHERE distance <= 0.62), n AS (SELECT vec_id, count(*) AS links FROM l GROUP BY vec_id),
c AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings)
SELECT vec_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN n USING (vec_id)"""
)
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector: its class of equal vectors, and how many vectors are near it."""
    return V.near_links(_unit(spark, sf_dir), "vec_id", "vec", 0.62).select(F.col("id").alias("vec_id"), F.col("class").alias("class_id"), "links")


@query(
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE distance <= 0.62 UNION ALL SELECT b, a FROM pairs WHERE distance <= 0.62),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT vec_id AS id, least(vec_id, coalesce(min(b), vec_id)) AS cluster FROM embeddings LEFT JOIN r ON r.a = vec_id GROUP BY vec_id"""
)
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage clusters at a threshold."""
    return V.clusters(_unit(spark, sf_dir), "vec_id", "vec", 0.62)


@query(
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE distance <= 0.62 UNION ALL SELECT b, a FROM pairs WHERE distance <= 0.62),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), k AS (SELECT a, min(b) AS cluster FROM r GROUP BY a)
SELECT cluster, count(*) AS links, max(distance) AS widest, (sum(CAST(round(distance * 1000000) AS BIGINT)) // count(*)) / 1000000 AS mean FROM pairs JOIN k USING (a) WHERE distance <= 0.62 GROUP BY cluster"""
)
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cohesion(_unit(spark, sf_dir), "vec_id", "vec", 0.62)


@query(
    f"""WITH {MEANS}, s AS (SELECT vec_id AS id, c.label AS folder, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.vec), 6) AS sim FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, folder) AS rn FROM s WHERE sim >= 0.3) SELECT id, folder, sim FROM r WHERE rn = 1"""
)
def folder_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best folder of each file; labels are folders."""
    e = table(spark, sf_dir, "embeddings")
    centres = V.mean_by_file(e, "label", "embedding").select(F.col("label").alias("folder"), "vec")
    return V.best_folder(_unit(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec"), centres, 0.3)


@query(
    f"""WITH {MEANS}, a AS (SELECT c.vec AS v, d.vec AS w, c.label AS label FROM c JOIN c d ON d.label = (c.label + 1) % (SELECT count(*) FROM c)),
f AS (SELECT label, list_transform(list_zip(v, w), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS u FROM a)
SELECT label, round(u[1] / sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS x0, round(u[2] / sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS x1 FROM f"""
)
def fused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and name vectors weighed 0.7 to 0.3; the next file's vector stands in for the name."""
    m = V.mean_by_file(table(spark, sf_dir, "embeddings"), "label", "embedding")
    n = m.count()
    names = m.select((F.pmod(F.col("label") - 1, F.lit(n))).alias("label"), F.col("vec").alias("name_vec"))
    f = m.join(names, "label").withColumn("u", V.fuse("vec", "name_vec"))
    return f.select("label", F.round(F.get("u", F.lit(0)), 6).alias("x0"), F.round(F.get("u", F.lit(1)), 6).alias("x1"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the index finds for every hundredth vector, and what there is."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    model = I.fit(e)
    index = I.build(e, model, Workspace(spark, "index").path("cells"), "vec_id")
    return I.search(index, model, e, queries, id_col="vec_id"), R.top_k(e, queries, id_col="vec_id", key="label")


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by the index; the exact search is ``vector_topk``, and ``vector_index_recall`` compares them."""
    return _indexed(spark, sf_dir)[0]


@query("SELECT vec_id AS query_id, true AS complete FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT NULL, true")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds at least 0.75 of each query's 40 nearest, and 0.9 of all (query_id null)."""
    found, exact = _indexed(spark, sf_dir)
    r = I.recall(exact, found, "vec_id")
    each = r.select("query_id", (F.col("recall") >= 0.75).alias("complete"))
    return each.union(r.agg(F.lit(None).cast("long").alias("query_id"), (F.avg("recall") >= 0.9).alias("complete")))
