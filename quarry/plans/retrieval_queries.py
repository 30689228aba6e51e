"""Queries of the retrieval path over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import retrieval as R
from quarry.plans.registry import query, table

#: Every vector whose id is divisible by 100 is a query, against all vectors.
NEAR = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT query_id, vec_id, label, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), q.v), 6) AS distance FROM embeddings, q),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS pos FROM near {scope}) WHERE pos <= 40)
"""
CUT = """cut AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS n FROM top),
near2 AS (SELECT *, sum(CASE WHEN distance <= best + 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS kept FROM cut),
rel AS (SELECT * FROM near2 WHERE CASE WHEN kept < 5 AND n >= 5 THEN pos <= 5 ELSE distance <= best + 0.2 END)"""
ROUNDS = """rounds AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY pos) AS r, min(pos) OVER (PARTITION BY query_id, label) AS f FROM {0})
SELECT query_id, vec_id, label, distance, pos, slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, f) AS slot FROM rounds WHERE r <= 4) WHERE slot <= 10"""


def _top(spark: SparkSession, sf_dir: str, scope: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.top_k(e, queries, id_col="vec_id", scope=scope, key="label")


@query(f"WITH {NEAR.format(scope='')} SELECT query_id, vec_id, label, distance, pos FROM top")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir)


@query(f"""WITH {NEAR.format(scope="WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 3 = 0)")}, {CUT}, {ROUNDS.format('rel')}""")
def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core path: scope, top k, relative cut, diversification."""
    scope = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select("label")
    return R.diversify(R.relative_cut(_top(spark, sf_dir, scope), delta=0.2), "label")


@query(f"WITH {NEAR.format(scope='')}, {CUT} SELECT query_id, vec_id, label, distance, pos FROM rel")
def relative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relative_cut(_top(spark, sf_dir), delta=0.2)


@query(f"WITH {NEAR.format(scope='')} SELECT query_id, vec_id, label, distance, pos FROM top WHERE distance <= 1.5")
def absolute_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).filter(F.col("distance") <= R.MAX_DISTANCE)


@query(f"WITH {NEAR.format(scope='')}, {ROUNDS.format('top')}")
def diversify_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diversify(_top(spark, sf_dir), "label")


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
SPLIT = "regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"


def tokens_sql(c: str) -> str:
    """significant_tokens of a lower-cased text."""
    return f"""list_distinct(list_concat(
list_filter(regexp_extract_all({SPLIT.format(f'lower({c})')}, '[a-z0-9]{{4,}}'), lambda t: regexp_matches(t, '[a-z]') AND t NOT IN ({STOP})),
list_filter(regexp_extract_all(lower({c}), '[a-z0-9]{{4,}}'), lambda t: regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND t NOT IN ({STOP}))))"""


def stems_sql(tokens: str) -> str:
    return f"list_distinct(list_transform({tokens}, lambda t: CASE WHEN length(t) >= 5 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END))"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind each query's nearest vectors."""
    return table(spark, sf_dir, "documents").join(_top(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id"), "pos"), "doc_id")


@query(
    f"""WITH {NEAR.format(scope='')}, m AS (SELECT query_id, doc_id, source, text FROM top JOIN documents ON doc_id = vec_id),
a AS (SELECT doc_id AS query_id, {stems_sql(tokens_sql("coalesce(left(text, 60), '')"))} AS q FROM documents WHERE doc_id % 100 = 0),
h AS (SELECT query_id, doc_id, source, list_has_any({stems_sql(tokens_sql("coalesce(text, '')"))}, q) AS hit FROM m LEFT JOIN a USING (query_id)),
f AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id, source) AS file_hit, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit, count(*) OVER (PARTITION BY query_id) AS n FROM h)
SELECT query_id, doc_id, source FROM f WHERE NOT coalesce(any_hit, false) OR n <= 1 OR file_hit"""
)
def lexical_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files, documents as chunks; the beginning of every hundredth document is a question, its matches are what search found."""
    d = table(spark, sf_dir, "documents")
    q = d.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.left("text", F.lit(60)).alias("question"))
    # The source's name has too few letters to be a token; the empty name keeps to chunk texts.
    return R.lexical_focus(_read(spark, sf_dir).withColumn("name", F.lit("")), q, "source", "text", "name").select("query_id", "doc_id", "source")


@query(
    f"""SELECT doc_id, len({tokens_sql("coalesce(text, '')")}) AS n_tokens, len({stems_sql(tokens_sql("coalesce(text, '')"))}) AS n_stems FROM documents"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.significant_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(T.stems(t)).cast("long").alias("n_stems"))


@query(
    r"""WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM benchmark WHERE item_id % 100 = 0),
d AS (SELECT query_id, doc_id, source, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{4,}')), q.t)) AS overlap FROM documents, q),
m AS (SELECT *, max(overlap) OVER (PARTITION BY query_id, source) AS best FROM d)
SELECT query_id, doc_id, source, overlap FROM m WHERE best > 0 AND overlap >= greatest(1, ceil(best * 0.6))"""
)
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    docs = table(spark, sf_dir, "documents").withColumn("name", F.lit(""))
    return R.answer_overlap(docs, a, "doc_id", "source", "text", "name").select("query_id", "doc_id", "source", "overlap")


@query(
    """WITH c AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index FROM embeddings)
SELECT label, vec_id, chunk_index FROM c WHERE chunk_index < 10"""
)
def whole_file_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten chunks of each file."""
    return R.first_chunks(table(spark, sf_dir, "embeddings"), "label", "vec_id", 10).select("label", "vec_id", "chunk_index")
