"""Queries of injection and reorganisation over documents, embeddings, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import injection as I
from quarry.operators import reorg as R
from quarry.operators import vectors as V
from quarry.plans.library_queries import FILES, files_of
from quarry.plans.registry import query, table
from quarry.plans.retrieval_queries import NEAR, _top

#: Questions of three shapes, by the query's number: each asks for other injections.
ASKED = ["Compare all the bank statements, agreements and lease notices: which are unpaid?", "Which notices and invoices of any lease are the same?", "What is outstanding?"]
POOL = f"""{NEAR.format(scope='')}, {FILES}, asked AS (SELECT vec_id AS query_id, vec_id // 100 % 3 AS shape FROM embeddings WHERE vec_id % 100 = 0),
rest AS (SELECT query_id, shape, files.* FROM asked, files WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = asked.query_id AND vec_id = doc_id) AND NOT regexp_matches(file_name, '(^|[^a-z0-9])template([^a-z0-9]|$)', 'i'))"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What search found for every hundredth vector, all files, and the questions."""
    f = files_of(spark, sf_dir).withColumn("doc_type", F.when(F.col("lang") == "de", "Notice")).withColumn("entity", F.concat(F.lit("lease "), "source"))
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    shape = (F.floor(F.col("query_id") / 100) % 3 + 1).cast("int")
    return _top(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id")), f, q.withColumn("question", F.element_at(F.array(*map(F.lit, ASKED)), shape))


@query(
    f"""WITH {POOL}, k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY size DESC, file_name, doc_id) AS place FROM rest WHERE (shape = 0 AND (doc_id % 6 IN (1, 3) OR lang = 'de')) OR (shape = 1 AND lang = 'de'))
SELECT * FROM k WHERE place <= 8"""
)
def kind_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest files of the kinds that each question names, beside what search found for it."""
    pool, f, q = _pool(spark, sf_dir)
    return I.by_kind(pool, f, q, "doc_id").select("query_id", "doc_id", "place")


@query(
    f"""WITH {POOL}, covered AS (SELECT DISTINCT query_id, source FROM top JOIN files ON doc_id = vec_id WHERE doc_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lower(file_name) END ORDER BY size DESC, file_name, doc_id) AS r FROM rest WHERE shape < 2 AND (CASE WHEN doc_id % 3 = 0 THEN NOT EXISTS (SELECT 1 FROM covered c WHERE c.query_id = rest.query_id AND c.source = rest.source)
  ELSE doc_id % 6 IN (1, 3) AND (shape = 0 OR doc_id % 6 = 3) END)),
p AS (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY size DESC, file_name, doc_id) AS place FROM r WHERE r = 1)
SELECT query_id, doc_id, source, place FROM p WHERE place <= 6"""
)
def entity_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest file of each entity that a question's pool lacks; two files of three are an entity by their name only."""
    pool, f, q = _pool(spark, sf_dir)
    found = I.by_entity(pool, f.withColumn("entity", F.when(F.col("doc_id") % 3 == 0, F.col("entity"))), q, "doc_id")
    return found.join(f.select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "source", "place")


@query(
    f"""WITH {POOL}, c AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY size DESC, 'dues-' || file_name, doc_id) AS nth FROM (SELECT query_id, shape, files.* FROM asked, files) f WHERE lang = 'fr' AND shape <> 1 AND NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = f.query_id AND vec_id = doc_id)),
p AS (SELECT c.query_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM files JOIN c USING (doc_id) WHERE nth <= 3)
SELECT query_id, doc_id, place, sha256(line) AS hash FROM p WHERE place <= 2"""
)
def ledger_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading paragraphs of ledgers for questions about payments."""
    pool, f, q = _pool(spark, sf_dir)
    named = f.withColumn("file_name", F.concat(F.when(F.col("lang") == "fr", "dues-").otherwise("notes-"), "file_name"))
    chosen = I.ledgers(pool, named, q, "doc_id")
    lines = f.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return I.lead_chunks(chosen, lines, "doc_id", "i").select("query_id", "doc_id", "place", F.sha2("line", 256).alias("hash"))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(file_name, '^(.+)\\.[^.]*$', '\\1')), '[a-z]{3,}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in R.NOISE) + ")))"
EXT = "lower(regexp_extract(file_name, '\\.([^.]+)$', 1))"
GROUPS = f"""{FILES}, m AS (SELECT label || '/' || doc_id % 8 || '|' || CASE WHEN {EXT} IN ('pdf', 'txt', 'md', 'docx') THEN 'document' WHEN {EXT} = 'jpg' THEN 'image' ELSE 'other:' || {EXT} END AS grp,
  doc_id AS id, {TOKENS} AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN files ON doc_id = vec_id),
n AS (SELECT grp, count(*) AS members FROM m GROUP BY grp),
p AS (SELECT a.grp, min(list_cosine_similarity(a.v, b.v)) AS least, bool_and(list_has_any(a.t, b.t)) AS share FROM m a JOIN m b ON a.grp = b.grp AND a.id < b.id GROUP BY a.grp),
k AS (SELECT grp, members, round(coalesce(least, 1.0), 6) AS least, coalesce(share, true) AS share FROM n LEFT JOIN p USING (grp))"""


@query(
    f"""WITH {GROUPS}, e AS (SELECT *, CASE WHEN members % 2 = 0 THEN 0.9 ELSE 0.7 END AS c FROM k)
SELECT grp AS "group", members, least, share, round(greatest(0.0, least(1.0, 0.5 * c + 0.5 * e.least)), 7) AS effective,
  CASE WHEN members < 2 THEN 'loner' WHEN e.least < -0.2 THEN 'loose' WHEN greatest(0.0, least(1.0, 0.5 * c + 0.5 * e.least)) < 0.35 THEN 'below_cutoff' WHEN c < 0.8 AND NOT share THEN 'no_common_token' ELSE 'accepted' END AS verdict FROM e"""
)
def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups cut by file family, their checks over all pairs, and a verdict; limits fit vectors without structure."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", V.normalise(F.col("embedding")).alias("vec"))
    m = e.join(files_of(spark, sf_dir).select("doc_id", "file_name"), "doc_id")
    m = m.select(F.concat_ws("/", F.col("label").cast("string"), (F.col("doc_id") % 8).cast("string")).alias("group"), F.col("doc_id").alias("id"), "file_name", "vec")
    sure = F.when(F.col("members") % 2 == 0, 0.9).otherwise(0.7)
    return R.judge_groups(R.pair_checks(R.split_by_family(m)), sure, cutoff=0.35, pairs=-0.2)


@query(
    """WITH d AS (SELECT p_brand AS folder, count(*) AS decisions FROM part GROUP BY p_brand), s AS (SELECT p_brand AS folder, p_type AS sub, count(*) AS files FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY files DESC, sub) AS r FROM s),
h AS (SELECT folder, string_agg(sub || ' (' || files || ')', '; ' ORDER BY r) AS hints FROM r WHERE r <= 2 GROUP BY folder)
SELECT folder, decisions, decisions <= 50 AS allowed, CASE WHEN decisions > 50 THEN hints END AS hints FROM d JOIN h USING (folder)"""
)
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as folders, types as subfolders, parts as decisions."""
    p = table(spark, sf_dir, "part")
    subs = p.groupBy(F.col("p_brand").alias("folder"), F.col("p_type").alias("sub")).agg(F.count("*").alias("files"))
    s = R.scope(p.groupBy(F.col("p_brand").alias("folder")).agg(F.count("*").alias("decisions")), subs)
    return s.select("folder", "decisions", "allowed", F.array_join("hints", "; ").alias("hints"))


@query(
    """WITH p AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS name FROM part), e AS (SELECT DISTINCT p_type AS folder FROM part WHERE p_partkey % 5 = 0 AND p_partkey < 20),
f AS (SELECT lower(name) AS key, arg_min(name, ord) AS fresh FROM p GROUP BY ALL), h AS (SELECT lower(folder) AS key, min(folder) AS folder FROM e GROUP BY ALL)
SELECT ord, coalesce(folder, fresh) AS destination, folder IS NULL AS is_new FROM p JOIN f ON f.key = lower(name) LEFT JOIN h ON h.key = lower(name)"""
)
def move_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as proposed folder names in two spellings; some exist already."""
    p = table(spark, sf_dir, "part")
    proposals = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("name"))
    return R.destinations(proposals, p.filter("p_partkey % 5 = 0 and p_partkey < 20").select(F.col("p_type").alias("folder")).distinct())


@query(
    """WITH p AS (SELECT p_type AS folder, p_size / 50.0 AS c, p_partkey % 3 = 0 AS preview FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM p)
SELECT folder, count(*) AS files, bool_and(c >= 0.85) AND bool_or(preview) AS overrides FROM n WHERE c >= CASE WHEN n = 1 THEN 0.8 ELSE 0.6 END GROUP BY folder"""
)
def loner_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types as proposed folders, sizes as confidences."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("folder"), F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("confidence"), (F.col("p_partkey") % 3 == 0).alias("has_preview"))
    return R.judge_loners(p)
