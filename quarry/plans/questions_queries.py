"""Queries on questions: their shape, the files they name, and the filters that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import questions as Q
from quarry.operators import retrieval as R
from quarry.plans.library_queries import FILES, files_of
from quarry.plans.registry import query, table
from quarry.plans.retrieval_queries import NEAR, _read, stems_sql, tokens_sql

#: Questions of eleven shapes, by the order's number.
SHAPES = [
    "What about April", "And his PAN", "In  general, is there an engagement letter", "Don't answer about them, which one is next", "What is Acme's son's school fee", "When is the licence due by", "Give me an overview of my files",
    "What's in my documents", "Good morning!", "Thanks a lot", "Please follow  up on the lease renewals for order",
]
_said = lambda s: s.replace("'", "''")
QUESTIONS = "questions AS (SELECT o_orderkey AS id, CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{_said(s)}'" for i, s in enumerate(SHAPES)) + " END || CASE WHEN o_orderkey % 11 IN (8, 9) THEN '' ELSE ' ' || o_custkey END AS q FROM orders)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 11
    shape = F.get(F.array(*map(F.lit, SHAPES)), k.cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(shape, F.when(k.isin(8, 9), "").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))).alias("q"))


def _any(words: list[str], c: str = "s") -> str:
    return "(" + " OR ".join(f"contains({c}, '{_said(w)}')" for w in words) + ")"


@query(
    rf"""WITH {QUESTIONS}, s AS (SELECT id, q, ' ' || trim(regexp_replace(lower(q), '\s+', ' ', 'g')) || ' ' AS s FROM questions)
SELECT id, regexp_matches(lower(q), '{_said(Q.PRONOUNS)}') OR {" OR ".join(f"starts_with(trim(s), '{_said(o)}')" for o in Q.OPENERS)} AS continues, {_any(Q.GENERAL)} AS general, {_any(Q.EXCLUDING)} AS excludes,
  regexp_matches(lower(q), '{Q.RELATIVES}') AS relative, regexp_matches(lower(q), '{Q.ACTION}') AS action, regexp_matches(lower(q), '{Q.PER_ITEM}') AS per_item, {_any(Q.COLLECTION)} AND {_any(Q.OVERVIEW)} AS overview,
  CASE regexp_replace(lower(q), '[!.?]+$', '') WHEN 'good morning' THEN 'greeting' WHEN 'thanks a lot' THEN 'thanks' END AS talk FROM s"""
)
def question_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _questions(spark, sf_dir).select(
        "id", Q.is_continuation(q).alias("continues"), Q.wants_general(q).alias("general"), Q.excludes_client(q).alias("excludes"), Q.mentions_relative(q).alias("relative"), Q.is_action(q).alias("action"), Q.asks_per_item(q).alias("per_item"),
        Q.is_overview(q).alias("overview"), Q.small_talk(q).alias("talk"),
    )


ASKED = """asked AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'What is in ' || path || '?' WHEN 1 THEN 'Summarize ' || file_name || ', please' WHEN 2 THEN 'Anything in ' || regexp_replace(file_name, '\\.[^.]*$', '') || ' today' ELSE 'Hello there' END AS q FROM files)"""


def _asked(files: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    q = F.when(k == 0, F.concat(F.lit("What is in "), "path", F.lit("?"))).when(k == 1, F.concat(F.lit("Summarize "), "file_name", F.lit(", please"))).when(k == 2, F.concat(F.lit("Anything in "), stem, F.lit(" today"))).otherwise("Hello there")
    return files.select(F.col("doc_id").alias("id"), q.alias("q"))


STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    rf"""WITH {FILES}, {ASKED}, said AS (
  SELECT id, 0 AS form, unnest(regexp_extract_all(q, '/[^\s\n]+\.[A-Za-z0-9]{{1,8}}')) AS key, generate_subscripts(regexp_extract_all(q, '/[^\s\n]+\.[A-Za-z0-9]{{1,8}}'), 1) AS pos FROM asked
  UNION ALL SELECT id, 1, unnest(regexp_extract_all(q, '\w[\w()\-]*\.[A-Za-z0-9]{{1,8}}')), generate_subscripts(regexp_extract_all(q, '\w[\w()\-]*\.[A-Za-z0-9]{{1,8}}'), 1) FROM asked
  UNION ALL SELECT id, 2, unnest(w), generate_subscripts(w, 1) FROM (SELECT id, list_filter(string_split_regex(lower(q), '[^a-z0-9]+'), lambda t: length(t) >= 4 AND t NOT IN ({STOPS})) AS w FROM asked)),
names AS (SELECT 0 AS form, path AS key, path FROM files UNION ALL SELECT 1, file_name, path FROM files UNION ALL SELECT 2, trim(lower(CASE WHEN instr(file_name, '.') > 1 THEN regexp_extract(file_name, '^(.*)\.[^.]*$', 1) ELSE file_name END)), path FROM files),
one AS (SELECT id, said.form, pos, min(path) AS path FROM said JOIN names ON said.form = names.form AND said.key = names.key GROUP BY id, said.form, pos, said.key HAVING count(DISTINCT path) = 1)
SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY form, pos) AS r FROM one) WHERE r = 1"""
)
def file_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each question names by path, name or stem."""
    f = files_of(spark, sf_dir)
    return Q.file_scope(_asked(f), f.select("path", "file_name"), "id", "q")


FILLER = ", ".join(f"'{w}'" for w in [*Q.SUBJECT_FILLER, *Q.KIND_WORDS])


@query(
    rf"""WITH {FILES}, m AS (SELECT doc_id, file_name, CASE WHEN doc_id % 3 = 0 THEN 'Zenlite Traders' END AS entity, strftime(DATE '2004-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS day,
  CASE doc_id % 5 WHEN 0 THEN 'Zenlite GST returns' WHEN 1 THEN 'monthly bank statements' WHEN 2 THEN 'invoices' ELSE 'lease agreements' END AS subject,
  CASE WHEN doc_id % 2 = 0 THEN 'those of March 2004' ELSE 'all of them' END AS question FROM files),
t AS (SELECT *, list_filter({stems_sql(tokens_sql('subject'))}, lambda t: t NOT IN ({FILLER})) AS quals,
  list_concat({stems_sql(tokens_sql(r"regexp_replace(regexp_replace(regexp_replace(file_name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"))}, {stems_sql(tokens_sql("coalesce(entity, '')"))}) AS own FROM m)
SELECT doc_id FROM t WHERE (len(quals) = 0 OR list_has_any(quals, own)) AND (doc_id % 2 = 1 OR day LIKE '2004-03-%')"""
)
def inventory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched files of the owner that a subject names and the period that its question names."""
    d = F.col("doc_id")
    k = d % 5
    m = files_of(spark, sf_dir).select(
        "doc_id", "file_name", F.when(d % 3 == 0, "Zenlite Traders").alias("entity"), F.date_format(F.date_add(F.lit("2004-01-01").cast("date"), (d % 400).cast("int")), "yyyy-MM-dd").alias("day"),
        F.when(k == 0, "Zenlite GST returns").when(k == 1, "monthly bank statements").when(k == 2, "invoices").otherwise("lease agreements").alias("subject"), F.when(d % 2 == 0, "those of March 2004").otherwise("all of them").alias("question"),
    )
    return Q.inventory_filter(m, "subject", "question", "file_name", "entity", "day").select("doc_id")


CAMEL = r"regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"


@query(
    rf"""WITH {FILES}, f AS (SELECT doc_id AS file, {stems_sql(tokens_sql(CAMEL.format("file_name")))} AS s, list_concat({stems_sql(tokens_sql(CAMEL.format("file_name")))}, CASE WHEN doc_id % 3 = 0 THEN ['zenlite', 'trader'] ELSE [] END) AS own,
  CASE WHEN lang = 'de' THEN 'Notice' END AS doc_type, CASE WHEN doc_id % 11 > 0 THEN DATE '2004-01-01' + CAST(doc_id % 400 AS INTEGER) END AS day, doc_id % 6 AS shape FROM files),
q AS (SELECT doc_id AS query_id, doc_id // 100 % 5 AS kind, doc_id // 100 % 35 AS c FROM documents WHERE doc_id % 100 = 0),
p AS (SELECT DISTINCT query_id, kind, f.* FROM q JOIN f ON shape = CASE kind WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 0 END AND file % 35 = c WHERE kind <> 1 OR list_has_any(own, ['zenlite', 'trader'])),
h AS (SELECT query_id, kind, list(s) AS all_s, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT query_id, kind, n, list_filter(all_s[1], lambda t: len(list_filter(all_s, lambda x: list_contains(x, t))) = n) AS shared FROM h),
u AS (SELECT query_id, file, false AS added FROM p WHERE kind IN (1, 2, 4) OR (kind = 0 AND strftime(day, '%Y-%m') = '2004-03') OR (kind = 3 AND year(day) = 2005)
  UNION ALL SELECT query_id, file, true FROM g JOIN f ON kind IN (1, 2, 4) AND n >= 2 AND len(shared) > 0 AND list_has_all(s, shared) AND shape NOT IN (2, 3) AND (kind <> 1 OR list_has_any(own, ['zenlite', 'trader']))
  UNION ALL SELECT query_id, file, true FROM g JOIN f ON kind = 0 AND strftime(day, '%Y-%m') = '2004-03' AND shape <> 2
  UNION ALL SELECT query_id, file, true FROM g JOIN f ON kind = 3 AND year(day) = 2005 AND shape <> 2 AND doc_type = 'Notice')
SELECT query_id, file, bool_and(added) AS added FROM u GROUP BY ALL"""
)
def inventory_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's picks for questions (every hundredth document) lack: files of the period, and siblings by shared name stems."""
    d = F.col("doc_id")
    f = files_of(spark, sf_dir).select(
        d.alias("file"), "file_name", F.when(d % 3 == 0, "Zenlite Traders").alias("entity"), F.when(F.col("lang") == "de", "Notice").alias("doc_type"), (d % 6).alias("shape"),
        F.when(d % 11 > 0, F.date_format(F.date_add(F.lit("2004-01-01").cast("date"), (d % 400).cast("int")), "yyyy-MM-dd")).alias("date"),
    )
    said = ["What came in during March 2004?", "List the statements of Zenlite Traders", "List my photos", "How many notices did I get in 2005?", "List the letters"]
    about = ["papers", "Zenlite Traders statements", "", "notices", "letters"]
    shape = [4, 1, 4, 5, 0]
    each = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("kind") + 1)
    q = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(d.alias("query_id"), F.floor(d / 100).alias("h")).withColumn("kind", (F.col("h") % 5).cast("int"))
    q = q.select("query_id", each(said).alias("question"), each(about).alias("subject"), each(shape).alias("shape"), (F.col("h") % 35).alias("c"))
    matched = f.withColumn("c", F.col("file") % 35).join(q.select("query_id", "shape", "c"), ["shape", "c"]).select("query_id", "file")
    return Q.complete_inventory(q, matched, f)


@query(
    rf"""WITH {FILES}, {QUESTIONS}, v AS (SELECT DISTINCT unnest({tokens_sql("file_name")}) AS t FROM files), q AS (SELECT id, unnest({tokens_sql("q")}) AS t FROM questions)
SELECT DISTINCT id FROM q SEMI JOIN v ON q.t = v.t"""
)
def mentions_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that share a token with a file's name."""
    return Q.mentions_files(_questions(spark, sf_dir), files_of(spark, sf_dir), "id", "q")


@query(
    f"""WITH {FILES}, n AS (SELECT DISTINCT file_name FROM files WHERE status = 'FAILED') SELECT DISTINCT file_name, path FROM files WHERE file_name IN (SELECT file_name FROM n)"""
)
def paths_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir)
    return Q.paths_by_name(f, f.filter("status = 'FAILED'"))


@query(f"""WITH {FILES} SELECT doc_id FROM files WHERE NOT regexp_matches(file_name, '(^|[^a-z0-9])template([^a-z0-9]|$)', 'i')""")
def without_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates go unless the question asks for them."""
    return R.drop_templates(files_of(spark, sf_dir), "file_name", "Which lease is the longest?").select("doc_id")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'due ' || o_orderpriority || chr(10) || 'paid ' || o_custkey WHEN o_orderkey % 2 = 0 THEN 'due ' || o_orderpriority WHEN o_orderstatus = 'F' THEN 'paid ' || o_custkey END AS block FROM orders"""
)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("due "), "o_orderpriority"))
    paid: Column = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("paid "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), Q.merge_context(due, paid).alias("block"))


@query(
    f"""WITH {NEAR.format(scope='')}, c AS (SELECT query_id, doc_id, source AS file, doc_id % 7 AS page_start, doc_id % 7 + doc_id % 3 AS page_end FROM top JOIN documents ON doc_id = vec_id),
s AS (SELECT query_id, file, list(DISTINCT page ORDER BY page) AS pages FROM (SELECT query_id, file, unnest(range(page_start, greatest(page_end, page_start) + 1)) AS page FROM c WHERE page_start > 0) GROUP BY ALL)
SELECT c.query_id, c.file, count(*) AS snippets, coalesce(array_to_string(any_value(pages), ','), '') AS pages FROM c LEFT JOIN s ON s.query_id = c.query_id AND s.file IS NOT DISTINCT FROM c.file GROUP BY ALL"""
)
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the files of its matches, with their snippets and the pages of all their chunks."""
    k = F.col("doc_id")
    top = _read(spark, sf_dir).select("query_id", F.col("source").alias("file"), (k % 7).cast("int").alias("page_start"), (k % 7 + k % 3).cast("int").alias("page_end"), F.coalesce("text", F.lit("")).alias("text"), "pos")
    return R.group_sources(top, "file").select("query_id", "file", F.size("snippets").cast("long").alias("snippets"), F.array_join("pages", ",").alias("pages"))


NATIONS = "strftime(DATE '2001-01-01' + CAST(n_nationkey AS INTEGER) * 31, '%B')"


@query(
    f"""WITH n AS (SELECT n_nationkey, 'contract-' || n_nationkey || '-' || {NATIONS} || '.pdf' AS file_name FROM nation), h AS (SELECT n_nationkey FROM n WHERE contains(lower(file_name), 'august') OR contains(lower(file_name), 'october'))
SELECT n_nationkey FROM h WHERE (SELECT count(*) FROM h) <= 5"""
)
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a question names by a distinctive token (nations, each with a month); a kind of document is none."""
    month = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("n_nationkey") * 31).cast("int")), "MMMM")
    f = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("contract-"), F.col("n_nationkey").cast("string"), F.lit("-"), month, F.lit(".pdf")).alias("file_name"))
    return R.named_files(f, "Is the contract of August or that of October longer?").select("n_nationkey")


@query(
    """WITH pool AS (SELECT doc_id, source FROM documents WHERE doc_id % 9 = 0 AND source <> (SELECT max(source) FROM documents)), extra AS (SELECT doc_id, source FROM documents WHERE doc_id % 4 = 0)
SELECT * FROM pool UNION ALL SELECT * FROM extra WHERE source NOT IN (SELECT source FROM pool WHERE source IS NOT NULL)"""
)
def injected_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files that a pool lacks are appended to it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    last = d.agg(F.max("source").alias("last"))
    return R.inject(d.filter("doc_id % 9 = 0").join(F.broadcast(last), F.col("source") != F.col("last"), "left_semi"), d.filter("doc_id % 4 = 0 and source is not null"), "source")
