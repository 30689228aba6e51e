"""Queries over the library: documents stand in for files, labels for assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import library as L
from quarry.plans.registry import query, table

#: File names in six shapes, by id; status and times derive from the id as well.
FILES = """
files AS (SELECT doc_id, '/lib/' || source || '/' || CASE doc_id % 6
    WHEN 0 THEN 'Invoice' || lang || doc_id || '.pdf' WHEN 1 THEN 'bankStatement-' || doc_id || '.TXT'
    WHEN 2 THEN 'template_' || doc_id || '.docx' WHEN 3 THEN 'Lease Agreement v2 ' || doc_id || '.md'
    WHEN 4 THEN 'photo' || doc_id || '.jpg' ELSE 'notes' || doc_id END AS path,
  CASE doc_id % 6 WHEN 0 THEN 'Invoice' || lang || doc_id || '.pdf' WHEN 1 THEN 'bankStatement-' || doc_id || '.TXT'
    WHEN 2 THEN 'template_' || doc_id || '.docx' WHEN 3 THEN 'Lease Agreement v2 ' || doc_id || '.md'
    WHEN 4 THEN 'photo' || doc_id || '.jpg' ELSE 'notes' || doc_id END AS file_name,
  n_chars AS size, doc_id * 1000 AS mtime, sha256(text) AS hash, CASE WHEN doc_id % 7 = 0 THEN 'FAILED' ELSE 'INDEXED' END AS status,
  lang, source, text FROM documents)
"""


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("Invoice"), "lang", i, F.lit(".pdf")))
        .when(k == 1, F.concat(F.lit("bankStatement-"), i, F.lit(".TXT")))
        .when(k == 2, F.concat(F.lit("template_"), i, F.lit(".docx")))
        .when(k == 3, F.concat(F.lit("Lease Agreement v2 "), i, F.lit(".md")))
        .when(k == 4, F.concat(F.lit("photo"), i, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("notes"), i))
    )
    return d.select(
        "doc_id", F.concat(F.lit("/lib/"), "source", F.lit("/"), name).alias("path"), name.alias("file_name"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime"),
        F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 7 == 0, "FAILED").otherwise("INDEXED").alias("status"), "lang", "source", "text",
    )


SUPPORTED = ", ".join(f"'{x}'" for x in L.SUPPORTED)
EXT = "lower(regexp_extract(file_name, '\\.([^.]+)$', 1))"


@query(
    f"""WITH {FILES}, known AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN mtime ELSE mtime - 1 END AS mtime,
  CASE WHEN doc_id % 3 = 0 THEN hash ELSE 'x' || hash END AS hash, status FROM files WHERE doc_id % 2 = 0)
SELECT f.doc_id, CASE WHEN {EXT} NOT IN ({SUPPORTED}) THEN 'unsupported' WHEN f.size > 10000 THEN 'too_large' WHEN f.size = 0 THEN NULL
  WHEN k.status = 'INDEXED' AND f.mtime = k.mtime THEN 'unchanged' WHEN k.status = 'INDEXED' AND f.hash = k.hash THEN 'touched' ELSE 'process' END AS state
FROM files f LEFT JOIN known k ON k.path = f.path"""
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change detection by time and hash against an earlier state of half the library."""
    f = files_of(spark, sf_dir)
    known = f.filter("doc_id % 2 = 0").select(
        "path", F.when(F.col("doc_id") % 5 == 0, F.col("mtime")).otherwise(F.col("mtime") - 1).alias("mtime"), F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise(F.concat(F.lit("x"), "hash")).alias("hash"), "status"
    )
    return L.admit(f, known, max_bytes=10_000).select("doc_id", "state")


@query(
    f"""WITH {FILES}, known AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN mtime ELSE mtime - 1 END AS mtime,
  CASE WHEN doc_id % 3 = 0 THEN hash ELSE 'x' || hash END AS hash, status FROM files WHERE doc_id % 2 = 0),
s AS (SELECT CASE WHEN {EXT} NOT IN ({SUPPORTED}) THEN 'unsupported' WHEN f.size > 10000 THEN 'too_large' WHEN f.size = 0 THEN NULL
  WHEN k.status = 'INDEXED' AND f.mtime = k.mtime THEN 'unchanged' WHEN k.status = 'INDEXED' AND f.hash = k.hash THEN 'touched' ELSE 'process' END AS state
FROM files f LEFT JOIN known k ON k.path = f.path)
SELECT state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY state"""
)
def index_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission(spark, sf_dir).filter("state is not null").groupBy("state").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FILES} SELECT doc_id, {EXT} AS extension, CASE WHEN {EXT} IN ('pdf', 'txt', 'md', 'docx') THEN 'document' WHEN {EXT} = 'jpg' THEN 'image' ELSE 'other' END AS family,
  regexp_matches(file_name, '(^|[^a-zA-Z0-9])(template|sample|example|boilerplate|placeholder|lorem|starter|demo|blank|_default)([^a-zA-Z0-9]|$)', 'i') AS is_template,
  regexp_matches(file_name, '(^|[^a-zA-Z0-9])(draft|old|copy|superseded|backup|v[0-9]+)([^a-zA-Z0-9]|$)', 'i') AS is_superseded,
  'lib/' || source AS folder_hint FROM files"""
)
def file_name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("file_name")
    return files_of(spark, sf_dir).select(
        "doc_id", T.extension(n).alias("extension"), T.extension_family(n).alias("family"), n.rlike(T.TEMPLATE_NAME).alias("is_template"), n.rlike(T.SUPERSEDED_NAME).alias("is_superseded"), T.folder_hint(F.col("path")).alias("folder_hint")
    )


@query(
    f"""WITH {FILES}, t AS (SELECT doc_id, greatest(1, size // 4) AS tokens FROM files),
r AS (SELECT *, sum(CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END) OVER (ORDER BY doc_id) AS running FROM t)
SELECT doc_id, tokens, CAST(running AS BIGINT) AS running, tokens <= 2000 AND running <= 300000 AS in_budget FROM r"""
)
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir).select("doc_id", L.token_estimate(F.col("size")).alias("tokens"))
    return L.budget(f, ["doc_id"], per_file=2000, total=300_000)


@query(
    f"""WITH {FILES} SELECT coalesce(lang, 'Other') AS doc_type, count(*) AS n FROM files GROUP BY ALL UNION ALL SELECT 'All', count(*) FROM files"""
)
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir)
    n = F.count("*").alias("n")
    return f.groupBy(F.coalesce("lang", F.lit("Other")).alias("doc_type")).agg(n).union(f.agg(F.lit("All").alias("doc_type"), n))


@query(
    f"""WITH {FILES} SELECT count(*) FILTER (WHERE status = 'INDEXED') AS indexed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  CAST(coalesce(sum(greatest(1, size // 4)) FILTER (WHERE status = 'INDEXED'), 0) AS BIGINT) AS tokens, max(mtime) AS last_indexed FROM files"""
)
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters in one pass."""
    ok = F.col("status") == "INDEXED"
    return files_of(spark, sf_dir).agg(
        F.count_if(ok).alias("indexed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum(F.when(ok, L.token_estimate(F.col("size")))), F.lit(0)).alias("tokens"), F.max("mtime").alias("last_indexed")
    )


@query("SELECT quality, count(*) AS files FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def assigned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files per client: labels stand in for assignments, quality for the client."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("quality").agg(F.count("*").alias("files"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(f"""WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '/moved' || path ELSE path END AS path, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE status END AS status FROM files""")
def rename_and_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path map and a list of failures applied to the file table."""
    f = files_of(spark, sf_dir)
    marked = L.mark_failed(f, f.filter("doc_id % 9 = 0").select("path", F.lit("parse error").alias("reason"))).drop("failed_reason")
    moves = f.filter("doc_id % 4 = 0").select(F.col("path").alias("old"), F.concat(F.lit("/moved"), "path").alias("new"))
    return L.rename_paths(marked, moves).select("doc_id", "path", "status")


@query(
    """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_type, value FROM e WHERE r = 1"""
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert semantics: the last event of each user."""
    return L.latest(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "value")


@query(
    f"""WITH {FILES}, new AS (SELECT doc_id, 'v2' AS version FROM files WHERE doc_id % 3 = 0)
SELECT doc_id, 'v1' AS version FROM files WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, version FROM new"""
)
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir).select("doc_id")
    return L.upsert(f.filter("doc_id % 2 = 0").withColumn("version", F.lit("v1")), f.filter("doc_id % 3 = 0").withColumn("version", F.lit("v2")), ["doc_id"])


@query(
    f"""WITH {FILES}, c AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN hash ELSE 'old' END AS hash FROM files WHERE doc_id % 2 = 0)
SELECT doc_id, EXISTS (SELECT 1 FROM c WHERE c.path = files.path AND c.hash = files.hash) AS hit FROM files"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_of(spark, sf_dir).select("doc_id", "path", "hash")
    cache = f.filter("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise(F.lit("old")).alias("hash"))
    hits, misses = L.cache_hits(cache, f, ["path", "hash"])
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False).alias("hit")))


@query(
    f"""WITH {FILES}, c AS (SELECT *, lower(path) AS canonical FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (path = canonical) DESC, size DESC, path DESC) AS r FROM c)
SELECT source, doc_id, size FROM r WHERE r = 1"""
)
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's files as spellings of one path, of which the lower-cased one is exact."""
    f = files_of(spark, sf_dir)
    # The operator compares a path with its canonical form; here that is one text for a whole source.
    one = f.select("doc_id", "size", F.col("source").alias("canonical"), F.when(F.col("path") == F.lower("path"), F.col("source")).otherwise(F.concat(F.col("source"), F.lit(" "), "path")).alias("path"))
    return L.canonical_dedupe(one).select(F.col("canonical").alias("source"), "doc_id", "size")


@query(
    """WITH b AS (SELECT user_id AS batch_id, count(*) AS moves, max(ts) AS last_at FROM events GROUP BY user_id) SELECT batch_id, moves, last_at FROM b ORDER BY last_at DESC, batch_id LIMIT 20"""
)
def undo_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("ts").alias("moved_at"))
    return L.undo_batches(log, 20)


@query(f"""WITH {FILES} SELECT doc_id, row_number() OVER (ORDER BY size DESC, file_name, doc_id) AS place FROM files WHERE status = 'INDEXED' ORDER BY place LIMIT 300""")
def inventory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 largest files by size, then name: a top-k, so each partition sends 300 rows."""
    f = files_of(spark, sf_dir).filter("status = 'INDEXED'").select("doc_id", "size", "file_name").orderBy(F.desc("size"), "file_name", "doc_id").limit(300)
    return f.select("doc_id", F.row_number().over(W.orderBy(F.desc("size"), "file_name", "doc_id")).cast("long").alias("place"))


@query(f"""WITH {FILES} SELECT doc_id FROM files WHERE path LIKE '/lib/src3/%'""")
def folder_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.target_selection(files_of(spark, sf_dir), folder="/lib/src3").select("doc_id")


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@]') AND NOT regexp_matches(t, '^[+-]?[0-9][0-9,]*(\.[0-9]+)?%?$') THEN '''' || t ELSE t END AS cell
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' || lang WHEN 1 THEN '-' || n_chars WHEN 2 THEN '@' || source ELSE lang END AS t FROM documents)"""
)
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat(F.lit("="), "lang")).when(k == 1, F.concat(F.lit("-"), F.col("n_chars").cast("string"))).when(k == 2, F.concat(F.lit("@"), "source")).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.guard_formula(t).alias("cell"))


@query(
    """SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS n_escaped, sha256(html) AS hash FROM pages"""
)
def html_escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as text, escaped for a report, with their content hash."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.html_escape(F.col("html"))).cast("long").alias("n_escaped"), F.sha2("html", 256).alias("hash"))
