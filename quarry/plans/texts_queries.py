"""Queries on texts: cleaning, chunks, labels and document types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking as C
from quarry.plans.registry import query, table


@query(
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'a     b' || chr(7), '\r\n?', chr(10), 'g'),
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {3,}', ' ', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) AS n, sha256(t) AS hash FROM c"""
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.clean_text(F.concat(F.coalesce("text", F.lit("")), F.lit("\r\n\n\n\na     b\x07")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("hash"))


@query(
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '[=`]{2,}', '=', 'g'), '[<>]', ' ', 'g')) AS l,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '[=`]{3,}', '=', 'g'), ' {2,}', ' ', 'g')) AS p, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS q, trim(text) AS t FROM documents)
SELECT doc_id, CASE WHEN l = '' THEN 'unknown' WHEN length(l) > 200 THEN left(l, 200) || '…' ELSE l END AS label, CASE WHEN length(p) > 100 THEN left(p, 100) || '…' ELSE p END AS preview,
  CASE WHEN length(q) > 60 THEN trim(left(q, 60)) || '…' ELSE q END AS title, CASE WHEN length(t) > 320 THEN left(t, 320) || '…' ELSE t END AS snippet FROM s"""
)
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as labels, previews, titles and snippets."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_label(t).alias("label"), T.safe_preview(t, 100).alias("preview"), T.title(t).alias("title"), T.snippet(t).alias("snippet"))


NAMES = """
n AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'AcmeInvoice-No-' || o_orderkey || '.pdf' WHEN 1 THEN 'scan' || o_orderkey || '.pdf' WHEN 2 THEN 'bank_statement_' || o_orderkey || '.pdf' WHEN 3 THEN 'Lease-Agreement.docx'
    WHEN 4 THEN 'misc.txt' WHEN 5 THEN 'GSTReturn2024.pdf' ELSE 'photo.jpg' END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'TAX INVOICE to client, bill to ' || o_custkey WHEN 1 THEN 'opening balance 5, closing balance 6, NEFT' WHEN 2 THEN 'Your electricity bill: units consumed ' || o_custkey WHEN 3 THEN 'nothing here' ELSE 'Passport and visa, departure at nine' END AS text FROM orders)
"""


def _phrases(category: str) -> str:
    terms, anchors = [], []
    for p, w in C.MARKERS[category].items():
        terms.append(f"CASE WHEN contains(content, '{p}') THEN {w} ELSE 0 END + CASE WHEN contains(spaced, '{p}') THEN {w + 3} ELSE 0 END")
        anchors.append(f"contains(spaced, '{p}')" + (f" OR contains(content, '{p}')" if w >= C.ANCHOR else ""))
    return f"SELECT id, '{category}' AS label, {list(C.MARKERS).index(category)} AS ord, {' + '.join(terms)} AS score, ({' OR '.join(anchors)}) AS anchor FROM s"


@query(
    f"""WITH {NAMES}, s AS (SELECT id, lower(text) AS content, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[-_./]+', ' ', 'g')) AS spaced FROM n),
c AS ({' UNION ALL '.join(_phrases(k) for k in C.MARKERS)}),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r FROM c WHERE anchor AND score >= 4)
SELECT n.id, coalesce(b.label, 'Other') AS doc_type FROM n LEFT JOIN b ON b.id = n.id AND b.r = 1"""
)
def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document types by weighted phrases in names and openings."""
    o = F.col("o_orderkey")
    k, j, s = o % 7, o % 5, F.col("o_custkey").cast("string")
    key = o.cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("AcmeInvoice-No-"), key, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("scan"), key, F.lit(".pdf"))).when(k == 2, F.concat(F.lit("bank_statement_"), key, F.lit(".pdf")))
        .when(k == 3, "Lease-Agreement.docx").when(k == 4, "misc.txt").when(k == 5, "GSTReturn2024.pdf").otherwise("photo.jpg")
    )
    text = (
        F.when(j == 0, F.concat(F.lit("TAX INVOICE to client, bill to "), s)).when(j == 1, "opening balance 5, closing balance 6, NEFT").when(j == 2, F.concat(F.lit("Your electricity bill: units consumed "), s))
        .when(j == 3, "nothing here").otherwise("Passport and visa, departure at nine")
    )
    d = table(spark, sf_dir, "orders").select(o.alias("id"), name.alias("name"), text.alias("text"))
    return C.with_doc_type(d, "name", "text").select("id", "doc_type")


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split_regex(coalesce(text, ''), '\n\n+'),
  lambda p: string_split(regexp_replace(regexp_replace(trim(p, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?])(\s+[A-Z"''(])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)))),
  lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
c AS (SELECT doc_id, i, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM u),
p AS (SELECT doc_id, list(CAST(total AS BIGINT) ORDER BY i) AS t, max(i) AS n FROM c GROUP BY doc_id),
r(doc_id, b, e) AS (SELECT doc_id, CAST(1 AS BIGINT), list_max(list_filter(range(1, n + 1), lambda j: j = 1 OR t[j] + j - 1 <= 1800)) FROM p
  UNION ALL SELECT doc_id, b, list_max(list_filter(range(b, n + 1), lambda j: j = b OR t[j] - t[b - 1] + j - b <= 1800)) FROM (
    SELECT doc_id, greatest(b + 1, 1 + list_max(list_filter(range(1, e + 1), lambda k: k = 1 OR t[e] - t[k] + e - k >= 200))) AS b, t, n FROM r JOIN p USING (doc_id) WHERE e < n)),
l AS (SELECT doc_id, t[e] - coalesce(t[b - 1], 0) + e - b AS size FROM r JOIN p USING (doc_id))
SELECT doc_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS chars, max(size) AS longest FROM l GROUP BY doc_id"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per document, their characters and the longest; the SQL packs by recursion over sums of lengths."""
    c = C.chunk(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))


@query(
    f"""WITH {LINES}, h AS (SELECT *, regexp_matches(text, 'license', 'i') AS hit FROM lines),
n AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h),
g AS (SELECT *, CASE WHEN chunk_index - lag(chunk_index) OVER (PARTITION BY doc_id ORDER BY chunk_index) > 1 OR lag(chunk_index) OVER (PARTITION BY doc_id ORDER BY chunk_index) IS NULL THEN 1 ELSE 0 END AS new FROM n WHERE near),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS run FROM g)
SELECT doc_id, CAST(run AS BIGINT) AS run, count(*) AS chunks, length(string_agg(text, chr(10) ORDER BY chunk_index)) AS n FROM r GROUP BY doc_id, run HAVING run <= 40"""
)
def neighbour_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines about licences with their neighbours, merged into runs."""
    r = C.neighbours(_lines(spark, sf_dir), "doc_id", F.col("text").rlike("(?i)license"))
    return r.select("doc_id", F.col("run").cast("long").alias("run"), "chunks", F.length("text").cast("long").alias("n"))


@query(
    f"""WITH {LINES}, b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines)
SELECT doc_id, count(*) AS chunks, CAST(sum(length(text) + 1) AS BIGINT) AS n FROM b WHERE before < 500 GROUP BY doc_id"""
)
def leading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leading(_lines(spark, sf_dir), "doc_id", 500).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text") + 1).alias("n"))


@query(
    """WITH RECURSIVE d AS (SELECT source, doc_id, doc_id // 10000 AS range, n_chars, row_number() OVER (PARTITION BY source, doc_id // 10000 ORDER BY doc_id) AS rn FROM documents),
r(source, range, doc_id, rn, batch, used, n) AS (SELECT source, range, doc_id, rn, 0, n_chars, 1 FROM d WHERE rn = 1 UNION ALL
  SELECT d.source, d.range, d.doc_id, d.rn, CASE WHEN used + d.n_chars > 20000 OR n >= 10 THEN batch + 1 ELSE batch END, CASE WHEN used + d.n_chars > 20000 OR n >= 10 THEN d.n_chars ELSE used + d.n_chars END, CASE WHEN used + d.n_chars > 20000 OR n >= 10 THEN 1 ELSE n + 1 END
  FROM r JOIN d ON d.source = r.source AND d.range = r.range AND d.rn = r.rn + 1)
SELECT source, doc_id, range, batch FROM r"""
)
def size_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of at most ten documents or 20,000 characters per source, anew in every range of 10,000 ids."""
    return C.batches(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 20_000, 10)


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id, chunk_index, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS flat FROM lines), p AS (SELECT doc_id, chunk_index AS page, flat AS page_text FROM f WHERE flat <> '')
SELECT doc_id, chunk_index, coalesce({', '.join(f"min(CASE WHEN contains(page_text, left(flat, {n})) THEN page END)" for n in (60, 44, 28, 12))}) AS page_start,
  coalesce({', '.join(f"max(CASE WHEN contains(page_text, right(flat, {n})) THEN page END)" for n in (60, 44, 28, 12))}) AS page_end FROM f JOIN p USING (doc_id) WHERE flat <> '' GROUP BY doc_id, chunk_index"""
)
def page_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paged files: their lines are pages, and chunks."""
    paged = _lines(spark, sf_dir)
    got = C.locate_pages(paged, paged.withColumnRenamed("chunk_index", "page"), "doc_id")
    return got.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "page_start", "page_end")))
