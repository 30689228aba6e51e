"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chats as C
from quarry.plans.registry import query, table

PAIRS = """
m AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, question, text AS answer FROM m WHERE role = 'assistant' AND before = 'user')
"""
TITLES = r"""
f AS (SELECT conv_id, trim(regexp_replace(coalesce(min_by(text, turn) FILTER (WHERE role = 'user'), 'New chat'), '[ \t\n\r]+', ' ', 'g')) AS t, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
titles AS (SELECT conv_id, CASE WHEN length(t) > 60 THEN trim(left(t, 60)) || '…' ELSE t END AS title, messages, last_turn FROM f)
"""


@query(f"WITH {PAIRS} SELECT conv_id, turn, question, answer FROM e")
def chat_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exchanges(table(spark, sf_dir, "conversations"))


@query(f"WITH {PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM e) SELECT conv_id, turn, question, answer FROM b WHERE back <= 2")
def chat_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exchanges(table(spark, sf_dir, "conversations"), last=2)


@query(f"WITH {TITLES} SELECT conv_id, title, messages, last_turn FROM titles")
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.titles(table(spark, sf_dir, "conversations"))


@query(f"WITH {TITLES} SELECT conv_id, title FROM titles WHERE title ILIKE '%ing th%' OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = titles.conv_id AND c.text ILIKE '%ing th%')")
def chat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations")
    return C.search(m, C.titles(m), "ing th").select("conv_id", "title")


@query(
    """WITH l AS (SELECT conv_id, coalesce(min_by(text, turn) FILTER (WHERE text ILIKE '%tion%'), min_by(text, turn)) AS line FROM conversations GROUP BY conv_id),
p AS (SELECT *, strpos(lower(line), 'tion') AS hit FROM l),
c AS (SELECT *, greatest(hit - 40, 1) AS a, least(hit + 3 + 70, length(line)) AS b FROM p)
SELECT conv_id, CASE WHEN hit > 0 THEN CASE WHEN a > 1 THEN '…' ELSE '' END || substr(line, a, b - a + 1) || CASE WHEN b < length(line) THEN '…' ELSE '' END
  WHEN length(line) > 120 THEN left(line, 120) || '…' ELSE line END AS snippet FROM c"""
)
def chat_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_match(table(spark, sf_dir, "conversations"), "tion")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def chat_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations")
    return C.delete(m, m.filter("role = 'system'")).select("conv_id", "turn", "role")


@query(
    r"""WITH """ + PAIRS + r""", b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
  trim(regexp_replace(question, '[ \t\n\r]+', ' ', 'g')) AS q, trim(regexp_replace(answer, '[ \t\n\r]+', ' ', 'g')) AS a FROM e)
SELECT conv_id, string_agg('Q: ' || CASE WHEN length(q) > 80 THEN left(q, 80) || '…' ELSE q END || chr(10) || 'A: ' || CASE WHEN length(a) > 80 THEN left(a, 80) || '…' ELSE a END, chr(10) ORDER BY turn) AS context
FROM b WHERE back <= 3 GROUP BY conv_id"""
)
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.context(table(spark, sf_dir, "conversations"), 3, 80)


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))
