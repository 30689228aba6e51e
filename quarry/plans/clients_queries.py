"""Queries over clients: benchmark items and opening messages lend the names, documents and messages the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import clients as C
from quarry.plans.registry import query, table

W, G = r"[\p{L}\p{Nd}]", r"[^\p{L}\p{Nd}]"
NORM = "lower(trim(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g')))"
WORDS = r"list_filter(regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' '), lambda w: w <> '')"


def marked(c: str) -> str:
    """Every word between marks; a marked identifier is found only where it stands as whole words."""
    return f"regexp_replace({c}, '({W}+)', chr(1) || '\\1' || chr(2), 'g')"


def core_sql(c: str) -> str:
    """Without outer characters that are no letters or digits."""
    return f"regexp_replace({c}, '^{G}+|{G}+$', '', 'g')"


GENERIC = ", ".join(f"'{w}'" for w in C.GENERIC)
FORMS = ", ".join(f"'{w}'" for w in C.LEGAL_FORMS)

#: An item's first three words are a client's name, the next two an alias.
ITEMS = f"""w AS (SELECT item_id AS client_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
clients AS (SELECT client_id, array_to_string(w[1:3], ' ') AS name FROM w),
idents AS (SELECT DISTINCT client_id, norm FROM (SELECT client_id, {core_sql(NORM.format('unnest([array_to_string(w[1:3], chr(32)), array_to_string(w[4:5], chr(32))])'))} AS norm FROM w) WHERE length(norm) >= 3),
hay AS (SELECT doc_id, {marked(NORM.format("coalesce(text, '')"))} AS t FROM documents),
hits AS (SELECT DISTINCT doc_id, client_id FROM hay, idents WHERE contains(t, {marked('norm')}))"""


def _words(c: str, first: int, n: int) -> F.Column:
    w = F.filter(F.split(F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")), " "), lambda x: x != "")
    return F.array_join(F.slice(w, first, n), " ")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    return b.select(F.col("item_id").alias("client_id"), _words("text", 1, 3).alias("name"), F.array(_words("text", 4, 2)).alias("aliases"))


@query(
    f"""WITH {ITEMS}, n AS (SELECT doc_id, count(*) AS n, min(client_id) AS hit FROM hits GROUP BY doc_id), p AS (SELECT doc_id, quality AS pin FROM labels WHERE toxic = 1)
SELECT doc_id, coalesce(pin, CASE WHEN n = 1 THEN hit END) AS client_id,
  CASE WHEN pin IS NOT NULL THEN 'pinned' WHEN n = 1 THEN 'assigned' WHEN n > 1 THEN 'conflicted' ELSE 'unmatched' END AS state
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)"""
)
def client_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's client; toxic labels stand in for pinned assignments."""
    pins = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.col("quality").cast("long").alias("client_id"))
    return C.membership(table(spark, sf_dir, "documents"), C.identifiers(_items(spark, sf_dir)), pins, "doc_id", "text")


@query(
    f"""WITH {ITEMS}, i AS (SELECT client_id, array_to_string(list(norm ORDER BY norm), '|') AS identifiers FROM idents GROUP BY client_id),
n AS (SELECT client_id, count(*) AS files, count(l.doc_id) AS live_files FROM hits LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY client_id)
SELECT client_id, name, coalesce(identifiers, '') AS identifiers, coalesce(files, 0) AS files, coalesce(live_files, 0) AS live_files, coalesce(live_files, 0) > 0 AS active
FROM clients LEFT JOIN i USING (client_id) LEFT JOIN n USING (client_id)"""
)
def client_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with identifiers and file counts; labelled documents are the live ones."""
    c = _items(spark, sf_dir)
    i = C.identifiers(c)
    r = C.roster(c, i, C.matches(table(spark, sf_dir, "documents"), i, "doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id")
    return r.withColumn("identifiers", F.array_join("identifiers", "|"))


#: The first three words of each conversation's first message are a client's name; all user messages are questions.
OPENINGS = f"""w AS (SELECT conv_id AS client_id, {WORDS} AS w FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)),
clients AS (SELECT client_id, array_to_string(w[1:3], ' ') AS name FROM w),
idents AS (SELECT DISTINCT client_id, norm FROM (SELECT client_id, {core_sql(NORM.format('name'))} AS norm FROM clients) WHERE length(norm) >= 3),
q AS (SELECT conv_id * 1000 + turn AS q_id, {marked(NORM.format("coalesce(text, '')"))} AS t FROM conversations WHERE role = 'user'),
tok AS (SELECT DISTINCT client_id, token FROM (SELECT client_id, {core_sql("unnest(string_split(norm, ' '))")} AS token FROM idents) WHERE length(token) >= 4 AND token NOT IN ({GENERIC})),
own AS (SELECT *, count(*) OVER (PARTITION BY token) > 1 AS shared FROM tok),
h AS (SELECT q_id, client_id, false AS shared FROM q, idents WHERE contains(t, {marked('norm')})
  UNION ALL SELECT q_id, client_id, shared FROM q, own WHERE contains(t, {marked('token')})),
b AS (SELECT q_id, client_id, bool_and(shared) AS shared FROM h GROUP BY ALL),
hits AS (SELECT q_id, client_id FROM (SELECT *, bool_and(shared) OVER (PARTITION BY q_id) AS only_shared FROM b) WHERE shared = only_shared)"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = table(spark, sf_dir, "conversations")
    first = m.filter("text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    named = first.select(F.col("conv_id").alias("client_id"), _words("text", 1, 3).alias("name"))
    # A client's short company name would be a second identifier; names of opening words have none.
    idents = C.identifiers(named)
    q = m.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), "text")
    return q, named, C.question_matches(q, idents, "q_id", "text")


@query(f"WITH {OPENINGS} SELECT q_id, client_id FROM hits")
def client_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clients that each user message names, by identifier, by a word of one client, or by shared words."""
    return _asked(spark, sf_dir)[2]


@query(
    rf"""WITH {OPENINGS}, k AS (SELECT client_id, nullif(array_to_string(list_filter(string_split(regexp_replace({NORM.format('name')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({FORMS})), ' '), '') AS key FROM clients),
n AS (SELECT q_id, count(*) AS n, min(client_id) AS first, count(*) = count(key) AND count(DISTINCT key) = 1 AS same FROM hits JOIN k USING (client_id) GROUP BY q_id)
SELECT q_id, CASE WHEN n = 1 OR same THEN 'SCOPED' WHEN n > 1 THEN 'CLARIFY' ELSE 'NONE' END AS scope, CASE WHEN n = 1 OR same THEN first END AS client_id, coalesce(n, 0) AS n_named FROM q LEFT JOIN n USING (q_id)"""
)
def client_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user message is about: nothing special, one client, or several to ask back about."""
    q, named, hits = _asked(spark, sf_dir)
    return C.resolve(q, hits, named, "q_id")
