"""Queries on amounts and extracted fields; raw answers derive from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import money as M
from quarry.functions import text as T
from quarry.operators import extraction as E
from quarry.plans.registry import query, table

RAW = """
raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN 'Rs. ' || CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR)
  WHEN 2 THEN CAST(o_custkey AS VARCHAR) || ' + ' || CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 'n/a' WHEN 4 THEN '(EUR 1,2' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '.50)' ELSE 'about twelve' END AS t FROM orders)
"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    s = lambda c: c.cast("string")
    t = (
        F.when(k == 0, F.concat(F.lit("$"), s(F.floor("o_totalprice"))))
        .when(k == 1, F.concat(F.lit("Rs. "), s(F.floor(F.col("o_totalprice") * 100))))
        .when(k == 2, F.concat(s(F.col("o_custkey")), F.lit(" + "), s(F.col("o_orderkey"))))
        .when(k == 3, "n/a")
        .when(k == 4, F.concat(F.lit("(EUR 1,2"), F.lpad(s(F.col("o_custkey") % 100), 2, "0"), F.lit(".50)")))
        .otherwise("about twelve")
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t"), "o_totalprice", "o_custkey")


@query(
    f"""WITH {RAW} SELECT id, CASE id % 6 WHEN 0 THEN CAST(substr(t, 2) AS BIGINT) WHEN 1 THEN CAST(substr(t, 5) AS BIGINT) WHEN 2 THEN CAST(split_part(t, ' + ', 1) AS BIGINT) + id
  WHEN 4 THEN 1200 + CAST(substr(t, 9, 2) AS BIGINT) + 1 END AS amount, CASE id % 6 WHEN 0 THEN '$' WHEN 1 THEN 'Rs.' WHEN 4 THEN 'EUR' ELSE '' END AS currency FROM raw"""
)
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", M.parse_amount(F.col("t")).alias("amount"), M.parse_currency(F.col("t")).alias("currency"))


@query(
    """WITH v AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 1000) AS BIGINT) AS v FROM orders), s AS (SELECT *, CAST(v AS VARCHAR) AS d FROM v)
SELECT id, CASE WHEN id % 2 = 0 THEN '$' || format('{:,}', v) ELSE 'INR ' || CASE WHEN length(d) <= 3 THEN d ELSE
  ltrim(regexp_replace(CASE WHEN length(d) % 2 = 0 THEN '0' ELSE '' END || left(d, length(d) - 3), '(..)', '\\1,', 'g'), '0,') || right(d, 3) END END AS shown FROM s"""
)
def money_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Western and Indian digit grouping."""
    v = F.floor(F.col("o_totalprice") * 1000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), M.render(F.when(F.col("o_orderkey") % 2 == 0, "$").otherwise("INR"), v).alias("shown"))


FIELDS = """
f AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'DATE' WHEN 1 THEN 'CURRENCY' WHEN 2 THEN 'NUMBER' WHEN 3 THEN 'BOOLEAN' ELSE 'note' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN '$ ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END
    WHEN 3 THEN CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'unpaid' ELSE 'maybe' END ELSE ' ' || o_orderpriority || ' ' END AS raw,
  'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%d/%m/%Y') || ' total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'no such words' WHEN o_orderkey % 7 = 1 THEN 'ORDER  ' || o_orderkey END AS evidence FROM orders),
v AS (SELECT id, kind, source, evidence, CASE kind WHEN 'DATE' THEN raw WHEN 'CURRENCY' THEN '$' || format('{:,}', CAST(regexp_extract(raw, '[0-9]+') AS BIGINT)) || '.5' WHEN 'NUMBER' THEN nullif(raw, 'none')
    WHEN 'BOOLEAN' THEN CASE raw WHEN 'Paid' THEN 'Yes' WHEN 'unpaid' THEN 'No' ELSE raw END ELSE trim(raw) END AS value,
  CASE WHEN raw = 'none' THEN 'MISSING' WHEN kind = 'DATE' AND CAST(left(raw, 2) AS INT) <= 12 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM f)
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    day, whole = F.date_format("o_orderdate", "dd/MM/yyyy"), F.floor("o_totalprice").cast("string")
    key = F.col("o_orderkey").cast("string")
    raw = (
        F.when(k == 0, day)
        .when(k == 1, F.concat(F.lit("$ "), whole, F.lit(".5")))
        .when(k == 2, F.when(F.col("o_custkey") % 2 == 0, "none").otherwise(F.col("o_custkey").cast("string")))
        .when(k == 3, F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "O", "unpaid").otherwise("maybe"))
        .otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    )
    kind = F.when(k == 0, "DATE").when(k == 1, "CURRENCY").when(k == 2, "NUMBER").when(k == 3, "BOOLEAN").otherwise("note")
    evidence = F.when(F.col("o_orderkey") % 7 == 0, "no such words").when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("ORDER  "), key))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), raw.alias("raw"), F.concat(F.lit("Order "), key, F.lit(" of "), day, F.lit(" total "), whole).alias("source"), evidence.alias("evidence"))
    return f.withColumn("cell", E.validate(F.col("kind"), F.col("raw"), "$"))


@query(f"WITH {FIELDS} SELECT id, kind, value, status FROM v")
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("id", "kind", "cell.value", "cell.status")


@query(
    f"""WITH {FIELDS} SELECT id, CASE WHEN status = 'MISSING' THEN status WHEN evidence = 'no such words' THEN 'UNVERIFIED'
  WHEN kind NOT IN ('DATE', 'CURRENCY', 'NUMBER') OR kind = 'DATE' OR strpos(regexp_replace(source, '[^0-9]', '', 'g'), regexp_replace(value, '[^0-9]', '', 'g')) > 0 THEN status ELSE 'UNVERIFIED' END AS status FROM v"""
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("id", E.ground(F.col("cell"), F.col("kind"), F.col("evidence"), F.col("source")).alias("status"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def json_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object isolated from a fenced reply, then read."""
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(E.isolate_json(reply), "$.k").cast("long").alias("k"))


@query(
    f"""WITH {FIELDS}, w AS (SELECT id // 5 AS doc_id, kind, CASE WHEN status = 'AMBIGUOUS' THEN '[AMBIGUOUS] ' || value WHEN status = 'MISSING' THEN '' ELSE value END AS cell FROM v)
SELECT doc_id, max(cell) FILTER (WHERE kind = 'DATE') AS "DATE", max(cell) FILTER (WHERE kind = 'CURRENCY') AS "CURRENCY", max(cell) FILTER (WHERE kind = 'NUMBER') AS "NUMBER" FROM w GROUP BY doc_id"""
)
def extraction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a document (five orders) as a row of columns."""
    cells = _fields(spark, sf_dir).select(F.floor(F.col("id") / 5).alias("doc_id"), F.col("kind").alias("field"), "cell.value", "cell.status")
    return E.to_csv_columns(cells, ["DATE", "CURRENCY", "NUMBER"])


@query(
    r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '[.,]', ' ', 'g'), '\b(llc|inc|llp|ltd|co|corp|corporation|company|group|the)\b', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS norm,
  CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'The ' || c_name END AS short
FROM (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN c_name || ', Pvt. Ltd.' WHEN 1 THEN 'The ' || c_name || ' Company' WHEN 2 THEN c_name ELSE 'ACME  ' || c_name END AS n FROM customer)"""
)
def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for comparison, and without trailing legal suffixes."""
    k = F.col("c_custkey") % 4
    n = F.when(k == 0, F.concat("c_name", F.lit(", Pvt. Ltd."))).when(k == 1, F.concat(F.lit("The "), "c_name", F.lit(" Company"))).when(k == 2, F.col("c_name")).otherwise(F.concat(F.lit("ACME  "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.name_norm(n).alias("norm"), F.regexp_replace(T.short_company(n), ",$", "").alias("short"))
