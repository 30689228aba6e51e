"""Queries over fact sheets made from orders, customers, line items and suppliers.

Statuses: F is paid, O unpaid, P partial with two fifths outstanding. The most
urgent orders are payment confirmations, the least urgent engagement letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import sheets as S
from quarry.plans.registry import in_order, query, table

OWNER = "Quarry & Co."
OWNERS = ["quarry &"]


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = in_order(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = lambda name, role, side: F.struct(name.alias("name"), F.lit(role).alias("role"), F.lit(side).alias("side"))
    amount = lambda label, value, status: F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit("USD").alias("currency"), status.alias("status"), F.lit("").alias("role"))
    p = F.col("o_totalprice")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "unpaid").otherwise("partial")
    total, rest = amount("Total", p, status), amount("Balance remaining", p * 0.4, F.lit("outstanding"))
    kind = F.when(F.col("o_orderpriority").startswith("1"), "Payment confirmation").when(F.col("o_orderpriority").startswith("5"), "Engagement letter").otherwise("Invoice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("ord"), "seen", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("file_name"), kind.alias("doc_type"), F.lower("c_mktsegment").alias("category"), F.lit("").alias("title"),
        (F.col("o_orderkey") % 5 == 0).alias("is_personal"), F.array(party(F.lit(OWNER), "biller", "owed"), party(F.col("c_name"), "client", "owes")).alias("parties"),
        F.when(F.col("o_orderstatus") == "P", F.array(total, rest)).otherwise(F.array(total)).alias("amounts"),
        F.array(F.struct(F.lit("Payment due").alias("label"), day.alias("date"), F.lit(False).alias("deadline"), F.when(F.col("o_orderkey") % 2 == 0, "payment_due").otherwise("").alias("type"))).alias("dates"),
    )


RECEIVABLE = """
d AS (SELECT o.*, lower(replace(c_name, ',', ' ')) AS party, c_name AS cp, lower(c_mktsegment) AS category,
  o_orderpriority LIKE '1%' AS pay, o_orderpriority LIKE '5%' AS rate, NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%') AS bill FROM orders o JOIN customer ON o_custkey = c_custkey),
g AS (SELECT party, min(cp) AS name, max(o_totalprice) AS max_face, sum(CASE WHEN pay THEN 0 ELSE o_totalprice END) AS sum_face, bool_or(pay) AS pay,
  max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS clear,
  max(CASE WHEN NOT rate THEN CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'P' THEN o_totalprice * 0.4 END END) AS gross,
  min(CASE WHEN NOT rate AND o_orderstatus = 'P' THEN o_totalprice * 0.4 END) AS balance,
  sum(CASE WHEN NOT rate AND o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS plain FROM d {where} GROUP BY party),
w AS (SELECT *, CAST(CASE WHEN balance > 0 THEN floor(balance + 0.5) WHEN pay OR coalesce(clear >= coalesce(gross, 0) * 0.9, false) THEN 0 ELSE floor(plain + 0.5) END AS BIGINT) AS owed FROM g),
m AS (SELECT party, name, greatest(owed, CAST(floor(CASE WHEN balance IS NOT NULL THEN max_face ELSE sum_face END + 0.5) AS BIGINT)) AS billed, owed FROM w)
"""
ALL = RECEIVABLE.format(where="")


@query(f"WITH {ALL} SELECT party, name, billed, billed - owed AS paid, owed FROM m")
def money_table_receivable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.money_table(_sheets(spark, sf_dir), OWNERS, True)


@query(f"""WITH {RECEIVABLE.format(where="WHERE category = 'building'")} SELECT party, name, billed, billed - owed AS paid, owed FROM m""")
def money_table_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.money_table(_sheets(spark, sf_dir), OWNERS, True, "building")


def _payables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = in_order(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    party = lambda name, role: F.struct(name.alias("name"), F.lit(role).alias("role"), F.lit("").alias("side"))
    status = F.when(F.col("l_returnflag") == "R", "settled").when(F.col("l_linestatus") == "O", "overdue").otherwise("pending")
    return i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "seen", F.lit("Supplier bill").alias("doc_type"), F.lit("").alias("category"), F.array(party(F.col("s_name"), "vendor"), party(F.lit(OWNER), "buyer")).alias("parties"),
        F.array(F.struct(F.lit("Line").alias("label"), F.col("l_extendedprice").alias("value"), F.lit("USD").alias("currency"), status.alias("status"), F.when(F.col("l_returnflag") == "R", "payment").otherwise("charge").alias("role"))).alias("amounts"),
    )


@query(
    """WITH g AS (SELECT lower(s_name) AS party, min(s_name) AS name, sum(l_extendedprice) AS face, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS clear,
  max(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS gross, sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END) AS plain
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
w AS (SELECT *, CAST(CASE WHEN coalesce(clear >= coalesce(gross, 0) * 0.9, false) THEN 0 ELSE floor(plain + 0.5) END AS BIGINT) AS owed FROM g)
SELECT party, name, greatest(owed, CAST(floor(face + 0.5) AS BIGINT)) AS billed, greatest(owed, CAST(floor(face + 0.5) AS BIGINT)) - owed AS paid, owed FROM w"""
)
def money_table_payable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.money_table(_payables(spark, sf_dir), OWNERS, False)


@query(f"WITH {ALL} SELECT party, name, owed AS amount FROM m WHERE owed > 0 ORDER BY owed DESC, party LIMIT 1")
def amounts_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apply_op(S.amounts(_sheets(spark, sf_dir), OWNERS, S.SheetQuery()), "max")


@query(f"WITH {ALL} SELECT party, name, owed AS amount FROM m WHERE owed > 0 ORDER BY owed, party DESC LIMIT 1")
def amounts_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apply_op(S.amounts(_sheets(spark, sf_dir), OWNERS, S.SheetQuery()), "min")


@query(f"WITH {ALL} SELECT party, name, owed AS amount FROM m WHERE owed > 0 AND owed BETWEEN 20000 AND 60000")
def amounts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.amounts(_sheets(spark, sf_dir), OWNERS, S.SheetQuery(range="20,000 - 60,000"))


@query(f"WITH {ALL} SELECT CAST(floor(avg(owed) + 0.5) AS BIGINT) AS result FROM m WHERE owed > 0")
def amounts_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apply_op(S.amounts(_sheets(spark, sf_dir), OWNERS, S.SheetQuery()), "average")


@query(f"WITH {ALL} SELECT CAST(coalesce(sum(billed - owed), 0) AS BIGINT) AS result FROM m WHERE billed - owed > 0")
def amounts_paid_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apply_op(S.amounts(_sheets(spark, sf_dir), OWNERS, S.SheetQuery(status="paid")), "sum")


@query("SELECT DISTINCT lower(c_name) AS party, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def parties_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parties(_sheets(spark, sf_dir), OWNERS, S.SheetQuery(select="parties"))


@query("SELECT o_orderkey AS ord, 'order-' || o_orderkey AS file_name, 'order-' || o_orderkey AS label FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0 AND o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '5%'")
def sheet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.documents(_sheets(spark, sf_dir), S.SheetQuery(select="documents", is_personal=True, doc_type="invoice"))


@query("SELECT o_orderkey AS ord, 'order-' || o_orderkey AS file_name, 'Payment due' AS label, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-06-30'")
def sheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dates(_sheets(spark, sf_dir), S.SheetQuery(select="dates", obligations_only=True, date_type="payment", date_from="1997-01-01", date_to="1997-06-30"))


@query(f"""SELECT '{OWNER}' AS owner, count(DISTINCT o_custkey) AS others FROM orders JOIN customer ON o_custkey = c_custkey""")
def detect_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.detect_owner(_sheets(spark, sf_dir))


FACTS = """
facts AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord, CASE WHEN l_orderkey % 4 = 0 THEN 'k:supplier#' || l_suppkey % 50 WHEN l_orderkey % 4 = 3 THEN 'src:/bills/' || l_orderkey ELSE 's:supplier ' || l_suppkey END AS merge_key,
  CASE WHEN l_orderkey % 4 = 3 THEN '' WHEN l_linenumber = 1 THEN 'Client' ELSE 'Supplier ' || l_suppkey END AS subject0, CASE WHEN l_quantity > 10 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS value,
  CASE WHEN l_tax > 0.04 THEN CAST(floor(l_extendedprice / 2) AS BIGINT) END AS balance,
  CASE l_returnflag WHEN 'R' THEN 'paid' WHEN 'A' THEN 'partial' ELSE CASE l_linestatus WHEN 'O' THEN 'overdue' ELSE 'quote' END END AS status, 'bill-' || l_orderkey AS source_name FROM lineitem)
"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 4
    s = F.col("l_suppkey").cast("string")
    return in_order(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("ord"), "seen", F.when(k == 0, F.concat(F.lit("Supplier#"), (F.col("l_suppkey") % 50).cast("string"))).alias("key"),
        F.when(k == 3, "").when((F.col("l_linenumber") == 1) & (k == 0), "Client").otherwise(F.concat(F.lit("Supplier "), s)).alias("subject"),
        F.when(F.col("l_quantity") > 10, F.floor("l_extendedprice")).alias("value"), F.when(F.col("l_tax") > 0.04, F.floor(F.col("l_extendedprice") / 2)).alias("balance"),
        F.when(F.col("l_returnflag") == "R", "paid").when(F.col("l_returnflag") == "A", "partial").when(F.col("l_linestatus") == "O", "overdue").otherwise("quote").alias("status"),
        F.concat(F.lit("bill-"), F.col("l_orderkey").cast("string")).alias("source_name"), F.concat(F.lit("/bills/"), F.col("l_orderkey").cast("string")).alias("source_path"),
    )


RANKED = """
r AS (SELECT *, CASE WHEN merge_key LIKE 'k:%' THEN subject0 WHEN merge_key LIKE 'src:%' THEN '' ELSE 'Supplier ' || substr(merge_key, 12) END AS subject,
  CASE status WHEN 'paid' THEN 5 WHEN 'partial' THEN 4 WHEN 'overdue' THEN 3 ELSE 1 END AS rank FROM facts),
g AS (SELECT merge_key, coalesce(min_by(subject, ord) FILTER (WHERE subject NOT IN ('', 'Client')), min_by(subject, ord) FILTER (WHERE subject <> '')) AS subject,
  min_by(value, ord) FILTER (WHERE value IS NOT NULL) AS value, min_by(balance, ord) FILTER (WHERE balance IS NOT NULL) AS balance,
  arg_max(status, rank * 1000000000000000 - ord) AS status, arg_max(source_name, rank * 1000000000000000 - ord) AS source_name, max(rank) AS rank FROM r GROUP BY merge_key)
"""


@query(f"WITH {FACTS}, {RANKED} SELECT merge_key, subject, value, balance, status, source_name, CAST(CASE WHEN rank IN (5, 1) THEN 0 ELSE coalesce(balance, value, 0) END AS BIGINT) AS owed FROM g")
def facts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_facts(_facts(spark, sf_dir)).withColumn("owed", S.fact_owed())


@query(
    f"""WITH {FACTS}, p AS (SELECT * FROM facts WHERE value > 0),
b AS (SELECT merge_key, min_by(value, ord) AS value_a, min_by(source_name, ord) AS source_a FROM p GROUP BY merge_key)
SELECT merge_key, any_value(value_a) AS value_a, any_value(source_a) AS source_a, min_by(value, ord) AS value_b, min_by(source_name, ord) AS source_b FROM p JOIN b USING (merge_key) WHERE value <> value_a GROUP BY merge_key"""
)
def facts_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conflicts(_facts(spark, sf_dir))


@query(
    """SELECT r_name AS currency, count(*) AS n, CAST(sum(CAST(floor(s_acctbal + 0.5) AS BIGINT)) AS BIGINT) AS total, max(CAST(floor(s_acctbal + 0.5) AS BIGINT)) AS highest, min(CAST(floor(s_acctbal + 0.5) AS BIGINT)) AS lowest
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def per_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions stand in for currencies, which are never summed together."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    v = S.half_up(F.col("s_acctbal")).cast("long")
    return s.groupBy(F.col("r_name").alias("currency")).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.max(v).alias("highest"), F.min(v).alias("lowest"))


@query(
    """WITH r AS (SELECT o_orderkey AS ord, '/f/' || o_orderkey % 5000 AS path, CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS entity_name,
  CASE WHEN c_custkey % 3 = 0 THEN '22ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gstin, CASE WHEN c_custkey % 3 = 1 THEN 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F' END AS pan
  FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, CASE WHEN gstin IS NOT NULL THEN 'gstin:' || gstin WHEN pan IS NOT NULL THEN 'pan:' || pan ELSE 'name:' || lower(entity_name) END AS key FROM r),
n AS (SELECT key, entity_name AS name, count(*) AS n, min(ord) AS seen FROM k GROUP BY ALL), b AS (SELECT key, arg_max(name, n * 1000000000 - seen) AS name FROM n GROUP BY key),
g AS (SELECT key, count(DISTINCT path) AS files, any_value(gstin) AS gstin, any_value(pan) AS pan FROM k GROUP BY key)
SELECT key, name, gstin, pan, files FROM g JOIN b USING (key) WHERE key NOT IN (SELECT 'pan:ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F' FROM customer WHERE c_custkey % 10 = 1)
  AND lower(name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 7 = 0)"""
)
def entity_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    four = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    pan = F.concat(F.lit("ABCDE"), four, F.lit("F"))
    r = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("/f/"), (F.col("o_orderkey") % 5000).cast("string")).alias("path"), F.when(F.col("o_orderkey") % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("entity_name"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("22ABCDE"), four, F.lit("F1Z5"))).alias("gstin"), F.when(F.col("c_custkey") % 3 == 1, pan).alias("pan"),
    )
    claimed = c.filter("c_custkey % 7 = 0").select(F.lower("c_name").alias("norm"))
    dismissed = c.filter("c_custkey % 10 = 1").select(F.concat(F.lit("pan:"), pan).alias("key"))
    return S.suggest_entities(r, claimed, dismissed)
