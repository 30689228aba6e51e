"""Queries on what models reply, on what sheets lack, and on the library's listings and resets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import money as M
from quarry.operators import clients as C
from quarry.operators import deadlines as L
from quarry.operators import extraction as E
from quarry.operators import library as B
from quarry.operators import model_batches as N
from quarry.operators import model_port as P
from quarry.operators import questions as Q
from quarry.operators import retrieval as R
from quarry.operators import sheets as S
from quarry.plans.dates_queries import DEADLINES, TODAY, _deadlines, _today
from quarry.plans.library_queries import FILES, files_of
from quarry.plans.money_queries import ALL, OWNER, OWNERS, _payables, _sheets
from quarry.plans.registry import query, table
from quarry.plans.workspace import Workspace

IDS = """
t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'gstin 27abcde' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || 'f1z5 of the firm' WHEN 1 THEN 'Pan: ABCDE' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || 'F' WHEN 2 THEN 'XABCDE1234F' ELSE o_orderpriority END AS text FROM orders)
"""


def _tax_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 4, F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    text = F.when(k == 0, F.concat(F.lit("gstin 27abcde"), n, F.lit("f1z5 of the firm"))).when(k == 1, F.concat(F.lit("Pan: ABCDE"), n, F.lit("F"))).when(k == 2, "XABCDE1234F").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query(
    rf"""WITH {IDS}, i AS (SELECT id, regexp_extract(upper(text), '\b({E.GSTIN})\b', 1) AS g, regexp_extract(upper(text), '\b({E.PAN})\b', 1) AS p FROM t)
SELECT id, nullif(g, '') AS gstin, CASE WHEN g <> '' THEN substr(g, 3, 10) ELSE p END AS pan FROM i WHERE (g <> '' OR p <> '') AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"""
)
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax identifiers of files without a stored identity."""
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return E.new_identities(_tax_texts(spark, sf_dir), known, "id", "text")


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN CAST(o_custkey % 900 + 100 AS BIGINT) * 1000 + 234 WHEN 2 THEN o_custkey WHEN 3 THEN NULL ELSE o_custkey * 1000 + 1 END AS amount FROM orders"""
)
def prose_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by currency or grouping; a bare number in a sentence is none."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    grouped = F.concat(F.lit("paid "), (F.col("o_custkey") % 900 + 100).cast("string"), F.lit(",234.50 for 2026"))
    text = F.when(k == 0, c).when(k == 1, grouped).when(k == 2, F.concat(F.lit("owes Rs. "), c, F.lit(" now"))).when(k == 3, F.concat(F.lit("in 2026 item "), c)).otherwise(F.concat(F.lit("$"), M.western(F.col("o_custkey") * 1000 + 1)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), M.prose_amount(text).alias("amount"))


@query(
    """SELECT o_orderkey AS id, 'order ' || o_custkey AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'k' || o_custkey ELSE '' END AS key, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS BIGINT) ELSE CAST(o_custkey % 900 + 100 AS BIGINT) * 1000 END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 12 END AS balance, lower(o_orderstatus) AS status FROM orders WHERE o_orderkey % 7 <> 0"""
)
def facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of fenced replies; replies without an array have none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    value = F.when(k % 2 == 0, F.concat(c, F.lit(".75"))).otherwise(F.concat(F.lit('"$'), (F.col("o_custkey") % 900 + 100).cast("string"), F.lit(',000"')))
    item = F.concat(
        F.lit('{"subject":" order '), c, F.lit('","key":'), F.when(k % 3 == 0, F.concat(F.lit('"k'), c, F.lit('"'))).otherwise("null"), F.lit(',"value":'), value, F.lit(',"balance":'), F.when(k % 3 == 0, '"no"').otherwise("12"),
        F.lit(',"status":"'), F.lower("o_orderstatus"), F.lit('"}'),
    )
    reply = F.when(k % 7 == 0, "I found nothing.").otherwise(F.concat(F.lit("```json\n["), item, F.lit(',{"subject":"","value":null}]\n```')))
    got = E.parse_facts(table(spark, sf_dir, "orders").select(k.alias("id"), reply.alias("reply")), "reply")
    return got.select("id", "subject", "key", "value", "balance", "status")


@query(
    """SELECT o_orderkey AS id, o_custkey % 9 AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'Deadline' ELSE 'Pay ' || o_custkey END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'RENEWAL' ELSE 'ACTION' END AS kind,
  CASE WHEN o_orderkey % 4 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'YEARLY' WHEN o_orderkey % 5 = 1 THEN 'WEEKLY' ELSE 'NONE' END AS recurring FROM orders WHERE o_orderkey % 6 <> 5"""
)
def deadlines_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated items of bare arrays and of objects, with their words normalised; undated ones go."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = F.concat(
        F.lit('{"'), F.when(k % 2 == 0, "doc").otherwise("docId"), F.lit('":'), (c % 9).cast("string"), F.lit(',"title":"'), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("Pay "), c.cast("string"))), F.lit('","date":"'),
        F.when(k % 6 == 5, "next week").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit('","kind":"'), F.when(k % 2 == 0, "renewal").otherwise("bill"), F.lit('","confidence":"'), F.when(k % 4 == 0, " high ").otherwise("sure"),
        F.lit('","recurring":"'), F.when(k % 5 == 0, "annually").when(k % 5 == 1, "daily").otherwise("never"), F.lit('"}'),
    )
    reply = F.when(k % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('Here: {"deadlines":['), item, F.lit(']} done')))
    return E.parse_deadlines(table(spark, sf_dir, "orders").select(k.alias("id"), reply.alias("reply")), "reply").drop("description")


@query(
    """SELECT o_orderkey AS id, o_custkey % 9 AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'rent' END AS series, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01' END AS period, CASE WHEN o_orderkey % 3 = 0 THEN 'ABCDE1234F' END AS pan
FROM orders WHERE o_custkey % 9 > 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"""
)
def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a series and its period, or a valid identifier."""
    k = F.col("o_orderkey")
    item = F.concat(
        F.lit('{"documents":[{"doc":'), (F.col("o_custkey") % 9).cast("string"), F.lit(',"series":"rent","period":"'), F.when(k % 2 == 0, "2024-01").when(k % 3 == 0, "None").when(k % 3 == 1, " N/A").otherwise("NULL"), F.lit('","pan":"'),
        F.when(k % 3 == 0, "abcde 1234f").otherwise("12345"), F.lit('"}]}'),
    )
    return E.parse_documents(table(spark, sf_dir, "orders").select(k.alias("id"), item.alias("reply")), "reply").select("id", "doc", "series", "period", "pan")


@query(
    f"""SELECT o_orderkey AS ord, o_orderstatus = 'P' AS needs_roles, o_orderkey % 2 <> 0 AS needs_types, false AS inconsistent, false AS lacks_client, o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '5%' AND o_orderstatus <> 'F' AS lacks_biller,
  CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false ELSE o_orderkey % 5 = 0 END AS personal, c_name AS other FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def sheet_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sheet has to be asked again, and its folder's say."""
    s = _sheets(spark, sf_dir)
    k = F.col("ord")
    path = F.when(k % 3 == 0, "/data/Family/clients/x.pdf").when(k % 3 == 1, "/data/Client/x.pdf").otherwise("/data/x.pdf")
    only = F.filter("parties", lambda p: p["role"] == "client")
    return s.select(
        "ord", S.needs_roles(F.col("amounts")).alias("needs_roles"), S.needs_date_types(F.col("dates")).alias("needs_types"), S.inconsistent(F.col("doc_type"), F.col("amounts")).alias("inconsistent"),
        S.lacks_client(F.col("doc_type"), F.col("parties"), F.col("amounts")).alias("lacks_client"), S.lacks_biller(F.col("doc_type"), only, F.col("amounts")).alias("lacks_biller"), S.folder_signal(path, F.col("is_personal")).alias("personal"),
        S.first_other(F.col("parties"), F.lit(OWNER.lower())).alias("other"),
    )


PLACEHOLDERS = "owner,Client,clients,customer,CUSTOMERS,tenant,patient,Member,me,self,N.A.,na,unnamed,unknown,Account Holder,cardholder,Policyholder,user,Borrower,the client,A Client,recipient,payer,Real Person"


@query(
    """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 24 = 23 THEN 'Real Person' ELSE c_name END AS other FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def placeholder_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a bill is for, where an extractor put a placeholder first."""
    s = _sheets(spark, sf_dir)
    first = F.element_at(F.split(F.lit(PLACEHOLDERS), ","), (F.col("ord") % 24 + 1).cast("int"))
    party = F.struct(first.alias("name"), F.lit("client").alias("role"), F.lit("owes").alias("side"))
    facts = S._facts(F.concat(F.array(party), "parties"), OWNERS)
    return s.select("ord", facts.alias("p")).select("ord", S.counterparty(F.col("p"), True).alias("other"))


@query(f"SELECT '{OWNER}' AS firm, count(*) AS bills FROM orders JOIN customer ON o_custkey = c_custkey HAVING count(*) >= 2")
def owner_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.owner_firm(_sheets(spark, sf_dir))


PAYABLE = """
pg AS (SELECT lower(s_name) AS party, min(s_name) AS name, sum(l_extendedprice) AS face, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS clear, max(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS gross,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END) AS plain FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
pw AS (SELECT *, CAST(CASE WHEN coalesce(clear >= coalesce(gross, 0) * 0.9, false) THEN 0 ELSE floor(plain + 0.5) END AS BIGINT) AS owed FROM pg),
pm AS (SELECT party, name, greatest(owed, CAST(floor(face + 0.5) AS BIGINT)) AS billed, owed FROM pw),
both_ AS (SELECT 'receivable' AS direction, party, name, billed, owed FROM m UNION ALL SELECT 'payable', party, name, billed, owed FROM pm),
totals AS (SELECT direction, CAST(sum(billed) AS BIGINT) AS billed, CAST(sum(billed - owed) AS BIGINT) AS paid, CAST(sum(owed) AS BIGINT) AS owed, count(*) AS parties, count(*) FILTER (WHERE owed > 0) AS owing FROM both_ GROUP BY direction)
"""


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.money_totals(S.money_table(_sheets(spark, sf_dir), OWNERS, True), S.money_table(_payables(spark, sf_dir), OWNERS, False))


@query(f"WITH {ALL}, {PAYABLE} SELECT * FROM totals")
def money_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is owed to the owner and by them, in all."""
    return _totals(spark, sf_dir)


@query(f"WITH {ALL}, {PAYABLE} SELECT CAST(coalesce(sum(CASE WHEN direction = 'receivable' THEN owed ELSE -owed END), 0) AS BIGINT) AS difference FROM totals")
def money_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.difference(_totals(spark, sf_dir))


@query(f"WITH {ALL} SELECT party, name, billed, billed - owed AS paid, owed FROM m WHERE party IN ('customer#000000001', 'customer#000000002', 'customer#000000004')")
def money_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The money rows of named parties side by side."""
    return S.compare_parties(S.money_table(_sheets(spark, sf_dir), OWNERS, True), ["Customer#000000001, Inc.", "The CUSTOMER#000000002", " customer#000000004 Group "])


LETTERS = "translate({0}, '0123456789', 'abcdefghij')"


@query(
    f"""WITH {ALL}, {PAYABLE}, n AS (SELECT party, {LETTERS.format('right(name, 9)')} AS name, billed, billed - owed AS paid, owed FROM both_),
f AS (SELECT party, name, CASE WHEN owed > 0 AND paid > 0 THEN name || ': USD ' || format('{{:,}}', billed) || ' billed, USD ' || format('{{:,}}', paid) || ' paid, USD ' || format('{{:,}}', owed) || ' still owed (partially paid)'
  WHEN owed > 0 THEN name || ': USD ' || format('{{:,}}', owed) || ' still owed (unpaid)' WHEN billed > 0 THEN name || ': USD ' || format('{{:,}}', billed) || ' billed, fully paid' END AS fact FROM n)
SELECT DISTINCT o_orderkey AS id, party, fact FROM orders JOIN f ON name = {LETTERS.format("lpad(CAST(o_custkey AS VARCHAR), 9, '0')")} WHERE fact IS NOT NULL AND o_orderkey % 2 = 0"""
)
def money_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing facts of the parties that a question names; their numbers are spelt in letters, so that each is a token."""
    k = F.col("o_orderkey")
    letters = lambda c: F.translate(c, "0123456789", "abcdefghij")
    name = letters(F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    q = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("Is the bill of "), name, F.lit(" paid?"))).otherwise("Is it paid?").alias("q"))
    tables = S.money_table(_sheets(spark, sf_dir), OWNERS, True).unionByName(S.money_table(_payables(spark, sf_dir), OWNERS, False))
    return S.money_facts(q, tables.withColumn("name", letters(F.right("name", F.lit(9)))), "id", "q")


@query(
    f"""WITH {DEADLINES}, b AS (SELECT id, status, TRY_CAST(due_date AS DATE) AS due, id % 9 = 0 AS reminder FROM deadlines),
t AS (SELECT 'open' AS tab, id, due FROM b WHERE status = 'PENDING' AND due IS NOT NULL UNION ALL SELECT 'reminded', id, due FROM b WHERE status = 'DONE' OR reminder)
SELECT tab, CASE WHEN due IS NULL THEN 'NO_DATE' WHEN due < DATE '{TODAY}' THEN 'OVERDUE' WHEN due <= DATE '{TODAY}' + 7 THEN 'DUE_SOON' ELSE 'UPCOMING' END AS bucket, count(*) AS items FROM t GROUP BY ALL"""
)
def deadline_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the two tabs by bucket."""
    d = L.buckets(_deadlines(spark, sf_dir), _today()).withColumn("reminder_set", F.col("id") % 9 == 0)
    return L.tabs(d).groupBy("tab", "bucket").agg(F.count("*").alias("items"))


@query(
    f"""WITH {DEADLINES} SELECT id, due_date, row_number() OVER (ORDER BY CASE WHEN due_date = 'soon' THEN 1 ELSE 0 END, due_date, id) AS place FROM deadlines WHERE status = 'PENDING'"""
)
def deadline_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending deadlines, undated ones last, by due date and then as they came."""
    d = _deadlines(spark, sf_dir).filter("status = 'PENDING'")
    return B.listing(d, ~D.is_iso(F.col("due_date")), F.col("due_date"), F.col("id")).select("id", "due_date", "place")


@query(f"WITH {FILES} SELECT doc_id, row_number() OVER (ORDER BY mtime DESC, file_name) AS place FROM files WHERE status = 'INDEXED'")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files indexed last."""
    return B.listing(files_of(spark, sf_dir).filter("status = 'INDEXED'"), F.desc("mtime"), F.col("file_name")).select("doc_id", "place")


@query("SELECT conv_id, turns, row_number() OVER (ORDER BY turns DESC, conv_id DESC) AS place FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations by what moved last; their length stands in for the time."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return B.listing(c, F.desc("turns"), F.desc("conv_id")).select("conv_id", "turns", "place")


@query("SELECT s_suppkey AS client_id, row_number() OVER (ORDER BY lower(s_name), s_suppkey) AS place FROM supplier")
def clients_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listing(table(spark, sf_dir, "supplier"), F.lower("s_name"), F.col("s_suppkey")).select(F.col("s_suppkey").alias("client_id"), "place")


@query("SELECT c_custkey AS account, CASE WHEN c_custkey % 4 = 0 THEN 'pro' ELSE 'trial' END AS plan, CASE WHEN c_custkey % 8 = 0 THEN 'n' || c_custkey ELSE 'o' || c_custkey END AS billing_id FROM customer")
def plan_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New plans, and billing ids where they are given."""
    k = F.col("c_custkey")
    accounts = table(spark, sf_dir, "customer").select(k.alias("account"), F.lit("trial").alias("plan"), F.concat(F.lit("o"), k.cast("string")).alias("billing_id"))
    changes = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(k.alias("account"), F.lit("pro").alias("plan"), F.when(k % 8 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("billing_id"))
    return B.patch(accounts, changes, ["account"])


@query(f"WITH {FILES} SELECT doc_id, status FROM files WHERE status <> 'INDEXED'")
def drift_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed files without any vector are to be indexed anew."""
    f = files_of(spark, sf_dir)
    return B.reset_if_drifted(f, table(spark, sf_dir, "embeddings").filter("embedding is null")).select("doc_id", "status")


@query(f"WITH {FILES} SELECT doc_id, status FROM files")
def drift_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where there are vectors, every file keeps its state."""
    return B.reset_if_drifted(files_of(spark, sf_dir), table(spark, sf_dir, "embeddings")).select("doc_id", "status")


@query(
    f"""WITH {FILES}, c AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM files)
SELECT f.doc_id, CASE WHEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) IN ('csv', 'tsv', 'txt', 'md') AND size <= 524288 THEN coalesce(length(text), length(array_to_string(parts, chr(10))) + 1) ELSE length(array_to_string(parts, chr(10))) + 1 END AS n FROM files f JOIN c USING (doc_id)"""
)
def content_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text of small text files, joined chunks of all others."""
    f = files_of(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    chunks = f.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunk_index", "text"))
    return B.content(f, chunks, f.select("path", "text")).select(F.col("path").cast("long").alias("doc_id"), F.length("content").cast("long").alias("n"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, count(*) AS chunks, CAST(sum(length(left(text, CAST(700 - before AS BIGINT)))) AS BIGINT) AS n FROM b WHERE before < 700 GROUP BY doc_id"""
)
def snippet_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading lines up to 700 characters, the last one cut."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return B.snippet_gather(lines, "doc_id", 700).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("n"))


@query(
    """SELECT o_orderkey AS id, o_orderkey % 6 < 4 AS refusal FROM orders"""
)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are no more than the refusal."""
    k = F.col("o_orderkey") % 6
    forms = [
        "I could not find relevant information in your files.", "  I could not find relevant information in your files", "SORRY - I COULD NOT FIND RELEVANT INFORMATION IN YOUR FILES!", "We could not find relevant information.",
        "It is due on the third of May, says the invoice of April, and that is all there is. I could not find relevant information in your files.", "I couldn't find that in your files.",
    ]
    a = F.element_at(F.array(*map(F.lit, forms)), (k + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.is_refusal(a).alias("refusal"))


@query("SELECT o_custkey AS client, CAST(greatest(ceil(sum(length(o_orderpriority) * 1000) / 280000), ceil(count(*) / 10)) AS BIGINT) AS calls FROM orders GROUP BY o_custkey")
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least number of model calls for each client's documents."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.sum(F.length("o_orderpriority") * 1000).alias("chars"), F.count("*").alias("docs"))
    return o.select("client", P.call_batches(F.struct("chars", "docs")).cast("long").alias("calls"))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND day(o_orderdate) % 2 = 0 AS needed FROM orders WHERE o_orderkey % 2 = 0 AND day(o_orderdate) % 2 = 0")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose extension says that there is no text in them."""
    k = F.col("o_orderkey")
    name = F.when((k % 2 == 0) & (F.dayofmonth("o_orderdate") % 2 == 0), "Scan.HEIC").when(k % 2 == 0, "notes.md").otherwise("noextension")
    return table(spark, sf_dir, "orders").select(k.alias("id"), B.is_binary(name).alias("needed")).filter("needed")




@query(
    """WITH m AS (SELECT l_orderkey AS id, 'March' || CASE l_partkey % 3 WHEN 0 THEN 'Rent' WHEN 1 THEN 'Lease' ELSE 'Rents' END || '-' || l_suppkey || '.pdf' AS name FROM lineitem),
t AS (SELECT id, unnest(['march', CASE WHEN name LIKE 'MarchRent%' THEN 'rent' ELSE 'lease' END]) AS token FROM m), n AS (SELECT id, count(*) AS n FROM m GROUP BY id)
SELECT id, CASE token WHEN 'lease' THEN 'lease' ELSE token END AS token FROM t JOIN n USING (id) WHERE token <> 'march' OR true GROUP BY id, token, n HAVING count(*) = n"""
)
def common_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that the names of all files of a match share."""
    kind = F.when(F.col("l_partkey") % 3 == 1, "Lease").when(F.col("l_partkey") % 3 == 2, "Rents").otherwise("Rent")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("March"), kind, F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".pdf")).alias("name"))
    return Q.common_name_tokens(m, "id", "name")


@query(
    """WITH l AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) > 150 THEN trim(left(t, 150)) || '…' ELSE t END AS preview FROM l WHERE t <> ''"""
)
def content_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 characters of each file, of one chunk each."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    return R.content_preview(chunks, "doc_id", 150)


@query(
    """SELECT c_custkey AS client_id, CASE WHEN c_custkey % 5 = 0 THEN 'Renamed ' || c_custkey ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE (s_suppkey + 1000000) % 7 <> 0"""
)
def client_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients after some were created, renamed and deleted."""
    k = F.col("c_custkey")
    clients = table(spark, sf_dir, "customer").select(k.alias("client_id"), F.col("c_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("client_id"), F.col("s_name").alias("name"))
    named = C.rename(clients, table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(k.alias("client_id"), F.concat(F.lit("Renamed "), k.cast("string")).alias("name")))
    both, idents = C.create(named, C.identifiers(named), new)
    gone = both.filter("client_id % 7 = 0")
    return C.delete([both, idents], gone)[0]


@query(
    """WITH i AS (SELECT c_custkey AS client_id, lower(c_name) AS norm FROM customer UNION SELECT c_custkey, 'alias ' || c_custkey FROM customer WHERE c_custkey % 2 = 0)
SELECT client_id, norm FROM i WHERE NOT (client_id % 6 = 0 AND norm LIKE 'alias%')"""
)
def identifier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers after some were added, in other spellings too, and some removed."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    own = c.select(k.alias("client_id"), F.lower("c_name").alias("norm"))
    alias = lambda text, keep: c.filter(keep).select(k.alias("client_id"), F.concat(F.lit(text), k.cast("string")).alias("norm"))
    added = C.add_identifiers(own, alias(" Alias  ", "c_custkey % 2 = 0").union(alias("ALIAS ", "c_custkey % 4 = 0")).union(c.select(k, F.lit("x"))))
    return C.remove_identifiers(added, alias("alias ", "c_custkey % 6 = 0"))


@query(f"""WITH {FILES} SELECT doc_id FROM files WHERE doc_id % 2 = 1 OR doc_id % 3 = 0""")
def unscanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content was not scanned by this version."""
    f = files_of(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    seen = f.filter("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 3 == 0, B.salted(F.col("hash"), "v5")).otherwise(B.salted(F.coalesce("hash", F.lit("")), "v6")).alias("scan_key"))
    return B.unscanned(f.withColumn("hash", F.coalesce("hash", F.lit(""))), seen, "v6").select("doc_id")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0""")
def untyped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return B.untyped(table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "Invoice").when(k % 3 == 1, " ").alias("doc_type"))).select("id")


@query(
    """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 5 = 1 THEN 'occupied' WHEN o_custkey % 2 = 1 THEN 'orphaned' ELSE 'undo' END AS outcome FROM orders"""
)
def undo_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which moves can be undone: the file is there, its old place is free, and its folder exists."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/f"), k.cast("string"))
    folder = F.concat(F.lit("/old/"), (F.col("o_custkey") % 2).cast("string"))
    o = table(spark, sf_dir, "orders").select(k, F.concat(folder, name).alias("from_path"), F.concat(F.lit("/new"), name).alias("to_path"))
    there = o.filter("o_orderkey % 5 <> 0").select(F.col("to_path").alias("path"), F.lit(False).alias("is_dir"))
    there = there.union(o.filter("o_orderkey % 5 = 1").select("from_path", F.lit(False))).union(o.select(F.lit("/old/0"), F.lit(True)).distinct())
    return B.undo_outcomes(o.withColumnRenamed("o_orderkey", "seq"), there).select("seq", "outcome")


@query(
    f"""WITH {FILES}, k AS (SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'document' WHEN 2 THEN 'document' WHEN 3 THEN 'document' WHEN 4 THEN 'image' ELSE '.x' || doc_id % 3 END AS family FROM files)
SELECT DISTINCT a.doc_id AS file, b.source AS folder FROM k a JOIN (SELECT DISTINCT source, family FROM k WHERE doc_id % 2 = 0) b USING (family) WHERE a.doc_id % 2 = 1"""
)
def compatible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the folders with a member of their family; unknown extensions fit their like only."""
    f = files_of(spark, sf_dir)
    f = f.withColumn("file_name", F.when(F.col("doc_id") % 6 == 5, F.concat("file_name", F.lit(".x"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.col("file_name")))
    return Q.compatible_files(f.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("file"), "file_name"), f.filter("doc_id % 2 = 0").select(F.col("source").alias("folder"), "file_name"))


def _faulty(texts: list[str]) -> list[str | None] | None:
    """A model whose replies to several texts can't be read if a difficult one is among them, and that never reads the worst."""
    if any(len(t) % 50 == 0 for t in texts) or (len(texts) > 1 and any(len(t) % 17 == 0 for t in texts)):
        return None
    return [None if len(texts) > 2 and len(t) % 11 == 0 else f"{len(t)} characters" for t in texts]


@query(
    """SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 50 <> 0 THEN length(text) || ' characters' END AS reply, CASE WHEN length(coalesce(text, '')) % 50 <> 0 THEN 'answered' ELSE 'unreadable' END AS state FROM documents"""
)
def model_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a faulty model to every document: batches are halved until only what can't be read is left."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("hash", F.sha2("text", 256))
    folder = Workspace(spark, "model-ladder").path("replies")
    return N.answer(d, _faulty, folder, "2024-05-01", calls=1 << 40, wave=1 << 20).select("doc_id", "reply", "state")


@query("SELECT o_orderkey AS ord, o_orderkey % 4 = 0 AS inconsistent, o_orderkey % 4 IN (1, 2) AS lacks_client FROM orders")
def sheet_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills whose paid line exceeds what is said to be owed, and bills or notes of a balance without a client."""
    k = F.col("o_orderkey") % 4
    amount = lambda label, value, status: F.struct(F.lit(label).alias("label"), F.lit(float(value)).alias("value"), F.lit(status).alias("status"))
    party = lambda role: F.array(F.struct(F.lit("X").alias("name"), F.lit(role).alias("role"), F.lit("").alias("side")))
    kind = F.when(k < 2, "Invoice").when(k == 2, "Note").otherwise("Letter")
    amounts = F.when(k == 0, F.array(amount("Balance due", 100, "unpaid"), amount("Payment", 120, "paid"))).when(k == 1, F.array(amount("Balance", 100, "unpaid"), amount("Payment", 80, "paid"))).when(k == 2, F.array(amount("Remaining", 50, "owed"))).otherwise(F.array(amount("Total", 5, "paid")))
    parties = F.when(k == 0, party("client")).otherwise(party("provider"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), S.inconsistent(kind, amounts).alias("inconsistent"), S.lacks_client(kind, parties, amounts).alias("lacks_client"))
