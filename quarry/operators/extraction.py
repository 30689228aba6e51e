"""Structured extraction: typed validation, grounding in the source, and shaping of replies.

What a model answers comes in as columns; see ``quarry.operators.model_port``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import money as M
from quarry.functions import text as T

OK, MISSING, AMBIGUOUS, UNVERIFIED = "OK", "MISSING", "AMBIGUOUS", "UNVERIFIED"
CELL = "struct<value:string,status:string>"


def ambiguous_date(c: Column) -> Column:
    """Numeric dates of which both first parts could be a month."""
    p = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-][0-9]{2,4}$"
    a, b = (F.regexp_extract(F.trim(c), p, i).try_cast("int") for i in (1, 2))
    return F.coalesce(a.between(1, 12) & b.between(1, 12), F.lit(False))


def field_type(c: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("DATE", "CURRENCY", "NUMBER", "BOOLEAN", "TEXT"), t).otherwise("TEXT")


def validate(kind: Column, raw: Column, symbol: str = "") -> Column:
    """struct(value, status) of a raw answer for a field type."""
    v, t = F.trim(raw), field_type(kind)
    low = F.lower(v)
    amount = M.whole(v)
    frac = M.fraction(v)
    money = F.concat(M.render(F.lit(symbol), amount), F.when(frac.isNotNull(), F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    yes_no = F.when(low.isin("yes", "true", "y", "paid", "1"), "Yes").when(low.isin("no", "false", "n", "unpaid", "0"), "No").otherwise(v)
    value = F.when(t == "CURRENCY", money).when(t == "BOOLEAN", yes_no).otherwise(v)
    lost = v.isNull() | (v == "") | T.is_nullish(v) | ((t == "CURRENCY") & amount.isNull()) | ((t == "NUMBER") & ~v.rlike("[0-9]"))
    status = F.when(lost, MISSING).when((t == "DATE") & ambiguous_date(v), AMBIGUOUS).otherwise(OK)
    return F.struct(F.when(~F.coalesce(lost, F.lit(True)), value).alias("value"), status.alias("status"))


def value_in_text(value: Column, text: Column) -> Column:
    """As text, or as a run of digits."""
    v, h = T.token_norm(value), T.token_norm(text)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return (v != "") & (h != "") & (h.contains(v) | ((digits(v) != "") & digits(h).contains(digits(v))))


def ground(cell: Column, kind: Column, evidence: Column, source: Column) -> Column:
    """Status after grounding: a quote must occur, and a factual value must occur as text or digits."""
    e, s = T.token_norm(evidence), T.token_norm(source)
    found = (e != "") & (s != "") & s.contains(e)
    factual = field_type(kind).isin("CURRENCY", "NUMBER", "DATE")
    known = ~factual | (found & value_in_text(cell["value"], evidence)) | value_in_text(cell["value"], source)
    return F.when(cell["status"] == MISSING, MISSING).when((e != "") & ~found, UNVERIFIED).when(known, cell["status"]).otherwise(UNVERIFIED)


def isolate_json(c: Column) -> Column:
    """The outermost object or array of a reply."""
    obj, arr = F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    first_arr = (F.locate("[", c) > 0) & ((F.locate("{", c) == 0) | (F.locate("[", c) < F.locate("{", c)))
    return F.nullif(F.when(first_arr, arr).otherwise(obj), F.lit(""))


# What a reply may say of a deadline, and the shapes of tax identifiers.
KINDS = ["DEADLINE", "RENEWAL", "ACTION"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
RECURRENCES = {"WEEKLY": "WEEKLY", "MONTHLY": "MONTHLY", "QUARTERLY": "QUARTERLY", "YEARLY": "YEARLY", "NONE": "NONE", "ANNUAL": "YEARLY", "ANNUALLY": "YEARLY", "DAILY": "WEEKLY"}
GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]"
PAN = r"[A-Z]{5}[0-9]{4}[A-Z]"
# Fixed values end.


def tax_ids(c: Column) -> Column:
    """struct(gstin, pan) of the first GSTIN of a text, which holds a PAN, else of the first PAN alone; null without either."""
    up = F.upper(c)
    gstin = F.regexp_extract(up, rf"\b({GSTIN})\b", 1)
    pan = F.when(gstin != "", F.substr(gstin, F.lit(3), F.lit(10))).otherwise(F.regexp_extract(up, rf"\b({PAN})\b", 1))
    return F.when(pan != "", F.struct(F.nullif(gstin, F.lit("")).alias("gstin"), pan.alias("pan")))


def new_identities(files: DataFrame, known: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, gstin, pan) of files without a stored identity whose text has one."""
    t = files.join(known.select(key).distinct(), key, "left_anti").withColumn("__ids", tax_ids(F.col(text_col)))
    return t.filter("__ids is not null").select(key, "__ids.gstin", "__ids.pan")


def valid_id(c: Column, shape: str) -> Column:
    """The identifier in capitals without blanks, if that is its whole shape; else null."""
    u = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.when(u.rlike(f"^(?:{shape})$"), u)


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def parse_facts(replies: DataFrame, reply_col: str) -> DataFrame:
    """A row for each fact of a reply's array, after the other columns; replies that aren't such an array have none.

    Amounts are numbers, cut to whole units, or the first amount of a text.
    """
    kind = "array<struct<subject:string,key:string,label:string,value:string,balance:string,status:string,date:string,note:string>>"
    arr = F.regexp_extract(F.coalesce(F.col(reply_col), F.lit("")), r"(?s)(\[.*\])", 1)
    rest = [c for c in replies.columns if c != reply_col]
    f = replies.select(*rest, F.explode(F.from_json(arr, kind)).alias("f")).filter("f is not null")
    text = {c: _trimmed(F.col(f"f.{c}")) for c in ("subject", "key", "label", "status", "date", "note")}
    number = lambda c: F.when(F.col(c).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col(c).try_cast("decimal(38,6)").cast("long")).otherwise(M.prose_amount(F.col(c)))
    some = (text["subject"] != "") | (text["key"] != "") | (text["label"] != "") | F.col("f.value").isNotNull()
    return f.filter(some).select(*rest, *(text[c].alias(c) for c in ("subject", "key", "label")), number("f.value").alias("value"), number("f.balance").alias("balance"), *(text[c].alias(c) for c in ("status", "date", "note")))


def _one_of(c: Column, words: dict[str, str], otherwise: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(c))), F.lit(otherwise))


def parse_deadlines(replies: DataFrame, reply_col: str) -> DataFrame:
    """A row for each dated item of a reply (an array, or an object's array "deadlines"), after the other columns."""
    item = "struct<doc:string,docId:string,title:string,description:string,date:string,kind:string,confidence:string,recurring:string>"
    json = isolate_json(F.col(reply_col))
    rest = [c for c in replies.columns if c != reply_col]
    arr = F.when(F.startswith(json, F.lit("[")), F.from_json(json, f"array<{item}>")).otherwise(F.from_json(json, f"struct<deadlines:array<{item}>>")["deadlines"])
    d = replies.select(*rest, F.explode(arr).alias("d")).filter(D.is_iso(F.trim("d.date")))
    title = F.trim("d.title")
    return d.select(
        *rest, F.coalesce(F.coalesce("d.doc", "d.docId").try_cast("int"), F.lit(0)).alias("doc"), F.when(title.isNull() | (title == ""), "Deadline").otherwise(title).alias("title"), _trimmed(F.col("d.description")).alias("description"), F.trim("d.date").alias("date"),
        _one_of(F.col("d.kind"), {k: k for k in KINDS}, "ACTION").alias("kind"), _one_of(F.col("d.confidence"), {k: k for k in CONFIDENCES}, "MEDIUM").alias("confidence"), _one_of(F.col("d.recurring"), RECURRENCES, "NONE").alias("recurring"),
    )


def parse_documents(replies: DataFrame, reply_col: str) -> DataFrame:
    """A row for each document of a reply's "documents" that has a series with its period, or an owner."""
    item = "struct<doc:string,docId:string,series:string,period:string,issuer:string,entity:string,gstin:string,pan:string>"
    rest = [c for c in replies.columns if c != reply_col]
    d = replies.select(*rest, F.explode(F.from_json(isolate_json(F.col(reply_col)), f"struct<documents:array<{item}>>")["documents"]).alias("d"))
    some = lambda c: F.when(F.lower(F.trim(f"d.{c}")).isin("", "null", "none", "n/a"), None).otherwise(F.trim(f"d.{c}"))
    d = d.select(*rest, F.coalesce(F.coalesce("d.doc", "d.docId").try_cast("int"), F.lit(0)).alias("doc"), *(some(c).alias(c) for c in ("series", "period", "issuer", "entity")), valid_id(some("gstin"), GSTIN).alias("gstin"), valid_id(some("pan"), PAN).alias("pan"))
    periodic = F.col("series").isNotNull() & F.col("period").isNotNull()
    d = d.withColumn("series", F.when(periodic, F.col("series"))).withColumn("period", F.when(periodic, F.col("period")))
    return d.filter((F.col("doc") > 0) & F.coalesce("series", "entity", "gstin", "pan").isNotNull())


def complete(docs: DataFrame, schema: DataFrame, cells: DataFrame) -> DataFrame:
    """A cell for every document and field of the schema (a short list): MISSING where none came."""
    return docs.select("doc_id").crossJoin(F.broadcast(schema.select("field"))).join(cells, ["doc_id", "field"], "left").withColumn("status", F.coalesce("status", F.lit(MISSING)))


def to_csv_columns(cells: DataFrame, fields: list[str]) -> DataFrame:
    """A row per document, a column per field; ambiguous and unverified values are tagged."""
    tag = F.when(F.col("status").isin(AMBIGUOUS, UNVERIFIED), F.concat(F.lit("["), "status", F.lit("] "), F.coalesce("value", F.lit("")))).when(F.col("status") == MISSING, "").otherwise(F.col("value"))
    return cells.withColumn("cell", T.guard_formula(tag)).groupBy("doc_id").pivot("field", fields).agg(F.first("cell"))
