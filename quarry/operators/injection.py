"""Files that a question needs although search missed them: by kind, by entity, ledgers.

A pool row is (query_id, file), what a query's search found; candidate files are
(file, file_name, size) and optionally doc_type and entity. Each operator returns the
files to add to each query; the caller appends their leading chunks (``lead_chunks``).
The bounds are those of a prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.retrieval import first_chunks
from quarry.plans.workspace import Workspace, broadcast_if_small

# Words of a question that name a kind of document.
KIND_WORDS = {
    "notice": "Notice",
    "intimation": "Notice",
    "invoice": "Invoice",
    "bill": "Bill",
    "contract": "Contract",
    "agreement": "Contract",
    "statement": "Bank statement",
    "receipt": "Receipt",
    "resume": "Resume",
    "payslip": "Salary slip",
}
# Fixed values end.
KIND_FILES, ENTITY_FILES, LEDGER_FILES, LEAD_CHUNKS = 8, 6, 3, 2
#: Stems of questions whose entities one task looks at.
ASKED_PART = 1000


def stemmed(c: Column) -> Column:
    return T.stems(T.significant_tokens(c))


def name_stems(name: Column) -> Column:
    """Stems of a file name; camel case is split before the case is lost."""
    return stemmed(T.split_camel(F.coalesce(name, F.lit(""))))


def kinds(stems: Column) -> Column:
    """Kinds of document that the stems name."""
    words = F.create_map(*(F.lit(x) for kv in KIND_WORDS.items() for x in kv))
    return F.array_distinct(F.filter(F.transform(stems, lambda t: F.try_element_at(words, t)), lambda k: k.isNotNull()))


def _missing(found: DataFrame, pool: DataFrame, file_col: str) -> DataFrame:
    return found.join(pool.select("query_id", file_col).distinct(), ["query_id", file_col], "left_anti")


def _order(file_col: str) -> tuple[Column, ...]:
    return F.desc("size"), F.col("file_name"), F.col(file_col)


def _spare(pool: DataFrame, most: int) -> int:
    """How many of the largest files do for every query: none has more in its pool than this, less ``most``."""
    n = pool.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]  # a pool is a search's top k
    return most + (n or 0)


def _largest(files: DataFrame, by: list[str], n: int, file_col: str, salts: int = 64) -> DataFrame:
    """The n largest files of each group; salted parts are ranked first, so that a group with most of all files is no task's sort."""
    order = _order(file_col)
    part = F.pmod(F.xxhash64(file_col), F.lit(salts))
    some = files.withColumn("salt", part).withColumn("r", F.row_number().over(W.partitionBy(*by, "salt").orderBy(*order))).filter(F.col("r") <= n)
    return some.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= n).drop("r", "salt")


def _top(found: DataFrame, n: int, file_col: str) -> DataFrame:
    """Each query's n largest, with their place from 1; a query comes with few more than n."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*_order(file_col))).cast("long")
    return found.withColumn("place", place).filter(F.col("place") <= n)


def by_kind(pool: DataFrame, files: DataFrame, questions: DataFrame, file_col: str, most: int = KIND_FILES) -> DataFrame:
    """For each question (query_id, question) the largest files of the kinds that it names, by type or by name, without templates and those in its pool.

    Which files are the largest of a kind doesn't depend on the question: so many are kept of each kind that any pool
    leaves enough, and only these meet the questions.
    """
    own = F.array_union(kinds(name_stems(F.col("file_name"))), F.array_compact(F.array("doc_type")))
    f = files.filter(~F.col("file_name").rlike(T.TEMPLATE_NAME)).select(file_col, "file_name", "size", F.explode(own).alias("kind"))
    best = _largest(f.filter(F.col("kind").isin(sorted(set(KIND_WORDS.values())))), ["kind"], _spare(pool, most), file_col)
    asked = questions.select("query_id", F.explode(kinds(stemmed(F.coalesce("question", F.lit(""))))).alias("kind"))
    found = best.join(asked, "kind").select("query_id", file_col, "file_name", "size").distinct()
    return _top(_missing(found, pool, file_col), most, file_col)


def by_entity(pool: DataFrame, files: DataFrame, questions: DataFrame, file_col: str, most: int = ENTITY_FILES) -> DataFrame:
    """For questions about several entities: the largest file of each entity that shares a stem and isn't covered by the pool.

    A pool hides or covers no more entities than it has files. So of each stem the ``most`` entities with the largest
    files do, and as many more as a pool has files; of each of these as many files as a pool may hide, and one. Only
    those meet the questions, however many files and entities there are.
    """
    ws = Workspace(files.sparkSession, "by-entity")
    entity = F.lower(F.coalesce("entity", "file_name"))
    stems = F.array_union(name_stems(F.col("file_name")), stemmed(F.coalesce("entity", F.lit(""))))
    pool = broadcast_if_small(ws.stage(pool.select("query_id", file_col).distinct(), "pool"))
    # A pool's files with their entities; files that share an id count each.
    hidden = ws.stage(files.select(file_col, F.lower("entity").alias("covers")).join(pool, file_col), "hidden")
    covered = hidden.filter("covers is not null").select("query_id", F.col("covers").alias("entity_key")).distinct()
    spare = hidden.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # a pool is a search's top k
    asked = questions.filter(F.col("question").rlike(T.ENTITY_BREADTH)).select("query_id", F.explode(stemmed(F.col("question"))).alias("stem"))
    asked = ws.stage(asked, "asked")
    wanted = broadcast_if_small(ws.stage(asked.select("stem").distinct(), "stems"))
    f = files.filter(~F.coalesce(F.col("file_name").rlike(T.TEMPLATE_NAME), F.lit(False))).select(file_col, "file_name", "size", entity.alias("entity_key"), F.explode(stems).alias("stem")).join(wanted, "stem")
    f = ws.stage(f, "stemmed")
    largest = F.min_by(F.struct(file_col, "file_name", "size"), F.struct(F.negative("size"), "file_name", file_col))
    heads = f.groupBy("stem", "entity_key").agg(largest.alias("r")).select("stem", "entity_key", "r.*")
    kept = ws.stage(_largest(heads, ["stem"], most + spare, file_col).select("stem", "entity_key"), "entities")
    best = _largest(f.join(broadcast_if_small(kept), ["stem", "entity_key"], "left_semi"), ["stem", "entity_key"], spare + 1, file_col)
    best = ws.stage(best, "best")
    # A task has the questions of so many stems from here to their places, however few files they were staged in.
    asked = asked.repartition(max(1, -(-asked.count() // ASKED_PART)), "query_id")
    found = broadcast_if_small(best).join(asked, "stem").select("query_id", file_col, "file_name", "size", "entity_key").distinct()
    open_ = _missing(found.join(broadcast_if_small(covered), ["query_id", "entity_key"], "left_anti"), pool, file_col)
    first = open_.groupBy("query_id", "entity_key").agg(largest.alias("r"))
    return _top(first.select("query_id", "r.*"), most, file_col)


def ledgers(pool: DataFrame, files: DataFrame, questions: DataFrame, file_col: str, most: int = LEDGER_FILES) -> DataFrame:
    """For questions about what is paid or owed: the largest files with the name of a ledger."""
    asked = questions.filter(F.col("question").rlike(T.PAYMENT_STATUS)).select("query_id", F.lit(0).alias("one"))
    best = files.filter(F.col("file_name").rlike(T.LEDGER_NAME)).select(file_col, "file_name", "size", F.lit(0).alias("one"))
    best = _largest(best, ["one"], _spare(pool, most), file_col)  # as many as a pool and its additions hold
    return _top(_missing(asked.join(F.broadcast(best), "one").drop("one"), pool, file_col), most, file_col)


def lead_chunks(chosen: DataFrame, chunks: DataFrame, file_col: str, order_col: str, n: int = LEAD_CHUNKS) -> DataFrame:
    """The first chunks of the files chosen for each query, with their place."""
    ws = Workspace(chosen.sparkSession, "lead-chunks")
    some = ws.stage(chosen.select("query_id", file_col), "chosen")
    own = chunks.join(broadcast_if_small(some.select(file_col).distinct()), file_col, "left_semi")
    first = first_chunks(own, file_col, order_col, n).withColumn("place", F.col("chunk_index") + 1).drop("chunk_index")
    return first.join(some, file_col)
