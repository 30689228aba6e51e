"""The corpus pipeline: rules, classifier, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on
everything that its predecessor kept. All but the last return the columns of
documents. Stages are written as Parquet to the cluster's shared folder and
read again, so a lost executor costs one stage's tasks at most.

Defined cases: rules and near-duplicates number the rows and judge each by its
own number, so null ids, repeated ids and repeated rows are rows like others: of
equal rows one stays after near-duplicates, that of the smallest id, null ids
last. Null and empty texts fail the rules; in later stages they are unique and
stay. Further columns are dropped, whatever their names. An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, minhash, pieces, quality_rules, weak_quality
from quarry.plans.workspace import Workspace, broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shared shingles of all shingles of two documents, from which on they are near-duplicates here (op6 alone asks for more).
NEAR_PERCENT = 80


def _numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The documents with a number of their own, written so that every later reading gives the same ones."""
    return ws.stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def _without(docs: DataFrame, rejected: DataFrame, ws: Workspace) -> DataFrame:
    """The rows whose number is not among the rejected ones; numbers are few enough to broadcast, or Spark shuffles."""
    rows = ws.stage(rejected.select("row"), "rejected")
    return docs.join(broadcast_if_small(rows), "row", "left_anti").select(COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own verdict."""
    ws = Workspace(spark, "rules")
    rows = _numbered(docs, ws)
    judged = quality_rules.judge(spark, rows.select(F.col("row").alias("doc_id"), "lang", "text"))
    return _without(rows, judged.filter("not kept").select(F.col("doc_id").alias("row")), ws)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return weak_quality.classify(spark, docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest id (null ids last), and of its rows the first."""
    ws = Workspace(spark, "dedup")
    rows = _numbered(docs, ws)
    found = minhash.near_duplicates(spark, rows, id_col="row", percent=NEAR_PERCENT).select(F.col("doc_id").alias("row"), "component_id")
    placed = ws.stage(found.join(rows.select("row", "doc_id"), "row"), "placed")
    first = placed.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    # Joined by row, of which each is there once: a group of very many copies is no single task's.
    return _without(rows, placed.join(first.select("row"), "row", "left_anti"), ws)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly benchmark go."""
    found = decontaminate.match(spark, docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = decontaminate.clean(found)
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, a digest of the ids, and whether decoding them gives the text back."""
    return pieces.digest(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("SentencePiece encoding", encoding)]

#: SQL can express neither the trained classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
