"""Documents put to a model in batches, until each has a reply: halving, caching and a daily budget.

A batch holds up to ``most_docs`` documents and ``most_chars`` characters. The documents of a batch whose reply can't be
read, and those that a reply passes over, are asked again in batches of half the size, at last one by one; what can't be
read even so is given up for the day. Replies are kept by a hash of the content, so neither a copy nor a restart asks for
one again, and what was tried is kept by day, so a restart goes on where it stopped. Batches run in waves, each written
before the next begins: a failure loses the replies of one wave at most. The calls of a day never exceed its budget;
documents for which none is left wait.

Tables below the folder: ``replies`` (hash, reply) and ``tried`` (hash, day, size, call).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.workspace import Workspace, broadcast_if_small

MOST_DOCS, MOST_CHARS, CALLS = 10, 280_000, 25
#: Batches of a wave, and documents that one task packs into batches.
WAVE, PACKED = 64, 2000
#: Replies to the texts of a batch (None: passed over), or None if the reply can't be read; an exception counts as that.
Ask = Callable[[list[str]], list[str | None] | None]

REPLIES, TRIED = "hash string, reply string", "hash string, day string, size int, call string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def pack(docs: DataFrame, most_chars: int, parts: int) -> DataFrame:
    """(hash, size, batch): documents (hash, size, chars) of one batch size in batches of so many; a fold over the hashes of a part."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("hash")
        number, used, count, out = 0, 0, 0, []
        for size, n in zip(f["size"], f["chars"]):
            if count and (used + n > most_chars or count >= size):
                number, used, count = number + 1, 0, 0
            used, count = used + n, count + 1
            out.append(f"{size}-{f['part'].iloc[0]}-{number}")
        return pd.DataFrame({"hash": f["hash"], "size": f["size"], "batch": out})

    d = docs.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int"))
    return d.groupBy("size", "part").applyInPandas(run, "hash string, size int, batch string")


def _asked(ask: Ask) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for batch, size, hashes, texts in zip(f["batch"], f["size"], f["hashes"], f["texts"]):
                try:
                    got = ask(list(texts))
                except Exception:  # noqa: BLE001  a call that fails is a reply that can't be read
                    got = None
                got = got if got is not None and len(got) == len(texts) else [None] * len(texts)
                rows += [(h, r, size, batch) for h, r in zip(hashes, got)]
            # One frame for all batches of a frame: a frame of its own would cost each batch more than its texts.
            yield pd.DataFrame(rows, columns=["hash", "reply", "size", "batch"])

    return run


def answer(docs: DataFrame, ask: Ask, folder: str, day: str, calls: int = CALLS, most_docs: int = MOST_DOCS, most_chars: int = MOST_CHARS, wave: int = WAVE) -> DataFrame:
    """The documents (hash, text, ...) with ``reply`` and ``state``: answered, unreadable (today) or waiting."""
    spark = docs.sparkSession
    ws = Workspace(spark, "model-batches")
    texts = ws.stage(docs.filter("hash is not null").groupBy("hash").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")), "texts")
    sizes = texts.select("hash", F.length("text").cast("long").alias("chars"))
    while True:
        tried = _table(spark, f"{folder}/tried", TRIED).filter(F.col("day") == day)
        left = calls - tried.select("call").distinct().count()
        if left <= 0:
            break
        last = tried.groupBy("hash").agg(F.min("size").alias("last"))
        open_ = sizes.join(_table(spark, f"{folder}/replies", REPLIES).select("hash"), "hash", "left_anti").join(last, "hash", "left")
        open_ = open_.withColumn("size", F.coalesce(F.floor(F.col("last") / 2), F.lit(most_docs)).cast("int")).filter("size >= 1").select("hash", "size", "chars")
        open_ = ws.stage(open_, "open")
        n = open_.count()
        if not n:
            break
        packed = ws.stage(pack(open_, most_chars, -(-n // PACKED)), "packed")
        now = packed.select("batch", "size").distinct().orderBy(F.desc("size"), "batch").limit(min(left, wave))  # a wave's rows
        mine = broadcast_if_small(ws.stage(packed.join(F.broadcast(now.select("batch")), "batch"), "wave"))
        # Dealt by batch before they are grouped, so that texts are shuffled once.
        groups = texts.join(mine, "hash").repartition("batch").groupBy("batch", "size").agg(F.array_sort(F.collect_list(F.struct("hash", "text"))).alias("d"))  # most_docs documents at most
        groups = groups.select("batch", "size", F.col("d.hash").alias("hashes"), F.col("d.text").alias("texts"))
        got = ws.stage(groups.mapInPandas(_asked(ask), "hash string, reply string, size int, batch string"), "got")
        # Replies first: a stop between the two writes counts a call too few, but asks for no reply again.
        got.filter("reply is not null").select("hash", "reply").write.mode("append").parquet(f"{folder}/replies")
        got.select("hash", F.lit(day).alias("day"), "size", F.concat_ws("/", F.lit(ws.root.rpartition("-")[2]), F.lit(str(ws._n)), "batch").alias("call")).write.mode("append").parquet(f"{folder}/tried")
        for t in (open_, packed, got):
            ws.drop(t)
    replies = _table(spark, f"{folder}/replies", REPLIES).groupBy("hash").agg(F.min("reply").alias("reply"))
    given_up = _table(spark, f"{folder}/tried", TRIED).filter((F.col("day") == day) & (F.col("size") == 1)).select("hash", F.lit(True).alias("given_up")).distinct()
    out = docs.drop("reply", "state").join(replies, "hash", "left").join(given_up, "hash", "left")
    return out.withColumn("state", F.when(F.col("reply").isNotNull(), "answered").when(F.col("given_up"), "unreadable").otherwise("waiting")).drop("given_up")
