"""Sharding by fixed virtual slots, with a versioned slot-to-shard map.

A record's doc_id and its text's checksum decide its virtual slot (one of
``SLOTS``). Records that are alike in both and together hold more than a quarter
of a slot's even share of all bytes (at most 4 * ``SLOTS`` such keys can) are
dealt over all slots, so that no row repeated very often makes a slot that no map
can balance. Bytes and rows are summed per slot, and a map from slots to shards is made by giving the
slots, largest first, to the shard with the least bytes. The map has one row
per slot and is stored with a version; rebalancing edits it, moving only the
slots that must move. All of it is DataFrame functions: the map is folded by
``aggregate`` over one array of ``SLOTS`` entries, a fixed size.

The law is ``bytes``: shard sizes are near equal. A record's place within its
shard is ``slot``: its virtual slot's offset plus its rank in that virtual
slot, so ranks are taken in thousands of groups, never over a whole shard.

Defined cases: null text has size 8 and the checksum of no bytes; a null
doc_id is hashed as a value of its own, so rows without ids spread by their
texts; repeated rows are separate records, of the same virtual slot but for the
heavy ones; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.plans.workspace import Workspace

SLOTS = 4096
SHARDS = 24


def _key(id_col: str | Column, crc: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    crc = F.col(crc) if isinstance(crc, str) else crc
    return F.when(c.isNull(), F.xxhash64(F.lit("no id"), crc)).otherwise(F.xxhash64(c, crc))


def virtual_slot(id_col: str | Column, crc: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(_key(id_col, crc), F.lit(slots)).cast("int")


def with_slots(records: DataFrame, ws: Workspace, slots: int = SLOTS) -> DataFrame:
    """Records (doc_id, size, text_crc32) with their vslot, staged: heavy keys are told by their bytes and dealt out."""
    keyed = ws.stage(records.withColumn("key", _key("doc_id", "text_crc32")).withColumn("nth", F.monotonically_increasing_id()), "keyed")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    heavy = keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > total / (4 * slots)) & (F.col("n") > 1))
    heavy = F.broadcast(heavy.select("key", F.lit(True).alias("heavy")))  # fewer than 4 * slots rows: their bytes sum up to no more than all
    dealt = F.when(F.col("heavy"), F.xxhash64("key", "nth")).otherwise(F.col("key"))
    return ws.stage(keyed.join(heavy, "key", "left").withColumn("vslot", F.pmod(dealt, F.lit(slots)).cast("int")).drop("key", "nth", "heavy"), "records")


def slot_sums(records: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of records with vslot and size."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _fold(slots: Column, shards: int, begin: Column) -> Column:
    """Entries (bytes, vslot), largest first, each given to the least loaded shard: their shards in order."""
    state = F.struct(begin.alias("load"), F.array().cast("array<int>").alias("owner"))

    def give(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == to - 1, v + x["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["owner"], F.array(to - 1)).alias("owner"))

    return F.aggregate(slots, state, give, lambda acc: acc["owner"])


def new_map(sums: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """(version, vslot, shard, bytes, rows) for every slot that holds a record."""
    order = F.sort_array(F.collect_list(F.struct("bytes", "vslot", "rows")), False)
    one = sums.agg(order.alias("s")).withColumn("owner", _fold(F.col("s"), shards, F.array_repeat(F.lit(0).cast("long"), shards)))
    flat = one.select(F.explode(F.arrays_zip("s", "owner")).alias("x"))
    return flat.select(F.lit(version).alias("version"), F.col("x.s.vslot").alias("vslot"), F.col("x.owner").alias("shard"), F.col("x.s.bytes").alias("bytes"), F.col("x.s.rows").alias("rows"))


def rebalance(old: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """The next version for new sums and a number of shards that may have changed.

    Within each surviving shard, slots stay, largest first, as long as their
    running bytes fit the new even share; the others, slots of closed shards
    and new slots are given out anew to the least loaded shard.
    """
    cur = sums.join(old.select("vslot", F.col("shard").alias("was"), "version"), "vslot", "left")
    cur = cur.withColumn("share", F.sum("bytes").over(W.partitionBy()) / shards).withColumn("now", F.max("version").over(W.partitionBy()))
    run = F.sum("bytes").over(W.partitionBy("was").orderBy(F.desc("bytes"), "vslot"))
    stays = F.coalesce((F.col("was") < shards) & (run <= F.col("share")), F.lit(False))
    cur = cur.withColumn("stays", stays)
    kept = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.filter("all", lambda x: x["stays"] & (x["was"] == k)), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    one = cur.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "rows", "stays", "was")), False).alias("all"), F.max("now").alias("now"))
    one = one.withColumn("s", F.filter("all", lambda x: ~x["stays"])).withColumn("owner", _fold(F.col("s"), shards, kept))
    moved = F.transform(F.arrays_zip("s", "owner"), lambda x: F.struct(x["s"]["vslot"].alias("vslot"), x["owner"].alias("shard"), x["s"]["bytes"].alias("bytes"), x["s"]["rows"].alias("rows")))
    still = F.transform(F.filter("all", lambda x: x["stays"]), lambda x: F.struct(x["vslot"].alias("vslot"), x["was"].alias("shard"), x["bytes"].alias("bytes"), x["rows"].alias("rows")))
    return one.select((F.coalesce("now", F.lit(0)) + 1).alias("version"), F.explode(F.concat(moved, still)).alias("x")).select("version", "x.*")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Versions are partitions of the table: an older one stays readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, by default the last."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == version)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it; the map has at most SLOTS rows, so it is broadcast."""
    offset = F.sum("rows").over(W.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    m = slot_map.select("vslot", "shard", offset.alias("begin"))
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(F.broadcast(m), "vslot").withColumn("slot", F.col("begin") + F.col("rank") - 1)


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32")
    )
    ws = Workspace(spark, "sharding")
    records = with_slots(docs, ws)
    path = ws.path("slot-map")
    save_map(new_map(slot_sums(records)), path)
    placed = place(records, load_map(spark, path))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
