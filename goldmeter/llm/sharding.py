"""Sharding by fixed virtual slots: records hash into thousands of slots; a versioned slot-to-shard map says where each slot lives.

A rebalance edits the map, never the hash, so only rows of edited slots move. Everything is DataFrame functions; the map has
`slots` rows, a documented constant, and is the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
PARTS = 8


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; a null key has a slot like any other value."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slot v lives in shard v mod `shards`."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version of the map with one shard more: every shard hands its last slots over to the new one, none moves elsewhere."""
    by_shard = Window.partitionBy("shard").orderBy(F.col("virtual_slot").desc())
    given = F.row_number().over(by_shard) <= F.floor(F.count(F.lit(1)).over(Window.partitionBy("shard")) / (shards + 1))
    return slot_map.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(given, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Store one version of the map in its own folder and give it back as read from there; at most one row per slot."""
    spark = slot_map.sparkSession
    version = int(slot_map.agg(F.max("version")).first()[0])
    slot_map.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version-{version:06d}")
    return read_map(spark, folder, version)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest if none is named."""
    rows = spark.read.parquet(f"{folder}/version-{'*' if version is None else format(version, '06d')}")
    newest = F.max("version").over(Window.partitionBy("virtual_slot"))
    return rows.withColumn("_newest", newest).filter("version = _newest").drop("_newest")


def slot_bytes(sized: DataFrame, size: str = "size") -> DataFrame:
    """Rows and bytes of every slot that has rows; partial sums are built before the shuffle."""
    return sized.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def rebalance(slot_map: DataFrame, loads: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Next version of the map: slots leave shards above the mean byte load until each is at most `tolerance` above it.

    In a shard, slots are kept in order of bytes while their running sum stays below the target; the rest go, heaviest first,
    to the free room of the light shards in order (both sides are intervals on one line of bytes). Slots are never split, so a
    slot heavier than the target stays alone. Shards without any slot in the map cannot receive. All frames here have at most
    one row per slot.
    """
    m = slot_map.join(loads.select("virtual_slot", "bytes"), "virtual_slot", "left").na.fill(0, ["bytes"])
    mean = m.agg((F.sum("bytes") / F.countDistinct("shard")).alias("mean"))
    m = m.crossJoin(F.broadcast(mean))
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "virtual_slot"))
    m = m.withColumn("run", run).withColumn("first", F.row_number().over(Window.partitionBy("shard").orderBy("bytes", "virtual_slot")) == 1)
    m = m.withColumn("stays", F.col("first") | (F.col("run") <= F.col("mean") * (1 + tolerance)))
    room = m.groupBy("shard").agg(F.greatest(F.first("mean") - F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)), F.lit(0.0)).alias("room"))
    room = room.withColumn("room_to", F.sum("room").over(Window.orderBy("shard"))).withColumn("room_from", F.col("room_to") - F.col("room")).filter("room > 0")
    leaving = m.filter(~F.col("stays")).withColumn("at", F.sum("bytes").over(Window.orderBy(F.col("bytes").desc(), "virtual_slot")) - F.col("bytes"))
    moved = leaving.join(room.select(F.col("shard").alias("target"), "room_from", "room_to"), (F.col("at") >= F.col("room_from")) & (F.col("at") < F.col("room_to")), "left").select("virtual_slot", "target")
    return m.join(moved, "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("target", "shard").cast("int").alias("shard"))


def assign(docs: DataFrame, slot_map: DataFrame, grown_map: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (position in the shard, gapless from 0), grown_shard.

    Size is the text's UTF-8 bytes (null text: none) plus 1. A row's position is its number inside a part of its virtual slot
    plus the rows of all earlier parts of the shard, so no shard is sorted as a whole; parts also split a key that repeats with
    many texts. Repeated rows get positions of their own; ties have no say in the shard. An empty table gives no rows; only
    doc_id and text are read.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id")).alias("virtual_slot"))
    rows = rows.withColumn("part", F.pmod(F.col("text_crc32"), F.lit(PARTS)).cast("int"))
    shards = slot_map.select("virtual_slot", "shard")
    if grown_map is not None:
        shards = shards.join(grown_map.select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot")
    else:
        shards = shards.withColumn("grown_shard", F.lit(None).cast("int"))
    counts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shards), "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("n")
    places = counts.select("virtual_slot", "part", "shard", "grown_shard", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("own", own).join(F.broadcast(places), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")
