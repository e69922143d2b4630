"""Incremental parse health over the append-only run log.

State is the latest row per key and nothing else. Each micro-batch reduces its own rows per
key, merges them with the stored rows of the touched hash slots and rewrites only those
slots; the parse-health report reads the stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.operators.selection import latest_rows


#: Session setting for the number of hash slots of a table; it must stay the same for the life of a table.
SLOTS_SETTING = "spark.goldmeter.runlog.slots"


def slot_count(spark: SparkSession) -> int:
    return int(spark.conf.get(SLOTS_SETTING, "64"))


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path object of a table, on whatever storage it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def merge_batch(table_path: str, keys: list[str], order: str, slots: int):
    """foreachBatch function that keeps the latest row per key in a slot-partitioned table.

    A slot is written as a new version and named in the batch's manifest before older versions are
    ignored, so a lost executor or a replayed batch leaves the table readable and unchanged.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")
        fresh = latest_rows(batch, keys, order).withColumn("slot", slot)
        stored = read_table(spark, table_path, before=batch_id)
        if stored is not None:
            touched = fresh.select("slot").distinct()
            old = stored.drop("version").join(F.broadcast(touched), "slot", "left_semi")
            fresh = latest_rows(old.unionByName(fresh), keys, order)
        fresh.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("version", "slot").parquet(table_path)

    return apply


def read_table(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """Stored rows: the newest version of every slot, below a batch id when given; None before the first batch."""
    fs, place = _folder(spark, table_path)
    if not fs.exists(place) or not any(x.getPath().getName().startswith("version=") for x in fs.listStatus(place)):
        return None
    rows = spark.read.parquet(table_path)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("slot").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["slot", "version"])


def compact(spark: SparkSession, table_path: str) -> int:
    """Delete slot versions that a newer one replaces; returns how many. Run it between batches, with no reader at work."""
    fs, place = _folder(spark, table_path)
    versions = [(int(v.getPath().getName()[8:]), v.getPath()) for v in fs.listStatus(place) if v.getPath().getName().startswith("version=")] if fs.exists(place) else []
    seen: set[str] = set()
    dropped = 0
    for _, path in sorted(versions, key=lambda x: -x[0]):
        slots = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("slot=")]
        for old in (x for x in slots if x.getName() in seen):
            fs.delete(old, True)
            dropped += 1
        seen |= {x.getName() for x in slots}
        if not fs.listStatus(path):
            fs.delete(path, True)
    return dropped


def run_stream(spark: SparkSession, source: str, schema, table_path: str, checkpoint: str, keys: list[str], order: str):
    """Process everything now in the log folder and stop; call again for later rows."""
    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.foreachBatch(merge_batch(table_path, keys, order, slot_count(spark))).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
