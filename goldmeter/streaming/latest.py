"""Latest row per key of a stream, with the keyed state in Spark's state store.

A micro-batch looks up only the keys it holds, and only rows that replace a key's latest one go out (update mode), as a change
set named by the batch. A replayed batch writes the same change set again. A late row, of a smaller order than the stored one,
changes nothing; of equal orders the row of larger hash stays, in whatever batch it comes. The table is the newest change of
every key on top of the newest base; `fold` writes a new base from time to time and then drops what it holds.

State: one row per key, split by key over the state store's partitions. Choose a store that keeps it on disk for many keys
(`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.operators.selection import latest_rows


def latest_of(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and the other columns of each key's row of largest order, for streams and tables. Rows with a null order don't count."""
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.filter(F.col(order).isNotNull()).withColumn("_r", F.struct(*rest))
    return rows.groupBy(*keys).agg(F.max_by("_r", F.struct(F.col(order), F.xxhash64("_r"))).alias("_r")).select(*keys, "_r.*")


def _versions(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Complete change sets or bases of a table by version."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return {}
    found = {int(x.getPath().getName()): x.getPath().toString() for x in store.listStatus(place)}
    return {v: p for v, p in found.items() if store.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))}


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Version of the newest base (-1: none), and the base and the change sets after it."""
    bases, changes = _versions(spark, path, "base"), _versions(spark, path, "changes")
    base = max(bases, default=-1)
    return base, [bases[v] for v in bases if v == base] + [p for v, p in sorted(changes.items()) if v > base]


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The table's rows; None before the first batch."""
    _, parts = _parts(spark, path)
    if not parts:
        return None
    return latest_rows(spark.read.parquet(*parts), keys, "_version").drop("_version")


def fold(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Write base and change sets as one new base and delete them; returns how many it took in. No reader should be at work."""
    base, parts = _parts(spark, path)
    newest = max(_versions(spark, path, "changes"), default=-1)
    if newest <= base:
        return 0
    latest_rows(spark.read.parquet(*parts), keys, "_version").write.mode("overwrite").parquet(f"{path}/base/{newest}")
    jvm = spark.sparkContext._jvm
    old = [p for kind, most in (("changes", newest), ("base", newest - 1)) for v, p in _versions(spark, path, kind).items() if v <= most]
    for p in old:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(parts)


def run_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Take in all rows that are there now and stop; call again with the same checkpoint for later ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/{batch_id}")

    query = latest_of(stream, keys, order).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
