"""Containment joins: which texts stand inside which others of the same key, by their rarest character stretch.

A text that lies inside another shares all its stretches with it. So every needle is represented by one stretch of 8 characters
(4, 2 or 1 if it is shorter), the one that fewest haystacks of its key have; it meets only those, and containment is the
residual. Nothing is joined on the key alone, so a document with many texts is dealt out by stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions.text import let
from goldmeter.session import ensure_checkpoint_dir

SIZES = (8, 4, 2, 1)


def _stretches(text: Column, size: Column | int) -> Column:
    """Distinct stretches of `size` characters."""
    def cut(t):
        last = F.length(t) - size + 1
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.substring(t, i, size)))

    return let(text, cut)


def _size(text: Column) -> Column:
    out = F.lit(SIZES[-1])
    for s in sorted(SIZES[:-1]):
        out = F.when(F.length(text) >= s, s).otherwise(out)
    return out


def containment_pairs(needles: DataFrame, haystacks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, needle, haystack: all pairs in which the haystack contains the needle, each once.

    `needles` has keys and needle, `haystacks` has keys and haystack. Empty and null texts and null keys take no part. Texts are
    carried by hash until the residual test, which compares the texts themselves.
    """
    own = needles.filter(F.col("needle") != "").select(*keys, "needle").distinct()
    other = haystacks.filter(F.col("haystack") != "").select(*keys, "haystack").distinct().withColumn("_h", F.xxhash64("haystack"))
    sizes = F.array(*[F.lit(s) for s in SIZES])
    parts = other.select(*keys, "_h", F.explode(F.flatten(F.transform(sizes, lambda s: _stretches(F.col("haystack"), s)))).alias("_part"))
    parts = parts.join(own.select(*keys, F.explode(_stretches(F.col("needle"), _size(F.col("needle")))).alias("_part")).distinct(), [*keys, "_part"], "left_semi")
    counts = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    looked = own.select(*keys, "needle", F.explode(_stretches(F.col("needle"), _size(F.col("needle")))).alias("_part")).join(counts, [*keys, "_part"], "left")
    rare = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_part").alias("part"))).alias("_rare")
    chosen = looked.groupBy(*keys, "needle").agg(rare).filter(F.col("_rare.n") > 0).select(*keys, "needle", F.col("_rare.part").alias("_part"))
    near = chosen.join(parts, [*keys, "_part"]).select(*keys, "needle", "_h")
    return near.join(other, [*keys, "_h"]).filter(F.contains("haystack", "needle")).select(*keys, "needle", "haystack")


def contained_either_way(texts: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text of the texts that contain one of `others` (keys, other) of their key or stand in one; an empty `other` stands in
    every text, an empty text in none that counts. Both sides' distinct texts are stored once, since each is read several times."""
    ensure_checkpoint_dir(texts.sparkSession)
    own = texts.filter(F.col("text") != "").select(*keys, "text").distinct().checkpoint()
    if own.isEmpty():
        return own
    others = others.select(*keys, "other").distinct().checkpoint()
    inside = containment_pairs(own.withColumnRenamed("text", "needle"), others.withColumnRenamed("other", "haystack"), keys).select(*keys, F.col("needle").alias("text"))
    around = containment_pairs(others.withColumnRenamed("other", "needle"), own.withColumnRenamed("text", "haystack"), keys).select(*keys, F.col("haystack").alias("text"))
    empty = own.join(others.filter(F.col("other") == "").select(*keys).distinct(), keys, "left_semi")
    return inside.unionByName(around).unionByName(empty).distinct()
