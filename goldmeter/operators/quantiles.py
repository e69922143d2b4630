"""Percentiles of groups of any size: mergeable sketches, or exact values by refinement. No task ever holds a group.

A KLL sketch of a group has a size that depends on `k` only and is merged from partial ones. `sketched` reads percentiles from
it: the rank of an answer is off by at most `rank_error(k)` of the group with 99 % probability. `exact` narrows each wanted rank
down instead: two values around it, taken from the sketch, part the values that are still possible into five classes (below,
the first, between, the second, above); counts tell in which the rank lies, and that class is sketched for the next pass.
A class of equal values is the answer, one of at most `limit` values is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.session import ensure_checkpoint_dir


#: A class is parted at multiples of 1 / GRID of it.
GRID = 200


def rank_error(k: int) -> float:
    """Share of a group by which a sketched rank is off at most, with 99 % probability (fixed values of the sketch's makers)."""
    return 2.296 / k**0.9021


def _keyed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    rows = df.select(F.struct(*by).alias("_key") if by else F.struct(F.lit(0)).alias("_key"), F.col(value).cast("double").alias("_v"))
    return rows.filter(F.col("_v").isNotNull())


def _unkeyed(df: DataFrame, by: list[str]) -> list[Column]:
    return [F.col("_key")[c].alias(c) for c in by]


def sketched(df: DataFrame, by: list[str], value: str, points: dict[str, float], k: int = 2000) -> DataFrame:
    """by..., one column per point: values of the group whose rank is near the wanted one (see `rank_error`)."""
    made = _keyed(df, by, value).groupBy("_key").agg(F.kll_sketch_agg_double("_v", k).alias("_s"))
    return made.select(*_unkeyed(made, by), *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(n) for n, p in points.items()])


def _narrowed(rows: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """Each target's class, with its bounds, its count and how many values stand before it."""
    place, error = (F.col("rank") - F.col("below") + 0.5) / F.col("inside"), min(2 * rank_error(k), 0.05)  # a rank outside costs a pass, no more
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    around = {"a": F.greatest(F.floor((place - error) * GRID), F.lit(0)), "b": F.least(F.ceil((place + error) * GRID), F.lit(GRID))}
    bounds = wide.withColumn("grid", grid).select("_key", "rank", "below", "lo", "hi", *[F.get("grid", i.cast("int")).alias(n) for n, i in around.items()])
    near = rows.join(bounds, "_key").filter(F.col("_v").between(F.col("lo"), F.col("hi")))
    part = F.when(F.col("_v") < F.col("a"), 0).when(F.col("_v") == F.col("a"), 1).when(F.col("_v") < F.col("b"), 2).when(F.col("_v") == F.col("b"), 3).otherwise(4)
    counts = near.groupBy("_key", "rank", "below", part.alias("part")).agg(F.count(F.lit(1)).alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.kll_sketch_agg_double("_v", k).alias("sketch"))
    before = F.coalesce(F.sum("inside").over(W.partitionBy("_key", "rank").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("below", F.col("below") + before)
    return placed.filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside"))).drop("part")


def exact(df: DataFrame, by: list[str], value: str, points: dict[str, float], limit: int = 10_000, k: int = 1000) -> DataFrame:
    """by..., one column per point: linear-interpolated percentiles. Null values don't count; a group of nulls only has nulls."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = _keyed(df, by, value)
    facts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.kll_sketch_agg_double("_v", k).alias("sketch"))
    position = {n: (F.col("n") - 1) * F.lit(float(p)) for n, p in points.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in position.values() for f in (F.floor, F.ceil)]))
    facts = facts.checkpoint()
    open_ = facts.select("_key", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "lo", "hi", "sketch")
    found: list[DataFrame] = []
    while True:
        found.append(open_.filter("lo = hi").select("_key", "rank", F.col("lo").alias("value")))
        few = open_.filter((F.col("lo") < F.col("hi")) & (F.col("inside") <= limit)).select("_key", "rank", "below", "lo", "hi")
        sorted_ = rows.join(few, "_key").filter(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy("_key", "rank", "below").agg(F.sort_array(F.collect_list("_v")).alias("all"))
        found.append(sorted_.select("_key", "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("value")))
        wide = open_.filter((F.col("lo") < F.col("hi")) & (F.col("inside") > limit))
        if wide.isEmpty():
            break
        open_ = _narrowed(rows, wide, k).checkpoint()
    values = reduce(DataFrame.unionByName, found).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = facts.select("_key", "n").join(values, "_key")

    def between(pos: Column) -> Column:
        low, high = F.floor(pos), F.ceil(pos)
        a, b = F.try_element_at("at", low.cast("long")), F.try_element_at("at", high.cast("long"))
        return F.when(low == high, a).otherwise((high - pos) * a + (pos - low) * b)

    made = out.select(*_unkeyed(out, by), *[between(x).alias(n) for n, x in position.items()])
    groups = df.select(*by).distinct() if by else None
    if groups is None:
        return made
    return groups.join(made.select(*[F.col(c).alias(f"_{c}") for c in by], *points), reduce(lambda x, y: x & y, [groups[c].eqNullSafe(F.col(f"_{c}")) for c in by]), "left").select(*by, *points)
