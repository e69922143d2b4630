"""Percentiles, bootstrap, randomisation tests, budgets, Pareto tables, composites, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.functions import vocabulary as V
from goldmeter.operators import quantiles
from goldmeter.operators.selection import hash_number

TWO32 = float(1 << 32)


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], exact: bool = True) -> DataFrame:
    """Linear-interpolated percentiles by refinement; exact=False reads values of nearly the wanted rank from sketches in one pass
    (see `quantiles.rank_error`). Neither gathers a group in one task."""
    return quantiles.exact(df, by, value, points) if exact else quantiles.sketched(df, by, value, points)


def _iterations(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def poisson_weight(h: Column) -> Column:
    """Poisson(1) count of a uniform 32-bit hash, by inversion of the cumulative probabilities."""
    # fixed values: cumulative Poisson(1) probabilities times 2^32, rounded down
    cuts = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252, 4294967292, 4294967295]
    out = F.lit(len(cuts)).cast("long")
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(h < cuts[k], F.lit(k).cast("long")).otherwise(out)
    return out


def bootstrap(doc_stats: DataFrame, by: list[str], id_column: str, iterations: int, seed: int, sums: list[str]) -> DataFrame:
    """Poisson bootstrap: weighted sums of per-document statistics per iteration.

    Every document draws a hash-derived Poisson(1) weight per iteration, so resampling needs no
    join and partial aggregation leaves `iterations` rows per group and task.
    """
    rows = doc_stats.select(*by, id_column, *sums, _iterations(iterations).alias("iteration"))
    weight = poisson_weight(hash_number(F.lit(str(seed)), F.col("iteration").cast("string"), F.col(id_column).cast("string")))
    return rows.withColumn("w", weight).filter("w > 0").groupBy(*by, "iteration").agg(
        F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])


def resample_exact(doc_stats: DataFrame, by: list[str], id_column: str, iterations: int, seed: int, sums: list[str]) -> DataFrame:
    """Exact-size bootstrap: n draws with replacement per iteration through a hashed position join.

    Positions are numbered inside 4,096 hash buckets; the buckets' sizes (at most 4,096 rows per group) give their offsets. It
    shuffles iterations x documents draws, which stream past a hash table of the documents; `bootstrap` needs no join and is the
    form for large tables.
    """
    rows = doc_stats.select(*by, id_column, *sums).withColumn("_b", F.conv(F.substring(F.md5(F.col(id_column).cast("string")), 1, 3), 16, 10).cast("int"))
    order = W.partitionBy(*by).orderBy("_b")
    running = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    sizes = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*by, "_b", (running - F.col("_n")).alias("_start"), total.alias("_all"))
    inside = F.row_number().over(W.partitionBy(*by, "_b").orderBy(id_column)) - 1
    placed = rows.withColumn("_i", inside).join(offsets, [*by, "_b"]).select(
        *by, id_column, *sums, F.col("_all").alias("_n"), (F.col("_start") + F.col("_i")).cast("int").alias("_pos"))
    # few bytes are read here but many draws made, so the number of tasks is not left to the bytes
    placed = placed.repartition(int(doc_stats.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_pos")
    draws = placed.select(*by, "_n", F.col("_pos").alias("slot"), _iterations(iterations).alias("iteration"))
    h = hash_number(F.lit(str(seed)), F.col("iteration").cast("string"), F.col("slot").cast("string"))
    draws = draws.withColumn("_pos", (h % F.col("_n")).cast("int"))
    # a draw meets the document of its position and is summed at once: only that position's documents are held, never the draws
    met = draws.select(*by, "iteration", "_pos").join(placed.drop("_n", id_column).hint("shuffle_hash"), [*by, "_pos"])
    return met.groupBy(*by, "iteration").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])


def interval_table(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Standard error (population) and 95% interval of iteration values."""
    return samples.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("iterations"), F.stddev_pop(value).alias("standard_error"),
        F.percentile(value, F.lit(0.025)).alias("ci95_low"), F.percentile(value, F.lit(0.975)).alias("ci95_high"))


def paired_differences(utilities: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """candidate minus baseline utility per (system, keys..., metric), for all other systems."""
    base = utilities.filter(F.col("system") == baseline).select(*keys, "metric", F.col("utility").alias("_b"))
    return utilities.filter(F.col("system") != baseline).join(base, [*keys, "metric"]).select(
        "system", *keys, "metric", (F.col("utility") - F.col("_b")).alias("difference"))


def sign_flip_test(differences: DataFrame, by: list[str], id_column: str, iterations: int, seed: int, scale: int = 1_000_000) -> DataFrame:
    """Two-sided paired randomisation: p = (extreme + 1) / (iterations + 1).

    Differences are summed as scaled integers, so the comparison with the observed sum does not
    depend on the order of summation.
    """
    scaled = differences.filter(F.col("difference") != 0).withColumn("_d", F.round(F.col("difference") * scale).cast("long"))
    totals = differences.groupBy(*by).agg(
        F.count(F.lit(1)).alias("paired_documents"), F.sum(F.round(F.col("difference") * scale).cast("long")).alias("_obs"))
    flips = scaled.select(*by, id_column, "_d", _iterations(iterations).alias("iteration"))
    bit = hash_number(F.lit(str(seed)), F.col("iteration").cast("string"), F.col(id_column).cast("string")) % 2
    sums = flips.groupBy(*by, "iteration").agg(F.sum(F.when(bit == 0, F.col("_d")).otherwise(-F.col("_d"))).alias("_s"))
    # iterations without any non-zero difference sum to 0 and are counted arithmetically
    counted = sums.join(totals.select(*by, "_obs"), by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_seen"), F.count_if(F.abs("_s") >= F.abs("_obs")).alias("_hit"))
    out = totals.join(counted, by, "left").na.fill(0, ["_seen", "_hit"])
    extreme = F.col("_hit") + F.when(F.col("_obs") == 0, iterations - F.col("_seen")).otherwise(0)
    return out.select(
        *by, "paired_documents", (F.col("_obs") / F.lit(float(scale)) / F.col("paired_documents")).alias("observed_mean_delta"),
        extreme.cast("long").alias("extreme"), ((extreme + 1) / F.lit(float(iterations + 1))).alias("p_value"))


def error_budget(utilities: DataFrame, facts: DataFrame) -> DataFrame:
    """Failures per (system, metric) over all expected documents, with unavailable, schema- and quote-invalid counts.

    `facts` has system, document_id, available, schema_valid, invalid_quotes for every expected document.
    """
    fails = utilities.groupBy("system", "metric").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("utility") < 1.0).alias("field_failures"))
    per_system = facts.groupBy("system").agg(
        F.count_if(~F.col("available")).alias("unavailable_outputs"),
        F.count_if(F.col("available") & ~F.coalesce("schema_valid", F.lit(False))).alias("schema_invalid_outputs"),
        F.count_if(F.col("invalid_quotes") > 0).alias("quote_invalid_outputs"))
    return fails.join(per_system, "system").withColumn("field_failure_rate", F.col("field_failures") / F.col("documents"))


def failure_pareto(errors: DataFrame, by: list[str], source: str) -> DataFrame:
    """Counts per (by..., source) with share and running share inside each `by` group."""
    counts = errors.groupBy(*by, source).agg(F.count(F.lit(1)).alias("error_count"))
    group = W.partitionBy(*by)
    order = group.orderBy(F.desc("error_count"), source).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("error_count").over(group)
    return counts.select(
        *by, source, "error_count", total.alias("group_errors"), (F.col("error_count") / total).alias("share"),
        (F.sum("error_count").over(order) / total).alias("cumulative_share"))


def weighted_composite(summaries: DataFrame, weights: dict[str, float], id_column: str = "system", out: str = "composite") -> DataFrame:
    """Weighted mean over the metrics that are present, weights renormalised."""
    pairs = [F.struct(F.col(m).cast("double").alias("v"), F.lit(w).alias("w")) for m, w in weights.items()]
    present = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())
    num = F.aggregate(present, F.lit(0.0), lambda acc, p: acc + p["v"] * p["w"])
    den = F.aggregate(present, F.lit(0.0), lambda acc, p: acc + p["w"])
    return summaries.select(id_column, F.when(den > 0, num / den).alias(out))


def with_composite_inputs(summaries: DataFrame) -> DataFrame:
    """Add the derived inputs: investigation score, and the collapsed diagnosis with its fallback.

    A collapsed accuracy of exactly 0 counts as missing and falls back to the plain accuracy.
    """
    both = F.filter(F.array("eeg_accuracy", "mri_accuracy"), lambda x: x.isNotNull())
    inv = F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both))
    dx = F.coalesce(F.nullif(F.col("epilepsy_diagnosis_accuracy_collapsed"), F.lit(0.0)), F.col("epilepsy_diagnosis_accuracy"))
    return summaries.withColumn("investigation_score", inv).withColumn("epilepsy_diagnosis", dx).withColumn(
        "epilepsy_diagnosis_accuracy_collapsed", dx)


def efficiency_adjusted(df: DataFrame, score: str, tokens: str, out: str = "efficiency_adjusted") -> DataFrame:
    return df.withColumn(out, F.when(F.col(score).isNotNull() & (F.col(tokens) > 0), F.col(score) / F.ln(F.col(tokens) + 1)))


def mean_present(*columns: Column) -> Column:
    """Mean of the non-null values in a row."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def document_utility(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean of field mean, schema validity, temporal accuracy and quote validity per extraction.

    `facts` covers every expected extraction with `available`; an unavailable one is worth 0.
    """
    fields = scores.groupBy("system", "document_id").agg(F.avg("utility").alias("_field"))
    joined = facts.join(fields, ["system", "document_id"], "left")

    def share(n, d):
        return F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(1.0)

    parts = (F.coalesce("_field", F.lit(0.0)) + F.col("schema_valid").cast("double") + share("temporal_correct", "temporal_checked")
             + share("valid_quotes", "quotes")) / 4
    return joined.select("system", "document_id", F.when(F.col("available"), parts).otherwise(0.0).alias("score"))


# ---- deltas and comparisons -------------------------------------------------------------


def long_metrics(summaries: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    casted = summaries.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return casted.unpivot(ids, metrics, "metric", "value")


def metric_deltas(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """right minus left per (keys..., metric); counts are not compared."""
    skipped = ["documents_expected", "documents_available", "log_records_available"]
    comparable = ~F.col("metric").endswith("_count") & ~F.col("metric").isin(skipped)
    r = right.filter(comparable).select(*keys, "metric", F.col("value").alias("right_value"))
    l_ = left.filter(comparable).select(*keys, "metric", F.col("value").alias("left_value"))
    return r.join(l_, [*keys, "metric"]).withColumn("delta", F.col("right_value") - F.col("left_value"))


def no_worse(deltas: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """Candidate systems against the baseline's own deltas: count and rate of no-worse cells."""
    base = deltas.filter(F.col("system") == baseline).select(*keys, F.col("delta").alias("_b"))
    pairs = deltas.filter(F.col("system") != baseline).join(base, keys).filter(F.col("delta").isNotNull() & F.col("_b").isNotNull())
    return pairs.groupBy("system").agg(
        F.count(F.lit(1)).alias("comparison_count"), F.count_if(F.col("delta") >= F.col("_b")).alias("no_worse_count")
    ).withColumn("no_worse_rate", F.col("no_worse_count") / F.col("comparison_count"))


def wins_and_losses(deltas: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("delta")
    return deltas.filter(d.isNotNull()).groupBy(*by).agg(
        F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"),
        F.avg(d).alias("mean_delta")
    ).withColumn("verdict", F.when((F.col("wins") > 0) & (F.col("losses") > 0), "conditional").when(F.col("wins") > 0, "recommended")
                 .when(F.col("losses") > 0, "not_recommended").otherwise("neutral"))


# ---- frontier ---------------------------------------------------------------------------


def cost_frontier(rows: DataFrame, quality: str, cost: str, cuts: int = 255) -> DataFrame:
    """Rows not dominated on (quality up, cost down), without comparing all pairs.

    Costs are cut into at most cuts+1 ranges; the best quality of all cheaper ranges is a table of
    that many rows, and inside a range one ordered pass finishes. Equal costs are first reduced
    to their best quality.
    """
    usable = rows.filter(F.col(quality).isNotNull() & F.col(cost).isNotNull())
    best = usable.groupBy(cost).agg(F.max(quality).alias("_q"))
    points = [i / (cuts + 1) for i in range(1, cuts + 1)]
    edges = best.agg(F.approx_percentile(cost, points, 10000).alias("_edges")).withColumn("_one", F.lit(1))
    ranged = best.withColumn("_one", F.lit(1)).join(F.broadcast(edges), "_one").withColumn(
        "_range", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(cost)))).drop("_edges", "_one")
    tops = ranged.groupBy("_range").agg(F.max("_q").alias("_top"))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    cheaper = tops.select("_range", F.max("_top").over(before).alias("_cheaper"))
    inside = W.partitionBy("_range").orderBy(cost).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.max("_q").over(inside)).join(F.broadcast(cheaper), "_range")
    bar = F.greatest("_inside", "_cheaper")
    frontier = placed.filter(bar.isNull() | (F.col("_q") > bar)).select(cost, "_q")
    return usable.join(frontier, cost).filter(F.col(quality) == F.col("_q")).drop("_q")


def eligible_pairs(summary: DataFrame, minimum: float = 0.9) -> DataFrame:
    """Rows that may enter the frontier: scored, available, stable."""
    gates = [F.coalesce(F.col(c), F.lit(0.0)) >= minimum for c in ("call_success_rate", "parse_success_rate", "schema_valid_rate")]
    return summary.filter(
        (F.col("scoring_status") == "canonical_scored") & (F.col("availability_note") == "available") & reduce(lambda a, b: a & b, gates))


# ---- decisions --------------------------------------------------------------------------


def target_status(summaries: DataFrame, targets: dict[str, float] | None = None, id_column: str = "system") -> DataFrame:
    """Observed against target per metric; a missing metric does not meet its target."""
    targets = targets or V.RECOVERY_TARGETS
    long = long_metrics(summaries, [id_column], list(targets))
    wanted = F.create_map(*[F.lit(v) for p in targets.items() for v in p])
    target = F.try_element_at(wanted, F.col("metric"))
    return long.select(id_column, "metric", F.col("value").alias("observed"), target.alias("target"),
                       (F.coalesce("value", F.lit(0.0)) >= target).alias("met"))


def promotion(status: DataFrame, id_column: str = "system") -> DataFrame:
    out = status.groupBy(id_column).agg(F.bool_and("met").alias("all_met"), F.count_if("met").alias("met_targets"))
    return out.withColumn("decision", F.when(F.col("all_met"), "promote_to_robustness_gate").otherwise("continue_recovery_cycle"))


def rank_systems(summaries: DataFrame, metrics: list[str], k: int, id_column: str = "system") -> DataFrame:
    """Best k systems by several metrics in turn; missing counts as 0, the id settles ties."""
    return summaries.orderBy(*[F.coalesce(F.col(m), F.lit(0.0)).desc() for m in metrics], id_column).limit(k)


def final_candidates(summaries: DataFrame, id_column: str = "condition") -> DataFrame:
    """Best quality, and best quality at least cost, among eligible conditions (distinct)."""
    ok = summaries.filter(
        (F.coalesce("benchmark_quality", F.lit(0.0)) > 0) & (F.coalesce("schema_valid_rate", F.lit(0.0)) >= 0.9)
        & (F.coalesce("quote_validity_rate", F.lit(0.0)) >= 0.9))
    best = ok.orderBy(F.desc("benchmark_quality"), id_column).limit(1).select(id_column, F.lit("best_quality").alias("role"))
    thrifty = ok.filter(F.col("mean_estimated_cost_usd").isNotNull()).orderBy(
        F.desc("benchmark_quality"), F.asc("mean_estimated_cost_usd"), id_column).limit(1).select(
        id_column, F.lit("best_cost_effective").alias("role"))
    return best.unionByName(thrifty).groupBy(id_column).agg(F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"))


def cheapest(rows: DataFrame, cost: str, k: int = 1, tie: str = "system") -> DataFrame:
    return rows.orderBy(F.asc_nulls_last(cost), tie).limit(k)


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """Most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
