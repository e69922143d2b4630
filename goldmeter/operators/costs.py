"""Call logs, prices, budgets and parse health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions.text import to_number
from goldmeter.operators import quantiles
from goldmeter.operators.selection import latest_rows
from goldmeter.operators.statistics import mean_present


def one_price(prices: DataFrame) -> DataFrame:
    """A price list with one row per model label; a label listed more than once has the larger of its prices."""
    rest = [c for c in prices.columns if c != "model_label"]
    return prices.groupBy("model_label").agg(*[F.max(c).alias(c) for c in rest])


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from its token usage; status complete or missing_price_or_usage."""
    joined = calls.join(one_price(prices), "model_label", "left")
    kinds = [("input_tokens", "input_per_million", True), ("output_tokens", "output_per_million", True),
             ("cache_read_tokens", "cache_read_per_million", False), ("cache_write_tokens", "cache_write_per_million", False)]
    total, missing = F.lit(0.0), F.lit(False)
    for tokens, price, required in kinds:
        if tokens not in calls.columns:
            continue
        t, p = F.col(tokens), F.col(price)
        total = total + F.coalesce(t / F.lit(1_000_000.0) * p, F.lit(0.0))
        missing = missing | ((t.isNull() | p.isNull()) if required else (t.isNotNull() & p.isNull()))
    return joined.select(
        *calls.columns, F.when(~missing, total).alias("cost"), F.when(missing, "missing_price_or_usage").otherwise("complete").alias("cost_status"))


def cost_estimation_status(cost: Column, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return (
        F.when(cost.isNotNull(), "estimated_or_recorded").when(F.coalesce(model, F.lit("")) == "", "missing_registry_model_label")
        .when(tokens_in.isNull() | tokens_out.isNull(), "missing_token_usage")
        .when((tokens_in <= 0) & (tokens_out <= 0), "legacy_zero_token_usage").otherwise("missing_registry_price"))


def combined_usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Token, latency and cost totals of the calls behind one key."""
    return calls.groupBy(*keys).agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum("latency_ms").alias("latency_ms"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"))


def condition_plan(plan: DataFrame, prices: DataFrame) -> DataFrame:
    """Planned calls, tokens and cost of every selected condition."""
    joined = plan.join(one_price(prices), F.col("model") == F.col("model_label"), "left")
    n_in, n_out = F.col("documents") * F.col("input_tokens"), F.col("documents") * F.col("output_tokens")
    cost = n_in / F.lit(1_000_000.0) * F.col("input_per_million") + n_out / F.lit(1_000_000.0) * F.col("output_per_million")
    return joined.select(
        *plan.columns, (F.col("documents") * F.coalesce("calls_per_document", F.lit(1))).alias("calls"), n_in.alias("total_input_tokens"),
        n_out.alias("total_output_tokens"), cost.alias("estimated_cost_usd"),
        F.when(cost.isNull(), "local_or_unpriced").otherwise("estimated").alias("cost_status"))


def factorial_size(axes: dict[str, DataFrame]) -> DataFrame:
    """Number of conditions of a full factorial, from the axis sizes alone."""
    stacked = None
    for name, axis in axes.items():
        n = axis.agg(F.count_distinct(*[F.col(c) for c in axis.columns]).alias("n")).select(F.lit(name).alias("axis"), "n")
        stacked = n if stacked is None else stacked.unionByName(n)
    wide = stacked.groupBy().pivot("axis", list(axes)).agg(F.first("n"))
    product = F.lit(1).cast("long")
    for name in axes:
        product = product * F.col(name)
    return wide.select(*[F.col(a).alias(f"{a}_count") for a in axes], product.alias("full_factorial_conditions"))


def parse_health(expected: DataFrame, log: DataFrame, keys: list[str], order: str, by: list[str]) -> DataFrame:
    """Parse and repair rates per system over expected documents; a later log row replaces an earlier one.

    `log`: keys..., parse_success, repair_attempted, repair_succeeded and an ingest order.
    """
    flags = ["parse_success", "repair_attempted", "repair_succeeded"]
    last = latest_rows(log.select(*keys, order, *flags), keys, order)
    joined = expected.join(last, keys, "left")
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents_expected"), F.count(order).alias("log_records_available"),
        *[F.count_if(F.col(f)).alias(f"_{f}") for f in flags])
    n = F.col("documents_expected")
    return out.select(
        *by, "documents_expected", "log_records_available", (F.col("_parse_success") / n).alias("parse_success_rate"),
        (F.col("_repair_attempted") / n).alias("repair_attempt_rate"),
        F.when(F.col("_repair_attempted") > 0, F.col("_repair_succeeded") / F.col("_repair_attempted")).alias("repair_success_rate"))


def call_summary(calls: DataFrame, by: list[str], quality: DataFrame | None = None) -> DataFrame:
    """Call, parse and repair rates, latency percentiles, tokens, cost and an availability note per condition.

    `quality` (by..., benchmark_quality) adds the cost per quality point.
    """
    failed = F.col("status") != "success"
    error = F.coalesce("error", F.lit(""))
    quota = error.contains("RESOURCE_EXHAUSTED") | F.lower(error).contains("quota") | error.contains("429")
    transient = error.contains("503") | error.contains("UNAVAILABLE")
    out = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~failed).alias("successful_calls"), F.count_if(F.col("parse_success")).alias("_parsed"),
        F.count_if(F.col("repair_attempted")).alias("_tried"), F.count_if(F.col("repair_succeeded")).alias("_repaired"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"), F.avg("cost").alias("mean_cost"), F.bool_or(quota).alias("_quota"),
        F.bool_or(transient).alias("_transient"))
    late = quantiles.exact(calls, by, "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    late = late.select(*[F.col(c).alias(f"_{c}") for c in by], "latency_p50_ms", "latency_p95_ms")
    out = out.join(late, reduce(lambda x, y: x & y, [out[c].eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True)), "left").drop(*[f"_{c}" for c in by])
    n, good = F.col("documents"), F.col("successful_calls")
    note = (
        F.when((good == 0) & (n > 0) & F.col("_quota"), "unavailable_due_to_quota")
        .when((good > 0) & (good < n) & F.col("_transient"), "mostly_available_with_transient_503")
        .when(good < n, "partially_available_with_failures").otherwise("available"))
    out = out.select(
        *by, "documents", "successful_calls", (good / n).alias("call_success_rate"), note.alias("availability_note"),
        (F.col("_parsed") / n).alias("parse_success_rate"), (F.col("_tried") / n).alias("repair_attempt_rate"),
        F.when(F.col("_tried") > 0, F.col("_repaired") / F.col("_tried")).otherwise(1.0).alias("repair_success_rate"),
        "mean_latency_ms", "latency_p50_ms", "latency_p95_ms", "mean_input_tokens", "mean_output_tokens", "mean_cost")
    if quality is None:
        return out
    return out.join(quality, by, "left").withColumn(
        "cost_per_quality_point", F.when(F.col("benchmark_quality") > 0, F.col("mean_cost") / F.col("benchmark_quality")))


def cost_per_unit(scores: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    """Correct benchmark units per condition and what one of them costs on average."""
    units = scores.groupBy(*by).agg(F.sum("utility").alias("correct_units"))
    cost = calls.groupBy(*by).agg(F.avg("cost").alias("mean_cost"))
    return units.join(cost, by, "left").withColumn(
        "cost_per_correct_unit", F.when(F.col("correct_units") > 0, F.col("mean_cost") / F.col("correct_units")))


def benchmark_quality(summaries: DataFrame, metrics: list[str], id_column: str = "system") -> DataFrame:
    return summaries.select(id_column, mean_present(*[F.col(m).cast("double") for m in metrics]).alias("benchmark_quality"))


def budget_alarms(calls: DataFrame) -> DataFrame:
    """Calls that probably ran out of output budget, with the reasons."""
    budget, out, think = F.col("max_output_tokens"), F.col("output_tokens"), F.coalesce("reasoning_tokens", F.lit(0))
    near = F.coalesce((budget > 0) & (out >= budget * 0.95), F.lit(False))
    starved = F.coalesce((F.trim(F.coalesce("text", F.lit(""))) == "") & (think > 0) & (budget > 0) & (think >= budget * 0.95), F.lit(False))
    stop = F.col("stop_reason")
    reasons = F.array(
        F.when(F.lower(stop).isin("length", "max_tokens", "max_output_tokens"), F.concat(F.lit("stop_reason="), stop)),
        F.when(near, F.lit("output_tokens_near_max_output_tokens")), F.when(starved, F.lit("empty_text_with_reasoning_tokens_near_budget")))
    return calls.withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "; ")).withColumn("triggered", F.col("reasons") != "")


def attach_latency(scores: DataFrame, calls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest call latency per key; a malformed number is NULL."""
    last = latest_rows(calls.select(*keys, order, to_number(F.col("latency")).alias("latency_ms")), keys, order).drop(order)
    return scores.join(last, keys, "left")


def stage_statistics(items: DataFrame, stages: DataFrame, by: list[str]) -> DataFrame:
    """Drop and modify rates of verified items, and did every stage parse?"""
    v = items.groupBy(*by).agg(F.count(F.lit(1)).alias("verified_items"), F.count_if(F.col("action") == "drop").alias("_d"),
                               F.count_if(F.col("action") == "modify").alias("_m"))
    s = stages.groupBy(*by).agg(F.bool_and("parsed").alias("all_stages_parse_ok"), F.count_if("parsed").alias("stages_parsed"))
    return s.join(v, by, "left").select(
        *by, "all_stages_parse_ok", "stages_parsed", F.coalesce("verified_items", F.lit(0)).alias("verified_items"),
        (F.col("_d") / F.col("verified_items")).alias("drop_rate"), (F.col("_m") / F.col("verified_items")).alias("modify_rate"))
