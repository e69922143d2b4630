"""Review tables: failure tags and modes, run comparisons, error examples, overlays, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.functions import normalize as N
from goldmeter.functions.text import text_of
from goldmeter.operators.intervals import overlapping_pairs
from goldmeter.operators.passages import quote_place
from goldmeter.operators.selection import top_k

KEY = ["system", "document_id"]


def incorrect_fields(scores: DataFrame) -> DataFrame:
    """Wrong metrics per extraction as one sorted text ("" when none)."""
    wrong = F.when(F.col("kind") == "set", (F.col("fp") > 0) | (F.col("fn") > 0)).otherwise(~F.col("correct"))
    return scores.groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(wrong, F.col("metric")))), "|").alias("incorrect"),
        F.count_if(wrong).alias("incorrect_count"))


# fixed values: failure tag of a wrong metric
METRIC_TAGS = {
    "medication_name": "normalization_or_missingness", "medication_full": "normalization_or_missingness",
    "seizure_type": "normalization_or_missingness", "current_seizure_frequency": "temporality_or_frequency_normalization",
    "seizure_frequency_type_linkage": "temporality_or_frequency_normalization", "eeg": "investigation_ambiguity",
    "mri": "investigation_ambiguity", "epilepsy_diagnosis": "diagnosis_normalization",
}


def failure_tags(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Sorted failure tags and quote-error class of every expected extraction.

    `facts`: system, document_id, available, schema_valid, quotes, valid_quotes, temporal_checked, temporal_correct.
    """
    wrong = F.when(F.col("kind") == "set", (F.col("fp") > 0) | (F.col("fn") > 0)).otherwise(~F.col("correct"))
    table = F.create_map(*[F.lit(v) for p in METRIC_TAGS.items() for v in p])
    tags = scores.filter(wrong).groupBy(*KEY).agg(
        F.collect_set(F.try_element_at(table, F.col("metric"))).alias("_t"), F.count(F.lit(1)).alias("_wrong"))
    return tagged(facts.join(tags, KEY, "left"))


def tagged(rows: DataFrame) -> DataFrame:
    """Tags and quote-error class of rows with the facts of `failure_tags`, `_t` (tags of wrong metrics) and `_wrong` (their number)."""
    bad_quotes = F.coalesce(F.col("quotes") - F.col("valid_quotes"), F.lit(0)) > 0
    own = F.array(
        F.when(~F.col("available"), F.lit("missing_output")), F.when(~F.coalesce("schema_valid", F.lit(False)), F.lit("schema_or_parse")),
        F.when(bad_quotes, F.lit("evidence_selection")), F.when(F.col("temporal_correct") < F.col("temporal_checked"), F.lit("temporality")))
    every = F.array_sort(F.array_distinct(F.concat(F.filter(own, lambda x: x.isNotNull()), F.coalesce("_t", F.array().cast("array<string>")))))
    quote_class = (F.when(bad_quotes, "quote_invalid").when(F.coalesce("_wrong", F.lit(0)) > 0, "quote_valid_but_semantically_wrong_or_missing")
                   .otherwise("no_field_error"))
    return rows.select(*KEY, F.when(F.size(every) == 0, "none_flagged").otherwise(F.array_join(every, "|")).alias("tags"),
                         quote_class.alias("quote_error_class"))


def failure_stage(log: DataFrame, incorrect: DataFrame) -> DataFrame:
    """Where a wrong event-first document failed, from its decision log (document_id, field, decision).

    `incorrect`: document_id, metric rows of wrong metrics.
    """
    per_doc = log.groupBy("document_id").agg(
        F.bool_or(F.col("decision") == "conflict").alias("_conflict"), F.bool_or(F.col("decision") == "selected").alias("_selected"))
    no_support = log.groupBy("document_id", "field").agg(F.bool_and(F.col("decision") == "missing").alias("_none")).filter("_none").select(
        "document_id", F.col("field").alias("metric"))
    hit = incorrect.join(no_support, ["document_id", "metric"], "left_semi").select("document_id").distinct().withColumn("_unsupported", F.lit(True))
    docs = incorrect.select("document_id").distinct()
    joined = docs.join(per_doc, "document_id", "left").join(hit, "document_id", "left")
    stage = (
        F.when(F.col("_conflict").isNull(), "aggregation_log_unavailable").when(F.col("_unsupported"), "extraction_failure_missing_event_support")
        .when(F.col("_conflict"), "aggregation_failure_conflict_resolution").when(F.col("_selected"), "aggregation_failure_or_event_normalization")
        .otherwise("no_event_first_failure_flagged"))
    return joined.select("document_id", stage.alias("stage"))


def error_rows(flags: DataFrame) -> DataFrame:
    """False positives and negatives as rows (system, document_id, metric, key, error_type)."""
    return flags.filter(F.col("in_pred") != F.col("in_gold")).select(
        *KEY, "metric", "key", F.when(F.col("in_pred"), "fp").otherwise("fn").alias("error_type"))


def attribute_errors(flags: DataFrame, event_values: DataFrame | None = None, event_system: str = "E2") -> DataFrame:
    """Errors of set flags (`error_rows`) and their failure source: normalizer, event aggregation or extraction, or prompt
    extraction.

    A wrong full medication whose name occurs on the other side, or a type whose coarse class does, is a normaliser error; both
    sides of a part are seen by a window over the flags, so they are computed once. For the event system a missed value that was
    extracted is an aggregation error.
    """
    name = F.substring_index("key", " | ", 1)
    part = F.when(F.col("metric") == "medication_full", name).when(F.col("metric") == "seizure_type", N.failure_label(F.col("key")))
    sides = W.partitionBy(*KEY, "metric", "_part")
    keyed = flags.select(*KEY, "metric", "key", "in_pred", "in_gold", part.alias("_part"))
    keyed = keyed.withColumn("_p", F.max("in_pred").over(sides)).withColumn("_g", F.max("in_gold").over(sides))
    joined = keyed.filter(F.col("in_pred") != F.col("in_gold")).withColumn("error_type", F.when(F.col("in_pred"), "fp").otherwise("fn"))
    other = F.col("_part").isNotNull() & F.when(F.col("error_type") == "fp", F.col("_g")).otherwise(F.col("_p"))
    ev = F.col("system") == event_system
    if event_values is not None:
        seen = event_values.select("document_id", F.col("value").alias("_value")).distinct().withColumn("_seen", F.lit(True))
        joined = joined.withColumn("_value", name).join(seen, ["document_id", "_value"], "left")
        aggregated = ev & (F.col("error_type") == "fn")
        source = F.when(aggregated & F.col("_seen"), "event_aggregation").when(aggregated, "event_extraction")
    else:
        source = F.when(F.lit(False), "")
    source = source.when(F.coalesce(other, F.lit(False)), "normalizer").when(ev, "event_extraction").otherwise("prompt_extraction")
    return joined.select(*KEY, "metric", "key", "error_type", source.alias("failure_source"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """First against last run per document: fixed / regressed / both_correct / both_miss(_same_prediction).

    `runs`: document_id, run_ord, correct, label.
    """
    c = runs.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("correct", "run_ord").alias("_first"), F.max_by("correct", "run_ord").alias("_last"),
        (F.min("label") == F.max("label")).alias("_same"))
    delta = (
        F.when(F.col("_n") < 2, "").when(~F.col("_first") & F.col("_last"), "fixed").when(F.col("_first") & ~F.col("_last"), "regressed")
        .when(F.col("_first"), "both_correct").when(F.col("_same"), "both_miss_same_prediction").otherwise("both_miss"))
    return c.select("document_id", delta.alias("delta"))


def paired_examples(utilities: DataFrame, incorrect: DataFrame, baseline: str, k: int) -> DataFrame:
    """Top-k documents per (comparator, category): improves / worse / all fail.

    `utilities`: system, document_id, score; `incorrect`: system, document_id, incorrect_count.
    """
    base = utilities.filter(F.col("system") == baseline).join(
        incorrect.select(*KEY, "incorrect_count"), KEY, "left").select(
        "document_id", F.col("score").alias("base_score"), F.coalesce("incorrect_count", F.lit(0)).alias("_bw"))
    other = utilities.filter(F.col("system") != baseline).join(incorrect.select(*KEY, "incorrect_count"), KEY, "left")
    pairs = other.join(base, "document_id").select(
        F.col("system").alias("comparator"), "document_id", "score", "base_score", (F.col("score") - F.col("base_score")).alias("delta"),
        ((F.coalesce("incorrect_count", F.lit(0)) > 0) & (F.col("_bw") > 0)).alias("_both"))
    d = F.col("delta")
    cats = F.array(
        F.when(d > 0, F.struct(F.lit("comparator_improves").alias("category"), (-d).alias("sort_key"))),
        F.when(d < 0, F.struct(F.lit("baseline_outperforms").alias("category"), d.alias("sort_key"))),
        F.when(F.col("_both"), F.struct(F.lit("all_systems_fail").alias("category"), F.greatest("score", "base_score").alias("sort_key"))))
    rows = pairs.select("comparator", "document_id", "score", "base_score", "delta", F.inline(F.filter(cats, lambda x: x.isNotNull())))
    return top_k(rows, ["comparator", "category"], [F.asc("sort_key"), F.asc("document_id")], k).drop("sort_key")


def error_examples(incorrect: DataFrame, k: int) -> DataFrame:
    """First k extractions with a wrong field, by system and document."""
    return incorrect.filter(F.col("incorrect_count") > 0).orderBy("system", "document_id").limit(k)


# fixed values: annotation types that may support a field
FIELD_TYPES = {
    "current_anti_seizure_medications": ["Prescription"], "previous_anti_seizure_medications": ["Prescription"],
    "current_seizure_frequency": ["SeizureFrequency"], "seizure_types": ["Diagnosis", "PatientHistory", "SeizureFrequency"],
    "epilepsy_diagnosis": ["Diagnosis"], "eeg": ["Investigations"], "mri": ["Investigations"],
}


def field_overlay(fields: DataFrame, annotations: DataFrame, types: dict[str, list[str]] | None = None) -> DataFrame:
    """Alignment of every model field with the gold annotations its quotes overlap.

    `fields`: document_id, field_path, field_group, value, missingness, quotes (array), text.
    """
    types = types or FIELD_TYPES
    place = F.transform(F.col("quotes"), lambda q: quote_place(F.col("text"), q))
    located = fields.withColumn("_spans", F.filter(place, lambda s: s["char_start"].isNotNull())).drop("text")
    table = F.create_map(*[c for k, v in types.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    probes = located.select("document_id", "field_path", F.explode(F.try_element_at(table, F.col("field_group"))).alias("label"), "_spans").select(
        "document_id", "field_path", "label", F.inline("_spans").alias("l_start", "l_end"))
    gold = annotations.select("document_id", "label", "ann_id", F.col("char_start").alias("r_start"), F.col("char_end").alias("r_end"))
    hits = overlapping_pairs(probes.distinct(), gold, ["document_id", "label"]).groupBy("document_id", "field_path").agg(
        F.count_distinct("ann_id").alias("gold_candidates"), F.min("ann_id").alias("first_candidate"))
    out = located.join(hits, ["document_id", "field_path"], "left").na.fill(0, ["gold_candidates"])
    there = (F.col("missingness") == "present") & F.col("value").isNotNull()
    status = (F.when(~F.coalesce(there, F.lit(False)), "not_present").when(F.col("gold_candidates") > 0, "overlaps_gold")
              .when(F.size("quotes") > 0, "evidence_only").otherwise("ungrounded"))
    return out.select("document_id", "field_path", "field_group", "value", F.size("quotes").cast("long").alias("evidence_count"),
                      F.size("_spans").cast("long").alias("located_count"), "gold_candidates", "first_candidate", status.alias("status"))


def frequency_failure_mode(scalars: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ordered failure mode of each frequency prediction, NULL when correct.

    `scalars`: verdict columns of scalar_scores; `predictions`: system, document_id, predicted, parsed_class,
    has_evidence, evidence_overlaps.
    """
    j = scalars.join(predictions, KEY)
    said = text_of(F.col("predicted")) != ""
    n = F.col("gold_annotations")
    mode = (
        F.when(F.col("per_letter"), F.lit(None)).when((n == 0) & said, "no_gold_frequency").when((n > 0) & ~said, "missing_prediction")
        .when(said & F.col("parsed_class").isin("", "unparsed"), "unparsed_prediction")
        .when(F.col("has_evidence") & ~F.col("evidence_overlaps"), "wrong_span").when(~F.col("scope_ok"), "wrong_temporality")
        .when(~F.col("period_hit"), "wrong_period").when(~F.col("count_hit"), "wrong_count").otherwise("task_definition_mismatch"))
    return j.select(*KEY, mode.alias("failure_mode"))


def fails_first(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.asc("correct"), F.asc("document_id"))


# ---- dashboards -------------------------------------------------------------------------


def metric_pivot(long: DataFrame, row: str, systems: list[str], reason: str = "unavailable_metric") -> DataFrame:
    """Metric by system table; a missing cell carries its reason."""
    wide = long.groupBy(row).pivot("system", systems).agg(F.first("value", ignorenulls=True))
    out = wide
    for s in systems:
        out = out.withColumn(f"{s}_missing", F.when(F.col(s).isNull(), F.lit(reason)))
    return out


def first_nonzero(*columns: Column) -> Column:
    """First value that is neither NULL nor 0; a plain 0 only when it is the last choice."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in columns[:-1]], columns[-1])


def missing_cells(pivot: DataFrame, row: str, systems: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"{s}_missing").alias("reason")) for s in systems])
    return pivot.select(row, F.inline(cells)).filter(F.col("reason").isNotNull())
