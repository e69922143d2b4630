"""Audits of a stand-off annotation corpus and of its letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions import vocabulary as V
from goldmeter.functions.normalize import concept_class
from goldmeter.functions.text import slice_text, strip, text_of
from goldmeter.operators import intervals as I


def attr(name: str) -> Column:
    """Attribute value, "" when absent."""
    return F.coalesce(F.try_element_at(F.col("attributes"), F.lit(name)), F.lit(""))


def stated(c: Column) -> Column:
    return (c != "") & ~F.lower(c).isin("null", "none")


# fixed values: severity of span issues
SPAN_SEVERITY = {
    "clean": "ok", "trailing_separator": "low", "leading_separator": "low", "truncated_span": "medium",
    "span_longer_than_source": "medium", "partial_overlap": "medium", "offset_out_of_range": "high", "off_by_one": "low",
    "mismatch": "high",
}


def span_integrity(annotations: DataFrame, letters: DataFrame) -> DataFrame:
    """Issue and severity of every annotation whose letter exists (document_id, ann_id, label, offsets, annotation_text)."""
    def fold(c):
        return F.lower(strip(F.translate(c, "-", " ")))

    s, e, span, text = F.col("char_start"), F.col("char_end"), F.col("annotation_text"), F.col("text")
    inside = (s >= 0) & (s < e) & (e <= F.length(text))
    joined = annotations.join(letters.select("document_id", "text"), "document_id").withColumn(
        "source_slice", F.when(inside, slice_text(text, s, e)).otherwise(""))
    cut = F.col("source_slice")
    # the neighbours of the slice are enough for the off-by-one test, so the letter is dropped here
    staged = joined.select(
        *[c for c in annotations.columns], "source_slice", fold(span).alias("_n"), fold(cut).alias("_m"),
        fold(slice_text(text, F.greatest(s - 1, F.lit(0)), e)).alias("_left"),
        fold(slice_text(text, s, F.least(F.length(text), e + 1))).alias("_right"))
    n, m = F.col("_n"), F.col("_m")
    shown = cut != ""
    issue = (
        F.when(n == m, "clean")
        .when(shown & (strip(F.rtrim(cut, F.lit("-"))) == strip(F.rtrim(span, F.lit("-")))), "trailing_separator")
        .when(shown & (strip(F.ltrim(cut, F.lit("-"))) == strip(F.ltrim(span, F.lit("-")))), "leading_separator")
        .when(shown & m.startswith(n) & (F.length(n) < F.length(m)), "truncated_span")
        .when(shown & n.startswith(m) & (F.length(m) < F.length(n)), "span_longer_than_source")
        .when(shown & (m.contains(n) | n.contains(m)), "partial_overlap")
        .when(~shown, "offset_out_of_range")
        .when((n == F.col("_left")) | (n == F.col("_right")), "off_by_one").otherwise("mismatch")
    )
    severity = F.create_map(*[F.lit(v) for p in SPAN_SEVERITY.items() for v in p])
    out = staged.withColumn("issue_type", issue)
    return out.select(
        "document_id", "ann_id", "label", "char_start", "char_end", F.col("annotation_text").alias("span_text"),
        "source_slice", "issue_type",
        F.try_element_at(severity, F.col("issue_type")).alias("severity"),
        F.when(F.col("issue_type") == "truncated_span", F.length("_m") - F.length("_n")).otherwise(0).alias("missing_chars"))


def concept_specificity(annotations: DataFrame) -> DataFrame:
    phrase = attr("CUIPhrase")
    return annotations.select("document_id", "ann_id", "label", phrase.alias("cuiphrase"), attr("CUI").alias("cui"),
                              concept_class(phrase).alias("cuiphrase_class"))


def prescriptions(annotations: DataFrame) -> DataFrame:
    """Completeness of prescriptions, and does the dose number occur in the span (within 0.01)?"""
    dose = attr("DrugDose")
    value = F.when(dose.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), dose.try_cast("double"))
    numbers = F.regexp_extract_all("annotation_text", F.lit(r"\d+\.?\d*"), 0)
    found = F.exists(numbers, lambda n: F.abs(n.cast("double") - value) < 0.01)
    return annotations.filter(F.col("label") == "Prescription").select(
        "document_id", "ann_id", F.col("annotation_text").alias("span_text"), attr("DrugName").alias("drug_name"),
        dose.alias("drug_dose"), attr("DoseUnit").alias("dose_unit"), attr("Frequency").alias("frequency"),
        stated(attr("DrugName")).alias("has_drug_name"), stated(dose).alias("has_dose"), stated(attr("DoseUnit")).alias("has_dose_unit"),
        stated(attr("Frequency")).alias("has_frequency"),
        F.when(dose != "", F.coalesce(found, F.lit(False))).alias("dose_in_span"))


def frequency_statements(annotations: DataFrame) -> DataFrame:
    """Completeness issues and zero/active state of frequency annotations."""
    exact, low, high = attr("NumberOfSeizures"), attr("LowerNumberOfSeizures"), attr("UpperNumberOfSeizures")
    point, since, change = attr("PointInTime"), attr("TimeSince_or_TimeOfEvent"), attr("FrequencyChange")
    count = (exact != "") | (low != "") | (high != "")
    period, scope = attr("TimePeriod") != "", (point != "") | (since != "") | (change != "")

    def whole(c):
        return F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("bigint"))

    counts = F.filter(F.array(exact, low, high), stated)
    # one unreadable count makes the whole statement inactive, unless a readable one before it is positive
    readable = F.transform(counts, whole)
    first_bad = F.array_position(F.transform(readable, lambda x: x.isNull().cast("int")), 1)
    before = F.when(first_bad > 0, F.slice(readable, F.lit(1), (first_bad - 1).cast("int"))).otherwise(readable)
    active = F.exists(before, lambda x: x > 0)
    free = F.coalesce(whole(exact) == 0, F.lit(False))
    issues = F.array(
        F.when(count & ~period & ~scope, F.lit("count_without_period_or_scope")),
        F.when(~count & ~period & ~scope, F.lit("no_count_no_period_no_scope")),
        F.when(~stated(attr("CUIPhrase")), F.lit("missing_cuiphrase")))
    return annotations.filter(F.col("label") == "SeizureFrequency").select(
        "document_id", "ann_id", F.col("annotation_text").alias("span_text"), count.alias("has_count"), period.alias("has_period"),
        scope.alias("has_temporal_scope"), free.alias("is_seizure_free"), active.alias("is_active"),
        F.array_join(F.filter(issues, lambda x: x.isNotNull()), "; ").alias("issues"),
        F.when(free, "free").when(active, "active").otherwise("other").alias("state"),
        F.when(since != "", since).otherwise(point).alias("scope"))


def attribute_completeness(annotations: DataFrame) -> DataFrame:
    """Missing negation, certainty and concept ids per (document, label) and per label (document_id NULL), in one rollup."""
    negatable = F.col("label").isin(V.NEGATABLE_TYPES)
    flags = annotations.select(
        "document_id", "label", (negatable & (attr("Negation") == "")).alias("_n"), (attr("Certainty") == "").alias("_c"),
        (attr("CUI") == "").alias("_u"))
    sums = flags.rollup("label", "document_id").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("_n").alias("missing_negation"), F.count_if("_c").alias("missing_certainty"),
        F.count_if("_u").alias("missing_cui"), F.grouping("label").alias("_all")).filter(F.col("_all") == 0).drop("_all")
    for k in ("negation", "certainty", "cui"):
        sums = sums.withColumn(f"{k}_rate", (F.col("count") - F.col(f"missing_{k}")) / F.col("count"))
    return sums


def low_count_documents(counts: DataFrame, value: str = "n", deviations: float = 2.0) -> DataFrame:
    """Flag documents whose total lies below mean - 2 sample deviations over documents.

    The two moments are a one-row table, so no unpartitioned window is needed.
    """
    moments = counts.agg(F.avg(value).alias("_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd")).withColumn("_one", F.lit(1))
    limit = F.col("_mean") - deviations * F.col("_sd")
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(moments), "_one").select(
        *counts.columns, limit.alias("threshold"), (F.col(value) < limit).alias("is_outlier"))


# fixed values: byte sequences of double-encoded text
ARTEFACTS = [("utf8_double_encode_a", "Ã"), ("utf8_double_encode_i", "ï¿½"), ("utf8_double_encode_e", "â€"),
             ("utf8_nbsp", "Â"), ("replacement_char", "�")]
MALE_WORDS = r"(?iU)\b(he|his|him|himself)\b"
FEMALE_WORDS = r"(?iU)\b(she|her|hers|herself)\b"


def artefact_names(text: Column, artefacts=None) -> Column:
    found = F.array(*[F.when(text.contains(mark), F.lit(name)) for name, mark in (artefacts or ARTEFACTS)])
    return F.filter(found, lambda x: x.isNotNull())


def letter_quality(letters: DataFrame) -> DataFrame:
    text = F.col("text")
    male, female = F.regexp_count(text, F.lit(MALE_WORDS)), F.regexp_count(text, F.lit(FEMALE_WORDS))
    staged = letters.select(
        "document_id", F.length(text).alias("char_count"), F.array_join(artefact_names(text), "; ").alias("encoding_artefacts"),
        male.alias("male_pronoun_count"), female.alias("female_pronoun_count"),
        F.substring(text, 1, 100).rlike(r"(?iU)\bDear\b").alias("has_greeting"))
    return staged.withColumn("has_encoding_artefacts", F.col("encoding_artefacts") != "").withColumn(
        "pronoun_mismatch", (F.col("male_pronoun_count") > 0) & (F.col("female_pronoun_count") > 0)
    ).withColumn("too_short", F.col("char_count") < 200)


# ---- letter manifest --------------------------------------------------------------------


def temporal_sparsity(annotations: DataFrame) -> DataFrame:
    """Clinical entities without any temporal attribute."""
    keys = F.array(*[F.lit(k) for k in V.TEMPORAL_ATTRIBUTES])
    return annotations.filter(F.col("label").isin(V.TEMPORAL_TYPES) & ~F.arrays_overlap(F.map_keys("attributes"), keys)).select(
        "document_id", "ann_id", "label", "annotation_text", F.lit("No temporal attribute").alias("reason"))


def incomplete_prescriptions(annotations: DataFrame) -> DataFrame:
    missing = F.filter(F.array(*[F.lit(k) for k in V.PRESCRIPTION_ATTRIBUTES]),
                       lambda k: text_of(F.try_element_at(F.col("attributes"), k)) == "")
    return annotations.filter(F.col("label") == "Prescription").select(
        "document_id", "ann_id", "annotation_text", F.array_join(missing, "|").alias("missing_fields")).filter(F.col("missing_fields") != "")


def timeline(annotations: DataFrame) -> DataFrame:
    """Entities with any temporal signal, with their temporal and count attributes."""
    names = {"year": "YearDate", "period": "TimePeriod", "num_periods": "NumberOfTimePeriods", "time_since": "TimeSince_or_TimeOfEvent",
             "point_in_time": "PointInTime", "lower_seizures": "LowerNumberOfSeizures", "upper_seizures": "UpperNumberOfSeizures",
             "num_seizures": "NumberOfSeizures"}
    out = annotations.select("document_id", "ann_id", "label", "annotation_text", "char_start", "char_end", *[attr(a).alias(n) for n, a in names.items()])
    signal = (F.col("year") != "") | (F.col("period") != "") | (F.col("time_since") != "") | (F.col("point_in_time") != "")
    return out.filter(signal)


def entity_flags(annotations: DataFrame) -> DataFrame:
    """Negated, low-certainty and unknown-type flags per annotation."""
    certainty = F.when(attr("Certainty").rlike(r"^\s*\d+\s*$"), attr("Certainty").try_cast("int"))
    return annotations.select(
        "document_id", "ann_id", "label", "annotation_text", (F.lower(attr("Negation")) == "negated").alias("negated"),
        F.coalesce(certainty < 5, F.lit(False)).alias("low_certainty"), certainty.alias("certainty"),
        ((F.col("label") == "Diagnosis") & F.lower(attr("CUIPhrase")).contains("unknown")).alias("unknown_type"))


def letter_manifest(annotations: DataFrame, labels: list[str]) -> DataFrame:
    """Audit record per document: counts per label and per flaw, and the flaw list."""
    keys = F.array(*[F.lit(k) for k in V.TEMPORAL_ATTRIBUTES])
    label = F.col("label")
    sparse = label.isin(V.TEMPORAL_TYPES) & ~F.arrays_overlap(F.map_keys("attributes"), keys)
    short = F.lit(False)
    for k in V.PRESCRIPTION_ATTRIBUTES:
        short = short | (attr(k) == "")
    signal = F.lit(False)
    for k in ("YearDate", "TimePeriod", "TimeSince_or_TimeOfEvent", "PointInTime"):
        signal = signal | (attr(k) != "")
    certainty = F.when(attr("Certainty").rlike(r"^\s*\d+\s*$"), attr("Certainty").try_cast("int"))
    per_doc = annotations.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("entities"), *[F.count_if(label == v).alias(f"n_{v}") for v in labels],
        F.count_if(sparse).alias("temporal_sparse"), F.count_if((label == "Prescription") & short).alias("incomplete_medications"),
        F.count_if(signal).alias("timeline_events"), F.count_if(F.lower(attr("Negation")) == "negated").alias("negated"),
        F.count_if(certainty < 5).alias("low_certainty"),
        F.coalesce(F.bool_or((label == "Diagnosis") & F.lower(attr("CUIPhrase")).contains("unknown")), F.lit(False)).alias("unknown_type"))
    shared = I.same_span_types(annotations).groupBy("document_id").agg(F.count(F.lit(1)).alias("overlapping_spans"))
    out = per_doc.join(shared, "document_id", "left").na.fill(0, ["overlapping_spans"])
    flaws = F.array(
        F.when(F.col("overlapping_spans") > 0, F.lit("overlapping_entities")), F.when(F.col("temporal_sparse") > 0, F.lit("temporal_sparsity")),
        F.when(F.col("incomplete_medications") > 0, F.lit("incomplete_medication_tuple")),
        F.when(F.col("unknown_type"), F.lit("unknown_seizure_type_meta_label")), F.when(F.col("negated") > 0, F.lit("negated_entities")))
    return out.withColumn("flaws", F.array_join(F.filter(flaws, lambda x: x.isNotNull()), "|"))


def location_summary(located: DataFrame) -> DataFrame:
    """Corpus counts of the two location flags."""
    return located.agg(
        F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("annotations"),
        F.count_if(~F.col("match_by_offset")).alias("offset_mismatches"), F.count_if(~F.col("match_in_document")).alias("document_mismatches"))


def corpus_summary(annotations: DataFrame, letters: DataFrame, table_rows: DataFrame | None = None) -> DataFrame:
    """Long (check, measure, n) table of all corpus checks."""
    def counted(df: DataFrame, check: str, column: str) -> DataFrame:
        return df.groupBy(F.col(column).cast("string").alias("measure")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), "measure", "n")

    def flags(df: DataFrame, check: str, **conditions: Column) -> DataFrame:
        wide = df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
        return wide.unpivot([], list(conditions), "measure", "n").select(F.lit(check).alias("check"), "measure", "n")

    statements = frequency_statements(annotations)
    conflicts = I.conflict_counts(annotations)
    contradictions = I.contradiction_counts(statements)
    parts = [
        counted(span_integrity(annotations, letters), "span_boundary", "issue_type"),
        conflicts.groupBy(F.col("tier").alias("measure")).agg(F.sum("pairs").alias("n")).select(F.lit("conflicts").alias("check"), "measure", "n"),
        counted(concept_specificity(annotations), "concept", "cuiphrase_class"),
        flags(prescriptions(annotations), "prescription", total=F.lit(True), missing_dose=~F.col("has_dose"), missing_unit=~F.col("has_dose_unit"),
              missing_frequency=~F.col("has_frequency"), dose_not_in_span=F.col("has_dose") & ~F.col("dose_in_span")),
        flags(statements, "frequency", total=F.lit(True), with_issues=F.col("issues") != "", missing_cuiphrase=F.col("issues").contains("missing_cuiphrase")),
        contradictions.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("documents")).unpivot(
            [], ["pairs", "documents"], "measure", "n").select(F.lit("contradictions").alias("check"), "measure", "n"),
        flags(letter_quality(letters), "letters", total=F.lit(True), with_artefacts=F.col("has_encoding_artefacts"),
              pronoun_mismatch=F.col("pronoun_mismatch"), too_short=F.col("too_short")),
    ]
    if table_rows is not None:
        parts.append(counted(I.table_offset_issues(table_rows, annotations), "table_offsets", "issue"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
