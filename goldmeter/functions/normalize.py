"""Clinical value normalisers as Column builders; rule order is part of the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldmeter.functions import vocabulary as V
from goldmeter.functions.text import any_of, let, lookup, norm_value, recode, squeeze, strip, text_of


def longest_surface(text: Column, surfaces: dict[str, str]) -> Column:
    """Concept of the longest dictionary surface standing on word boundaries, else NULL.

    One scan with a longest-first alternation, then a max over the few hits; equal
    lengths are settled by dictionary order.
    """
    ordered = sorted(surfaces, key=len, reverse=True)
    pattern = r"\b(" + "|".join(s.replace(".", r"\.") for s in ordered) + r")\b"
    rank = {s: -i for i, s in enumerate(ordered)}
    hits = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 1), lambda m: F.struct(lookup(m, rank).cast("int").alias("r"), m.alias("m"))
    )
    return lookup(F.array_max(hits)["m"], surfaces)


def dictionary_name(text: Column, surfaces: dict[str, str]) -> Column:
    """Exact lookup, then the longest surface in the text, then the text itself."""
    return let(text, lambda t: F.coalesce(lookup(t, surfaces), longest_surface(t, surfaces), t))


def medication_surface(c: Column) -> Column:
    """Normalised medication text without formulation and dose."""
    bare = F.regexp_replace(norm_value(c), V.FORMULATION_PATTERN, " ")
    return squeeze(F.regexp_replace(bare, V.NAME_DOSE_PATTERN, " "))


def medication_name(c: Column) -> Column:
    return dictionary_name(medication_surface(c), V.MEDICATION_SYNONYMS)


def dose_unit(c: Column) -> Column:
    return let(norm_value(c), lambda t: recode(t, V.DOSE_UNITS))


def dose_value(c: Column) -> Column:
    t = F.regexp_replace(norm_value(c), rf"(?<=\d){V.DOSE_UNIT_WORDS}\b", "")
    return F.replace(F.regexp_replace(t, rf"\b{V.DOSE_UNIT_WORDS}\b", ""), F.lit(" "), F.lit(""))


def dosing_schedule(c: Column) -> Column:
    return let(norm_value(c), lambda t: recode(t, V.DOSING_SYNONYMS))


def singular_unit(c: Column) -> Column:
    return F.regexp_replace(norm_value(c), "s$", "")


def seizure_type(c: Column) -> Column:
    t = F.replace(norm_value(c), F.lit("generalised"), F.lit("generalized"))
    return let(squeeze(F.regexp_replace(t, r"\bfits?\b", "seizure")), lambda t: F.coalesce(
        lookup(t, V.SEIZURE_TYPE_SYNONYMS),
        F.when(t.contains("focal") & t.contains("bilateral") & t.contains("tonic clonic"),
              "focal to bilateral tonic clonic seizure")
        .when(t.contains("complex partial") | (t.contains("focal") & t.contains("impaired awareness")),
              "focal impaired awareness seizure")
        .when(any_of(t, ["focal", "partial"]), "focal seizure")
        .when(any_of(t, ["tonic clonic", "gtc"]), "generalized tonic clonic seizure")
        .when(t.contains("absence"), "generalized absence seizure")
        .when(t.contains("myoclonic"), "generalized myoclonic seizure")
        .when(t.isin("seizure", "seizures"), "unknown seizure type")
        .otherwise(t)
    ))


def diagnosis(c: Column) -> Column:
    return let(F.replace(norm_value(c), F.lit("generalised"), F.lit("generalized")), lambda t: F.coalesce(
        lookup(t, V.DIAGNOSIS_SYNONYMS),
        F.when(any_of(t, ["temporal lobe", "focal", "partial"]), "focal epilepsy")
        .when(any_of(t, ["generalized", "idiopathic general"]), "generalized epilepsy")
        .when(t.contains("epilepsy"), "epilepsy")
        .otherwise(t)
    ))


def coarse_seizure_of(canonical: Column) -> Column:
    """Three-class label of an already canonical seizure type."""
    return F.coalesce(
        lookup(canonical, V.COARSE_SEIZURE),
        F.when(canonical == "", "")
        .when(any_of(canonical, ["focal", "partial"]), "focal seizure or epilepsy")
        .when(any_of(canonical, ["generalized", "tonic clonic", "absence", "myoclonic"]),
              "generalized seizure or epilepsy")
        .otherwise("unknown seizure or epilepsy")
    )


def coarse_seizure(c: Column) -> Column:
    return let(seizure_type(c), coarse_seizure_of)


def coarse_diagnosis_of(canonical: Column) -> Column:
    return F.coalesce(
        lookup(canonical, V.COARSE_DIAGNOSIS),
        F.when(canonical == "", "")
        .when(canonical.contains("focal"), "focal_epilepsy")
        .when(canonical.contains("generalized"), "generalized_epilepsy")
        .when(canonical.contains("combined"), "combined_generalized_and_focal_epilepsy")
        .when(canonical.contains("epilepsy"), "unknown_epilepsy")
        .otherwise("")
    )


def coarse_diagnosis(c: Column) -> Column:
    return let(diagnosis(c), coarse_diagnosis_of)


# fixed values: symptom words that are not a seizure label by themselves
SYMPTOM_TERMS = [
    "aura", "warning", "unusual smell", "strange smell", "strange taste", "abdominal sensation", "epigastric",
]
SEIZURE_TERMS = ["seizure", "seizures", "fit", "fits", "convulsive", "convulsion"]


def projection_label(c: Column) -> Column:
    """Collapse a free description to the benchmark label space; symptoms alone give NULL."""
    t = F.translate(F.replace(F.lower(text_of(c)), F.lit("generalised"), F.lit("generalized")), "-", " ")
    return let(squeeze(F.regexp_replace(t, "(?i)[^a-z0-9/ ]+", " ")), lambda t: (
        F.when(t.isin("", "not stated", "none", "null"), F.lit(None))
        .when(any_of(t, SYMPTOM_TERMS) & ~any_of(t, SEIZURE_TERMS), F.lit(None))
        .when(any_of(t, ["dissociative", "nonepileptic", "non epileptic", "dizzy spell"]), "unknown seizure type")
        .when(t.contains("secondary") & any_of(t, ["generalized", "convulsive", "tonic clonic"]),
              "secondary generalized seizures")
        .when(t.contains("focal to bilateral") & t.contains("tonic clonic"), "secondary generalized seizures")
        .when(any_of(t, ["focal", "partial", "temporal"]), "focal seizure")
        .when(any_of(t, ["tonic clonic", "gtc"]), "generalized tonic clonic seizure")
        .when(t.contains("absence"), "generalized absence seizure")
        .when(t.contains("myoclonic"), "generalized myoclonic seizure")
        .when(t.contains("generalized seizure"), "generalized seizures")
        .when(t.isin("seizure", "seizures", "fits"), "unknown seizure type")
        .otherwise(strip(c))
    ))


def failure_label(c: Column) -> Column:
    """Four-way collapse used when attributing errors."""
    def rules(t):
        focal = any_of(t, ["focal", "partial", "temporal lobe", "frontal lobe"])
        general = any_of(t, ["generalised", "generalized", "absence", "myoclonic", "tonic clonic"])
        return (
            F.when(focal & general, "combined_generalized_focal")
            .when(focal, "focal")
            .when(general, "generalized")
            .when(any_of(t, ["seizure", "epilepsy", "jme"]), "unknown")
            .otherwise("")
        )

    return let(norm_value(c), rules)


def investigation_result(c: Column) -> Column:
    return let(norm_value(c), lambda t: (
        F.when(t == "", "")
        .when(any_of(t, V.NORMAL_RESULT_TERMS), "normal")
        .when(any_of(t, V.ABNORMAL_RESULT_TERMS), "abnormal")
        .when(t.contains("normal"), "normal")
        .when(any_of(t, V.PENDING_RESULT_TERMS), "uncertain")
        .otherwise(t)
    ))


def _joined(value: Column, evidence: Column | None) -> Column:
    parts = F.array(norm_value(value), norm_value(F.lit(None) if evidence is None else evidence))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def temporality(value: Column, evidence: Column | None = None) -> Column:
    def rules(t):
        return (
            F.when(t == "", "")
            .when(any_of(t, V.HISTORICAL_TERMS), "historical")
            .when(any_of(t, V.PLANNED_TERMS), "planned")
            .when(any_of(t, V.CURRENT_TERMS), "current")
            .otherwise(let(norm_value(value), lambda own: F.when(own == "", "uncertain").otherwise(own)))
        )

    return let(_joined(value, evidence), rules)


def missingness(value: Column, evidence: Column | None = None) -> Column:
    return let(_joined(value, evidence), lambda t: (
        F.when(t == "", "not_stated")
        .when(any_of(t, V.UNCERTAIN_TERMS), "uncertain")
        .when(any_of(t, V.CONFLICT_TERMS), "conflicting")
        .otherwise("present")
    ))


def evidence_text(evidence: Column) -> Column:
    """Quotes of an evidence array as one text."""
    return F.array_join(F.transform(evidence, lambda e: text_of(e["quote"])), " ")


def medication_struct(item: Column) -> Column:
    """All six normalised members of a medication item."""
    ev = evidence_text(item["evidence"])
    return F.struct(
        medication_name(item["name"]).alias("name"),
        dose_value(item["dose"]).alias("dose"),
        dose_unit(item["dose_unit"]).alias("dose_unit"),
        dosing_schedule(item["frequency"]).alias("frequency"),
        temporality(item["temporality"], ev).alias("temporality"),
        missingness(item["missingness"], ev).alias("missingness"),
    )


def is_epilepsy_diagnosis(canonical: Column) -> Column:
    return any_of(canonical, ["epilepsy", "epilept"])


def concept_class(phrase: Column) -> Column:
    """missing / generic / malformed / specific class of a concept phrase."""
    raw = text_of(phrase)
    t = F.rtrim(F.lower(strip(raw)), F.lit("-"))
    return (
        F.when(F.lower(raw).isin("null", "none", ""), "missing")
        .when(t.isin(V.GENERIC_CONCEPTS), "generic")
        .when(t.rlike(r"[()\[\]{}]"), "malformed")
        .when(F.length(t) <= 4, "generic")
        .otherwise("specific")
    )
