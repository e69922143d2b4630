"""Perturbed corpora: every letter under every perturbation, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions.text import computed_once, folded_case, let, line_array, norm_rate_text, norm_text, rstrip, strip
from goldmeter.operators.passages import quote_is_valid


@dataclass(frozen=True)
class Perturbation:
    """A user-definable perturbation: id, expected label effect, and a Column -> Column text change."""

    id: str
    label_effect: str
    dataset: str
    description: str
    apply: Callable[[Column], Column]


def sections(text: Column) -> Column:
    cut = F.split(strip(text), r"\n(?U:\s)*\n+", -1)
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def reorder_sections(text: Column) -> Column:
    """Sections after the header reversed; fewer than four sections stay as they are."""
    def turn(s):
        body = F.concat(F.slice(s, 1, 1), F.reverse(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))))
        return F.when(F.size(s) < 4, text).otherwise(F.array_join(body, "\n\n"))

    return let(sections(text), turn)


def remove_headings(text: Column) -> Column:
    """Drop lines that end with a colon and have at most five words."""
    def heading(line):
        words = F.filter(F.split(strip(line), r"(?U)\s+"), lambda w: w != "")
        return strip(line).endswith(":") & (F.size(words) <= 5)

    return F.array_join(F.filter(line_array(text), lambda x: ~heading(x)), "\n")


def bullets_to_prose(text: Column) -> Column:
    """Runs of bullet lines become one line of sentences.

    A bullet that follows a bullet is glued to it; everything else starts a new line.
    """
    def is_bullet(x):
        return strip(x).rlike(r"\A[-*\u2022]")

    def said(x):
        return F.concat(F.rtrim(F.ltrim(strip(x), F.lit("-*\u2022 ")), F.lit(".")), F.lit("."))

    def rewrite(lines):
        def glue(x, i):
            follows = F.coalesce(is_bullet(F.get(lines, i - 1)), F.lit(False))
            lead = F.when(i == 0, "").when(is_bullet(x) & follows, " ").otherwise("\n")
            return F.concat(lead, F.when(is_bullet(x), said(x)).otherwise(x))

        return F.array_join(F.transform(lines, glue), "")

    return let(line_array(text), rewrite)


def append_note(note: str, newline: bool = True) -> Callable[[Column], Column]:
    """Append a trap paragraph to the right-trimmed text."""
    tail = "\n\n" + note + "\n"
    return lambda text: F.concat(rstrip(text), F.lit(tail))


def replace_markers(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def change(text: Column) -> Column:
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    return change


PRESERVING, CHANGING, LABELS = "label_preserving", "label_changing", "gan_frequency"

# fixed values: trap texts of the perturbations
NOTES = {
    "historical_medication_trap": "Historical medication note: In childhood the patient previously tried carbamazepine 200 mg twice daily, but this was stopped years ago and is not current.",
    "planned_medication_trap": "Planned change: If seizures worsen in future, we may consider adding levetiracetam 250 mg twice daily. No change is being made today.",
    "family_history_trap": "Family history: The patient's brother had weekly focal seizures as a child, but the patient has not had those events.",
    "negated_investigation_trap": "Investigation note: There is no report of an abnormal MRI in this letter.",
    "historical_seizure_free_trap": "Historical seizure-free wording: An earlier clinic letter described a seizure-free interval, but this sentence is historical and should not replace the current seizure frequency documented in this letter.",
    "vague_frequency_trap": "Vague frequency note: The family sometimes uses phrases such as occasional or now and again, but the current seizure frequency should be taken only from the explicit current statement elsewhere in this letter.",
    "mixed_semiology_type_trap": "Semiology wording note: The phrase focal twitching is used descriptively here and is not a new seizure-type diagnosis unless the letter explicitly labels it as a seizure type.",
    "current_seizure_free_contrast": "Updated seizure frequency: Previously seizures were weekly, but the current seizure frequency is seizure-free for the last six months.",
    "requested_mri_contrast": "Updated investigation plan: MRI brain has been requested and is pending; there is no completed MRI result available today.",
    "gan_historical_frequency_trap": "Historical seizure frequency: Several years ago seizures were weekly, but this is not the current reporting interval.",
}
STRUCTURAL = ["reordered_sections", "removed_headings", "bullets_to_prose"]

LETTER_PERTURBATIONS = [
    Perturbation("reordered_sections", PRESERVING, "exectv2", "section order reversed after the header", reorder_sections),
    Perturbation("removed_headings", PRESERVING, "exectv2", "short heading lines dropped", remove_headings),
    Perturbation("bullets_to_prose", PRESERVING, "exectv2", "bullet lists rewritten as sentences", bullets_to_prose),
    *[Perturbation(k, PRESERVING, "exectv2", k.replace("_", " "), append_note(NOTES[k])) for k in (
        "historical_medication_trap", "planned_medication_trap", "family_history_trap", "negated_investigation_trap",
        "historical_seizure_free_trap", "vague_frequency_trap", "mixed_semiology_type_trap")],
    *[Perturbation(k, CHANGING, "exectv2", k.replace("_", " "), append_note(NOTES[k])) for k in (
        "current_seizure_free_contrast", "requested_mri_contrast")],
]
LABEL_PERTURBATIONS = [
    Perturbation("gan_frequency_bullets", LABELS, "gan_2026", "markers turned into bullets",
                 replace_markers([("Current Medication:", "Current Medication:\n-"), ("Plan:", "Plan:\n-")])),
    Perturbation("gan_historical_frequency_trap", LABELS, "gan_2026", "competing historical frequency",
                 append_note(NOTES["gan_historical_frequency_trap"])),
]


def chosen(ids: list[str] | None, candidates: list[Perturbation]) -> list[Perturbation]:
    """Perturbations by id; an unknown id is an error."""
    if ids is None:
        return candidates
    by_id = {p.id: p for p in candidates}
    missing = [i for i in ids if i not in by_id]
    if missing:
        raise ValueError(f"unknown perturbation id(s): {', '.join(missing)}")
    return [by_id[i] for i in ids]


def perturb(letters: DataFrame, perturbations: list[Perturbation], *keep: str) -> DataFrame:
    """One row per (letter, perturbation): new id, source id, provenance, text, and the letter's columns `keep`.

    The fixed list of perturbations is exploded inside the row, and only the text of the
    generated perturbation is computed, so a letter is read once and nothing is shuffled.
    """
    listed = F.array(*[F.struct(F.lit(p.id).alias("perturbation_id"), F.lit(p.label_effect).alias("label_effect"),
                                F.lit(p.dataset).alias("source_dataset"), F.lit(p.description).alias("description")) for p in perturbations])
    rows = letters.select(F.col("document_id").alias("source_document_id"), F.col("text").alias("_t"), *keep, F.explode(listed).alias("p")).select(
        "source_document_id", "_t", *keep, "p.*")
    text = F.lit(None).cast("string")
    for p in reversed(perturbations):
        text = F.when(F.col("perturbation_id") == p.id, p.apply(F.col("_t"))).otherwise(text)
    safe = F.btrim(F.regexp_replace("perturbation_id", "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return rows.select(
        F.concat(F.col("source_document_id").cast("string"), F.lit("__"), safe).alias("document_id"), "source_document_id", "source_dataset",
        "perturbation_id", "label_effect", "description", text.alias("text"), *keep)


def trap_start(original: Column) -> Column:
    """Offset at which appended text begins in a perturbed letter."""
    return F.length(rstrip(original))


def trap_quotes(grounded: DataFrame, letters: DataFrame, by: list[str]) -> DataFrame:
    """Quotes of perturbed letters that reach into the appended trap.

    `grounded`: by..., source_document_id, quote, char_start, char_end, valid; `letters`: the originals.
    """
    ends = letters.select(F.col("document_id").alias("source_document_id"), trap_start(F.col("text")).alias("_trap"))
    return _trap_counts(grounded.join(ends, "source_document_id"), by)


def _trap_counts(grounded: DataFrame, by: list[str]) -> DataFrame:
    return grounded.groupBy(*by).agg(
        F.count("quote").alias("quotes"), F.count_if(F.col("char_end") > F.col("_trap")).alias("trap_quotes"),
        F.count_if(F.col("quote").isNotNull() & ~F.col("valid")).alias("invalid_quotes"))


def ground_exactly(claims: DataFrame) -> DataFrame:
    """Claims with their letter in `text`: quote (first occurrence of the value, as written there), char_start, char_end, valid.

    Forms of the letter that are there already, `text_low` (folded case) and `text_norm`, are taken as they are.
    """
    low = F.col("text_low") if "text_low" in claims.columns else folded_case(F.col("text"))
    norm = F.col("text_norm") if "text_norm" in claims.columns else norm_text(F.col("text"))
    value = folded_case(F.col("value"))
    at = let(F.instr(low, value), lambda i: F.when((i > 0) & (F.length("value") > 0), i - 1))
    placed = computed_once(claims, claims.columns, char_start=at)
    there = F.substring("text", F.col("char_start") + 1, F.length(value))
    placed = computed_once(placed, placed.columns, quote=F.when(F.col("char_start").isNotNull(), there))
    return placed.withColumn("char_end", F.col("char_start") + F.length("quote")).withColumn(
        "valid", F.coalesce(quote_is_valid(norm, F.col("quote")), F.lit(False)))


def trap_audit(letters: DataFrame, claims: DataFrame, perturbations: list[Perturbation], by: list[str], ground=ground_exactly) -> DataFrame:
    """Ground the claims of each letter anew in its perturbed versions and count quotes that reach into the appended trap.

    `letters`: document_id, text; `claims`: document_id, value and further columns; `by`: columns of the counts, perturbation_id
    or claim columns; `ground` takes claims with `text` and adds quote, char_start, char_end, valid. A letter's claims meet it in
    one row, and a version's text and its folded forms are computed once for all of them.
    """
    own = claims.groupBy("document_id").agg(F.collect_list(F.struct(*[c for c in claims.columns if c != "document_id"])).alias("_claims"))
    met = letters.select("document_id", "text").join(own, "document_id")
    kept = ["source_document_id", "perturbation_id", "_claims", "_trap"]
    versions = perturb(met.withColumn("_trap", trap_start(F.col("text"))), perturbations, "_claims", "_trap")
    versions = computed_once(versions, kept, text=F.col("text"))
    forms = computed_once(versions, [*kept, "text"], text_low=folded_case(F.col("text")), text_norm=norm_text(F.col("text")))
    asked = forms.select("source_document_id", "perturbation_id", "_trap", "text", "text_low", "text_norm", F.inline("_claims"))
    return _trap_counts(ground(asked).drop("text", "text_low", "text_norm"), by)


def robust_deltas(robust: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """Long perturbed metrics minus long clean metrics per (keys..., metric); perturbation stays a column."""
    c = clean.select(*keys, "metric", F.col("value").alias("clean_value"))
    return robust.join(c, [*keys, "metric"], "left").select(
        *robust.columns, "clean_value", (F.col("value") - F.col("clean_value")).alias("delta"))


def degradation_summary(rows: DataFrame) -> DataFrame:
    """Per (system, perturbation): availability, schema and quote validity, frequency accuracy.

    `rows`: system, perturbation_id, available, schema_valid, quote_validity_rate, predicted, expected.
    """
    ok, p, g = F.col("available"), norm_rate_text(F.col("predicted")), norm_rate_text(F.col("expected"))
    out = rows.groupBy("system", "perturbation_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(ok).alias("available"), F.count_if(ok & F.col("schema_valid")).alias("_v"),
        F.avg(F.when(ok, F.col("quote_validity_rate"))).alias("quote_validity_rate"), F.count_if(ok & (g != "") & (p == g)).alias("_c"))
    return out.select(
        "system", "perturbation_id", "documents", "available",
        F.when(F.col("available") > 0, F.col("_v") / F.col("available")).otherwise(0.0).alias("schema_valid_rate"), "quote_validity_rate",
        F.when(F.col("available") > 0, F.col("_c") / F.col("available")).alias("frequency_accuracy"))


def robustness_decision(no_worse: DataFrame, gains: DataFrame, invalid: DataFrame, large_gain: float = 0.05) -> DataFrame:
    """Gate per candidate: mostly no worse, or a large clean gain, and no invalid label-changing output.

    `no_worse`: system, no_worse_rate; `gains`: system, mean_delta; `invalid`: system, invalid_records.
    """
    joined = no_worse.join(gains.select("system", "mean_delta"), "system", "left").join(invalid, "system", "left")
    passes = ((F.coalesce("no_worse_rate", F.lit(0.0)) > 0.5) | (F.coalesce("mean_delta", F.lit(0.0)) >= large_gain)) & (
        F.coalesce("invalid_records", F.lit(0)) == 0)
    return joined.withColumn("decision", F.when(passes, "pass_robustness_gate").otherwise("continue_recovery_cycle"))
