"""Raw extractor responses: parsing, loose payloads, projection to records, raw scores, deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.functions import normalize as N
from goldmeter.functions import vocabulary as V
from goldmeter.functions.text import any_of, computed_once, let, norm_label, strip, text_of
from goldmeter.operators import records as R
from goldmeter.operators.passages import evidence_from_quote
from goldmeter.sources.schemas import CANONICAL, EVENT, EVIDENCE, FIELDS, FREQUENCY, MEDICATION, METADATA, SCALAR

# ---- responses --------------------------------------------------------------------------


def unfenced(text: Column) -> Column:
    """Content of a response that is one fenced code block, else the stripped response."""
    inner = F.regexp_extract(strip(text), r"(?is)\A```(?:json|yaml|yml)?\s*(.*?)\s*```\z", 1)
    return F.when(inner != "", strip(inner)).otherwise(strip(text))


def outer_json(text: Column, opener: str = "{", closer: str = "}") -> Column:
    """Stretch from the first opener to the last closer, else the unfenced text."""
    def cut(t):
        hit = F.regexp_extract(t, rf"(?s)\{opener}.*\{closer}", 0)
        return F.when(hit != "", hit).otherwise(t)

    return let(unfenced(text), cut)


def without_trailing_commas(json_text: Column) -> Column:
    return F.regexp_replace(json_text, r",(\s*[}\]])", "$1")


def is_json(text: Column) -> Column:
    """Is the whole text one JSON value other than null?

    The text is read as the first of two array elements and as the value of an object's key. What may follow a value so that the
    array still ends after two elements can't follow it in the object, so trailing data and joined values fail one of them.
    Repeated keys and raw line breaks in strings are accepted.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    valued = F.json_object_keys(F.concat(F.lit('{"k":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(one & valued & (strip(text) != "") & (strip(text) != "null"), F.lit(False))


# a quoted string, or a stretch outside of strings
_JSON_PARTS = r'"(?:[^"\\]|\\(?s:.))*+"|[^"]+|"'


def nan_to_null(json_text: Column) -> Column:
    """Bare NaN and infinities, which lenient JSON readers accept, as null; strings stay as they are."""
    def part(p):
        return F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,\]}])", "$1null"))

    return F.array_join(F.transform(F.regexp_extract_all(json_text, F.lit(_JSON_PARTS), 0), part), "")


def _readable(text: Column) -> Column:
    """The text, or its form without bare NaN, if that is JSON; NULL otherwise."""
    return F.when(is_json(text), text).otherwise(let(nan_to_null(text), lambda t: F.when(is_json(t), t)))


def parse_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add payload (JSON text or NULL) and the parse status of every response.

    parse_success / repair_attempted / repair_succeeded follow the attempts in turn: the cut text as it is, then without
    trailing commas, then with escaped quotes unescaped. A JSON null is an empty response.
    """
    staged = responses.withColumn("_raw", outer_json(F.col(text))).withColumn("_first", _readable(F.col("_raw")))
    fixed = without_trailing_commas(F.col("_raw"))
    staged = staged.withColumn("_fixed", F.when(F.col("_first").isNull(), fixed))
    staged = staged.withColumn("_second", F.coalesce(_readable(F.col("_fixed")), _readable(F.replace("_fixed", F.lit('\\"'), F.lit('"')))))
    blank = (strip(text_of(F.col(text))) == "") | (F.coalesce(strip(F.col("_raw")), F.lit("")) == "null")
    found = F.coalesce("_first", "_second")
    return staged.select(
        *responses.columns, found.alias("payload"), found.isNotNull().alias("parse_success"),
        (F.col("_first").isNull() & ~blank).alias("repair_attempted"), F.col("_second").isNotNull().alias("repair_succeeded"),
        F.when(blank, "empty response").when(found.isNull(), "not parseable").alias("error"),
    )


# fixed values: keys under which an object may hold the list of events
LIST_KEYS = ["events", "event_list", "items", "results"]


def parse_event_lists(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add events (JSON array text or NULL) and error: the stretch from the first [ to the last ], else an object that holds the
    list under a known key."""
    cut = outer_json(F.col(text), "[", "]")
    listed = let(cut, lambda c: F.when(c.startswith("["), _readable(c)))
    whole = unfenced(F.col(text))
    held = F.coalesce(*[F.when(x.startswith("["), x) for x in (F.get_json_object("_whole", f"$.{k}") for k in LIST_KEYS)])
    staged = responses.withColumn("_whole", F.when(is_json(whole), whole)).withColumn("_listed", listed)
    blank = strip(text_of(F.col(text))) == ""
    nested = F.col("_whole").startswith("{") & held.isNotNull()
    events = F.when(nested, held).otherwise(F.col("_listed"))
    return staged.withColumn("events", events).select(
        *responses.columns, "events", F.when(blank, "empty response").when(F.col("events").isNull(), "not parseable").alias("error"))


def alias_value(payload: Column, paths: list[str]) -> Column:
    """First non-empty value among alias paths, as JSON text or plain text."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


# fixed values: keys under which a label or a quote may come
LABEL_KEYS = ["$.seizure_frequency_number", "$.current_seizure_frequency", "$.label", "$.frequency"]
QUOTE_KEYS = ["$.quote", "$.evidence"]


def predicted_labels(parsed: DataFrame, text: str = "text") -> DataFrame:
    """Label and quote of parsed responses; a plain response gives its first line; fallback unknown."""
    payload = F.col("payload")
    label, quote = alias_value(payload, LABEL_KEYS), alias_value(payload, QUOTE_KEYS)
    first_line = strip(F.btrim(strip(F.substring_index(strip(text_of(F.col(text))), "\n", 1)), F.lit('"')))
    is_object = payload.startswith("{")
    said = F.when(is_object, F.coalesce(F.nullif(norm_label(label), F.lit("")), F.lit("unknown"))).otherwise(
        F.when(first_line == "", "unknown").otherwise(norm_label(first_line)))
    return parsed.withColumn("predicted_label", said).withColumn(
        "quote", F.when(F.coalesce(is_object, F.lit(False)), F.coalesce(quote, F.lit(""))).otherwise(""))


def grounding_answers(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(path, answer) pairs of answer payloads {"groundings": [{"path", "quote"}, ...]}."""
    listed = F.coalesce(F.get_json_object("payload", "$.groundings"), F.get_json_object("payload", "$.decisions"))
    schema = "array<struct<path:string,field_path:string,quote:string,evidence:struct<quote:string>>>"
    rows = parsed.select(*keys, F.explode(F.from_json(listed, schema)).alias("g"))
    path = F.coalesce(F.nullif(F.col("g.path"), F.lit("")), F.col("g.field_path"))
    quote = F.coalesce(F.nullif(F.col("g.quote"), F.lit("")), F.col("g.evidence.quote"))
    return rows.select(*keys, path.alias("path"), strip(quote).alias("answer")).filter(
        (text_of(F.col("path")) != "") & (text_of(F.col("answer")) != ""))


# ---- loose values -----------------------------------------------------------------------

# fixed values: words of an empty loose value
LOOSE_NULLS = ["not stated", "none", "null"]
_EDGE = " -\t\n\r,"


def compact_items(text: Column) -> Column:
    """Items of a one-line list: brackets dropped, cut at semicolons, null words give nothing."""
    def cut(t):
        made = F.filter(F.transform(F.split(t, ";"), lambda p: F.btrim(p, F.lit(_EDGE))), lambda p: p != "")
        return F.when((t == "") | F.lower(t).isin(LOOSE_NULLS), F.array().cast("array<string>")).otherwise(made)

    return let(F.btrim(strip(text_of(text)), F.lit("[]")), cut)


def loose_first(json: Column) -> Column:
    """First usable scalar of a loose JSON value (scalar, object or list), NULL when none."""
    def usable(t):
        return let(strip(t), lambda s: F.when((s != "") & ~F.lower(s).isin(*LOOSE_NULLS, "[]"), s))

    def of_object(o):
        return F.coalesce(*[usable(F.get_json_object(o, f"$.{k}")) for k in ("value", "name", "result", "text")])

    def of_element(e):
        return F.when(e.startswith("{"), of_object(e)).otherwise(usable(e))

    def read(j):
        listed = F.filter(F.transform(F.from_json(j, "array<string>"), of_element), lambda x: x.isNotNull())
        return F.when(j.startswith("["), F.get(listed, F.lit(0))).when(j.startswith("{"), of_object(j)).otherwise(usable(j))

    return let(json, read)


def loose_items(json: Column) -> Column:
    """All items of a loose JSON value as array<string>."""
    def read(j):
        elements = F.from_json(j, "array<string>")
        flat = F.flatten(F.transform(elements, lambda e: F.when(
            e.startswith("{"), F.filter(F.array(loose_first(e)), lambda x: x.isNotNull())).otherwise(compact_items(e))))
        kept = F.filter(flat, lambda x: ~F.lower(x).isin(LOOSE_NULLS))
        empty = F.array().cast("array<string>")
        single = F.filter(F.array(loose_first(j)), lambda x: x.isNotNull())
        return F.when(j.isNull(), empty).when(j.startswith("["), F.coalesce(kept, empty)).when(
            j.startswith("{"), single).otherwise(compact_items(j))

    return let(json, read)


def named_items(json: Column, value_keys: list[str]) -> Column:
    """array<(value, quote)> of objects, lists or strings; objects name their value and quote."""
    def text_at(o, keys):
        return F.coalesce(*[F.nullif(strip(F.get_json_object(o, f"$.{k}")), F.lit("")) for k in keys])

    def of_element(e):
        value = F.when(e.startswith("{"), F.coalesce(text_at(e, value_keys), loose_first(e))).otherwise(loose_first(e))
        quote = F.when(e.startswith("{"), text_at(e, ["quote", "support", "evidence", "source_quote"]))
        return F.struct(value.alias("value"), quote.alias("quote"))

    elements = F.when(json.startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))
    made = F.filter(F.transform(elements, of_element), lambda x: x["value"].isNotNull())
    return F.coalesce(F.when(json.isNotNull(), made), F.array().cast("array<struct<value:string,quote:string>>"))


def seizure_items(payload: Column) -> Column:
    """Named seizure types plus verified mappings not marked keep=false, distinct on (value, quote)."""
    listed = named_items(alias_value(payload, ["$.seizure_types", "$.seizure_type"]), ["label", "benchmark_label", "value", "text"])
    mapped = F.from_json(F.get_json_object(payload, "$.verified_seizure_type_mappings"),
                         "array<struct<benchmark_label:string,label:string,quote:string,support:string,keep:boolean>>")
    kept = F.filter(mapped, lambda m: F.coalesce(m["keep"], F.lit(True)) & (strip(text_of(F.coalesce(m["benchmark_label"], m["label"]))) != ""))
    extra = F.transform(kept, lambda m: F.struct(
        strip(F.coalesce(m["benchmark_label"], m["label"])).alias("value"), F.coalesce(m["quote"], m["support"]).alias("quote")))
    return F.array_distinct(F.concat(listed, F.coalesce(extra, F.array().cast("array<struct<value:string,quote:string>>"))))


# fixed values: alias paths of payload fields
MEDICATION_PATHS = ["$.medication_names", "$.current_anti_seizure_medications", "$['current anti-seizure medications']"]
TYPE_PATHS = ["$.seizure_types", "$.seizure_type"]
DIAGNOSIS_PATHS = ["$.epilepsy_types", "$.epilepsy_diagnosis", "$.epilepsy_diagnosis_type", "$['epilepsy diagnosis/type']"]
FREQUENCY_PATHS = ["$.seizure_frequency", "$.current_seizure_frequency"]
_STRUCTURED = "array<struct<name:string,medication_name:string,dose:string,unit:string,dose_unit:string,frequency:string,quote:string>>"
_STRUCTURED_ITEM = "struct<name:string,medication_name:string,dose:string,unit:string,dose_unit:string,frequency:string>"


def investigation_value(payload: Column, key: str) -> Column:
    """EEG or MRI statement: nested, flat, or an item of a loose list that names the modality."""
    direct = loose_first(alias_value(payload, [f"$.investigations.{key}", f"$.{key}", f"$.{key.upper()}_result"]))
    words = ["mri", "magnetic resonance"] if key == "mri" else ["eeg"]
    listed = F.filter(loose_items(F.get_json_object(payload, "$.investigations")), lambda x: any_of(F.lower(x), words))
    is_object = F.coalesce(F.get_json_object(payload, "$.investigations").startswith("{"), F.lit(False))
    return F.coalesce(direct, F.when(~is_object, F.get(listed, F.lit(0))))


def project_payloads(payloads: DataFrame, evidence_items: bool = False, require_evidence: bool = False) -> DataFrame:
    """Relaxed payloads (system, document_id, payload, text, sentences) to canonical records.

    With `evidence_items` values may carry quotes; with `require_evidence` unquoted items drop out.
    """
    p, text, sentences = F.col("payload"), F.col("text"), F.col("sentences")

    def proof(q):
        return evidence_from_quote(text, sentences, q)

    structured = F.filter(F.from_json(F.get_json_object(p, "$.medications"), _STRUCTURED), lambda m: text_of(m["name"]) != "")
    med_json = alias_value(p, MEDICATION_PATHS)
    none = F.array().cast("array<struct<value:string,quote:string>>")
    plain = F.transform(loose_items(med_json), lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("quote")))
    med_items = named_items(med_json, ["name", "value", "text", "medication"]) if evidence_items else plain
    typ_plain = F.transform(loose_items(alias_value(p, TYPE_PATHS)), lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("quote")))
    typ_items = seizure_items(p) if evidence_items else typ_plain
    labelled = F.filter(F.transform(typ_items, lambda t: F.struct(N.projection_label(t["value"]).alias("value"), t["quote"].alias("quote"))),
                        lambda t: t["value"].isNotNull())
    dx_json = alias_value(p, DIAGNOSIS_PATHS)
    dx = F.get(named_items(dx_json, ["label", "value", "text", "diagnosis"]), F.lit(0)) if evidence_items else F.struct(
        loose_first(dx_json).alias("value"), F.lit(None).cast("string").alias("quote"))

    # every stage is computed once, so later stages refer to it instead of repeating it
    s = computed_once(payloads, payloads.columns, _structured=structured, _meds=F.coalesce(med_items, none), _labelled=F.coalesce(labelled, none), _dx=dx,
                      _freq=loose_first(alias_value(p, FREQUENCY_PATHS)), **{f"_{k}": investigation_value(p, k) for k in ("eeg", "mri")})
    s = s.withColumn("_has", F.coalesce(F.size("_structured") > 0, F.lit(False)))
    first_label = F.aggregate("_labelled", F.array().cast("array<struct<value:string,quote:string>>"), lambda acc, t: F.when(
        F.exists(acc, lambda a: a["value"] == t["value"]), acc).otherwise(F.concat(acc, F.array(t))))
    s = computed_once(s, s.columns, _types=first_label)
    if evidence_items and require_evidence:
        s = s.withColumn("_meds", F.filter("_meds", lambda m: F.size(proof(m["quote"])) > 0))
        s = s.withColumn("_types", F.filter("_types", lambda m: F.size(proof(m["quote"])) > 0))
        s = s.withColumn("_dx", F.when(F.size(proof(F.col("_dx.quote"))) > 0, F.col("_dx")))
    blank = F.lit(None).cast("string")
    from_items = F.transform("_meds", lambda m: R.medication_field(R.medication_from_text(m["value"]), proof(m["quote"])))
    from_struct = F.transform("_structured", lambda m: R.medication_field(F.struct(
        m["name"].alias("name"), m["dose"].alias("dose"), F.nullif(F.coalesce(F.nullif(m["unit"], F.lit("")), m["dose_unit"]), F.lit("")).alias("dose_unit"),
        F.nullif(m["frequency"], F.lit("")).alias("frequency")), proof(m["quote"])))
    fields = F.struct(
        F.when(F.col("_has"), from_struct).otherwise(from_items).alias("current_anti_seizure_medications"),
        F.slice(from_items, F.lit(1), F.lit(0)).alias("previous_anti_seizure_medications"),
        R.frequency_field(F.col("_freq"), F.get("_types", F.lit(0))["value"]).alias("current_seizure_frequency"),
        F.transform("_types", lambda t: R.scalar_field(t["value"], "current", proof(t["quote"]))).alias("seizure_types"),
        R.investigation_field(F.col("_eeg")).alias("eeg"), R.investigation_field(F.col("_mri")).alias("mri"),
        R.scalar_field(F.col("_dx.value"), "current", proof(F.col("_dx.quote"))).alias("epilepsy_diagnosis"),
    )
    meta = F.struct(*[blank.alias(n) for n in ("model", "model_label", "harness_id", "format", "projection")],
                    *[F.lit(None).cast("double").alias(n) for n in ("latency_ms", "input_tokens", "output_tokens", "estimated_cost_usd")],
                    *[F.lit(False).alias(n) for n in ("repair_attempted", "repair_succeeded")])
    record = F.struct(
        F.col("document_id").alias("document_id"), F.lit("evidence_projection" if evidence_items else "relaxed_projection").alias("pipeline_id"),
        fields.alias("fields"), F.array().cast(f"array<{CANONICAL['events'].dataType.elementType.simpleString()}>").alias("events"),
        meta.alias("metadata"))
    keep = [c for c in payloads.columns if c not in ("sentences",)]
    return computed_once(s, keep, record=record.cast(CANONICAL))


# ---- sectioned free-text answers --------------------------------------------------------


def clean_key(key: Column) -> Column:
    """Payload key to its canonical field name, qualifiers in brackets dropped."""
    bare = strip(F.substring_index(F.translate(F.lower(key), "_-", "  "), "(", 1))
    table = F.create_map(*[F.lit(v) for p in V.PAYLOAD_KEY_ALIASES.items() for v in p])
    return F.coalesce(F.try_element_at(table, bare), key)


def section_of(label: Column) -> Column:
    """Field a section header speaks about, NULL when it is none of ours."""
    def rule(h):
        return (
            F.when(any_of(h, ["medication", "anti seizure", "asm"]), "medication_names")
            .when(any_of(h, ["seizure type", "seizure semiology"]), "seizure_types")
            .when(h.contains("seizure") & ~h.contains("frequency") & ~h.contains("type"), "seizure_types")
            .when(any_of(h, ["epilepsy", "diagnosis", "syndrome"]), "epilepsy_types")
            .when(any_of(h, ["frequency", "seizure control"]), "seizure_frequency")
            .when(any_of(h, ["eeg", "electroencephalogram"]), "eeg")
            .when(any_of(h, ["mri", "magnetic resonance"]), "mri")
        )

    return let(strip(F.substring_index(F.translate(F.lower(strip(label)), "-", " "), "(", 1)), rule)


def section_lines(responses: DataFrame, text: str = "text", classify=section_of) -> DataFrame:
    """Non-empty lines with the field in force: a header sets it, following lines inherit it.

    Returns (keys..., pos, field, item); a header without a known field clears the field.
    """
    keep = [c for c in responses.columns if c != text]
    lines = responses.select(*keep, F.posexplode(F.split(F.col(text), "\r\n|\r|\n", -1)).alias("pos", "line"))
    bare = strip(F.ltrim(strip(F.col("line")), F.lit("-*•·0123456789. ")))
    lines = lines.withColumn("line", F.replace(F.replace(bare, F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))
    lines = lines.filter(F.col("line") != "")
    header = F.col("line").contains(":")
    lines = lines.withColumn("_own", F.when(header, F.coalesce(classify(F.substring_index("line", ":", 1)), F.lit("")))).withColumn(
        "item", F.when(header, strip(F.substring(F.col("line"), F.instr("line", ":") + 1, F.length("line")))).otherwise(F.col("line")))
    w = W.partitionBy(*keep).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = lines.withColumn("field", F.last("_own", ignorenulls=True).over(w))
    return out.filter(text_of(F.col("field")) != "").select(*keep, "pos", "field", header.alias("is_header"), "item")


# ---- raw scores and projection deltas ---------------------------------------------------


def raw_values(payload: Column) -> dict[str, Column]:
    """Value arrays read straight from a payload, before any projection."""
    structured = F.from_json(F.get_json_object(payload, "$.medications"), "array<string>")
    named = F.filter(F.transform(structured, loose_first), lambda x: x.isNotNull())
    meds = F.when(F.get_json_object(payload, "$.medications").startswith("["), named).otherwise(loose_items(alias_value(payload, MEDICATION_PATHS)))

    def one(c):
        return F.filter(F.array(c), lambda x: x.isNotNull())

    mapped = [F.filter(F.from_json(F.get_json_object(payload, f"$.{k}"), "array<struct<benchmark_label:string,label:string,fact:string,keep:boolean>>"),
                       lambda m: F.coalesce(m["keep"], F.lit(True))) for k in ("verified_seizure_type_mappings", "seizure_type_mappings")]
    empty = F.array().cast("array<string>")
    extra = [F.coalesce(F.transform(m, lambda x: strip(F.coalesce(x["benchmark_label"], x["label"], x["fact"]))), empty) for m in mapped]
    types = F.array_distinct(F.filter(F.concat(F.transform(loose_items(alias_value(payload, TYPE_PATHS)), strip), *extra), lambda x: x != ""))
    inv = {k: one(loose_first(alias_value(payload, [f"$.investigations.{k}", f"$.{k}", f"$.{k.upper()}_result"]))) for k in ("eeg", "mri")}
    return {
        "medication": F.coalesce(meds, empty), "seizure_type": types, "epilepsy_diagnosis": one(loose_first(alias_value(payload, DIAGNOSIS_PATHS))),
        "frequency": one(loose_first(alias_value(payload, FREQUENCY_PATHS))), "eeg": inv["eeg"], "mri": inv["mri"],
    }


def raw_keys(payload: Column, types: Column | None = None) -> Column:
    """array<(metric, key)> of a raw payload: a list of medications may mix objects and plain texts.

    `types` is the payload's list of seizure types where it has been read already.
    """
    items = F.from_json(F.get_json_object(payload, "$.medications"), "array<string>")

    def parts(item):
        m = F.from_json(item, _STRUCTURED_ITEM)
        name = F.when(F.ltrim(item).startswith("{"), F.coalesce(F.nullif(m["name"], F.lit("")), m["medication_name"])).otherwise(loose_first(item))
        return F.struct(
            N.medication_name(name).alias("n"), N.dose_value(m["dose"]).alias("d"),
            N.dose_unit(F.coalesce(F.nullif(m["dose_unit"], F.lit("")), m["unit"])).alias("u"), N.dosing_schedule(m["frequency"]).alias("s"))

    plain = F.transform(loose_items(alias_value(payload, MEDICATION_PATHS)), lambda v: F.struct(
        N.medication_name(v).alias("n"), F.lit("").alias("d"), F.lit("").alias("u"), F.lit("").alias("s")))
    meds = F.when(F.get_json_object(payload, "$.medications").startswith("["), F.transform(items, parts)).otherwise(plain)
    found = raw_values(payload)["seizure_type"] if types is None else types
    return F.concat(R.medication_keys(meds), R.seizure_type_keys(F.transform(found, N.seizure_type)))


def raw_metric_keys(payloads: DataFrame) -> DataFrame:
    """(system, document_id, metric, key) of raw payload values; empty tuples are dropped."""
    out = payloads.select("system", "document_id", F.inline(raw_keys(F.col("payload"))))
    no_parts = F.col("key").rlike(r" \|  \|  \| *$")
    return out.filter((F.col("key") != "") & ~((F.col("metric") == "medication_full") & (no_parts | F.col("key").startswith(" |"))))


def projection_deltas(rows: DataFrame) -> DataFrame:
    """Counts before and after projection per document (payload and record side by side)."""
    p, f = F.col("payload"), F.col("record.fields")
    raw = raw_values(p)

    def one(c):
        return F.filter(F.array(c), lambda x: text_of(x) != "")

    def stated(c):
        return F.filter(F.array(c), lambda x: (text_of(x) != "") & (x != "not_stated"))

    projected = {
        "medication": F.filter(F.transform(f["current_anti_seizure_medications"], lambda m: m["name"]), lambda x: text_of(x) != ""),
        "seizure_type": F.filter(F.transform(f["seizure_types"], lambda t: t["value"]), lambda x: text_of(x) != ""),
        "epilepsy_diagnosis": one(f["epilepsy_diagnosis"]["value"]), "frequency": one(f["current_seizure_frequency"]["value"]),
        "eeg": stated(f["eeg"]["result"]), "mri": stated(f["mri"]["result"]),
    }
    quotes = F.size(F.regexp_extract_all(p, F.lit(r'"(?:quote|support|evidence|source_quote)"\s*:\s*"\s*[^"\s]'), 0))
    s = computed_once(rows, rows.columns, **{f"_r_{k}": raw[k] for k in raw}, **{f"_p_{k}": projected[k] for k in raw})

    def size(c):
        return F.size(c).cast("long")

    total_raw = reduce(lambda a, b: a + b, [size(f"_r_{k}") for k in raw])
    total_proj = reduce(lambda a, b: a + b, [size(f"_p_{k}") for k in raw])
    ev = R.evidence_of(F.col("record"))
    return s.select(
        "system", "document_id", *[size(f"_r_{k}").alias(f"raw_{k}_count") for k in raw],
        *[size(f"_p_{k}").alias(f"projected_{k}_count") for k in raw],
        F.greatest(total_raw - total_proj, F.lit(0)).alias("dropped_field_count"),
        F.greatest(total_proj - total_raw, F.lit(0)).alias("added_field_count"),
        *[(F.col(f"_r_{k}") != F.col(f"_p_{k}")).alias(f"{k}_label_changed") for k in ("seizure_type", "epilepsy_diagnosis", "eeg", "mri")],
        size(F.regexp_extract_all(p, F.lit(r'"(?:quote|support|evidence|source_quote)"\s*:\s*"\s*[^"\s]'), 0)).alias("raw_quote_count"),
        size(F.filter(ev, lambda e: e["path"].startswith("$.fields"))).alias("projected_evidence_count"),
        (size("_p_medication") + size("_p_seizure_type") + F.least(size("_p_frequency"), F.lit(1))).alias("force_current_field_count"),
    )


def projection_summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    return deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum(c).alias(c) for c in ("dropped_field_count", "added_field_count", "raw_quote_count", "projected_evidence_count", "force_current_field_count")],
        F.count_if("seizure_type_label_changed").alias("seizure_label_changed_documents"),
        F.count_if("epilepsy_diagnosis_label_changed").alias("diagnosis_label_changed_documents"),
        F.count_if(F.col("eeg_label_changed") | F.col("mri_label_changed")).alias("investigation_label_changed_documents"))


# ---- candidates and verifier ------------------------------------------------------------


def apply_verifier(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keep candidates the verifier kept, with its non-null corrections.

    `candidates`: document_id, task, idx, value, ...; `decisions`: document_id, task, idx, decision and the
    same value columns. Documents without any decision keep all candidates.
    """
    values = [c for c in candidates.columns if c not in ("document_id", "task", "idx")]
    kept = decisions.filter(F.col("decision") == "keep").select("document_id", "task", "idx", *[F.col(v).alias(f"_{v}") for v in values])
    judged = candidates.join(kept, ["document_id", "task", "idx"]).select(
        "document_id", "task", "idx", *[F.coalesce(F.col(f"_{v}"), F.col(v)).alias(v) for v in values])
    free = candidates.join(decisions.select("document_id").distinct(), "document_id", "left_anti")
    return judged.unionByName(free)


# fixed values: tasks in the order of their events
TASK_PREFIX = {"medication_full_tuple": "ev_s4_med_", "medication_names": "ev_s4_med_", "seizure_type": "ev_s4_type_",
               "seizure_frequency": "ev_s4_freq_", "diagnosis_type": "ev_s4_dx_"}


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One event row per merged candidate: full medication tuples beat names, first frequency and diagnosis only."""
    t = F.col("task")
    has_full = candidates.filter(t == "medication_full_tuple").select("document_id").distinct().withColumn("_full", F.lit(True))
    joined = candidates.join(has_full, "document_id", "left").filter(t.isin(list(TASK_PREFIX)))
    joined = joined.filter(~((t == "medication_names") & F.coalesce("_full", F.lit(False)))).drop("_full")
    w = W.partitionBy("document_id", "task").orderBy("idx")
    numbered = joined.withColumn("n", F.row_number().over(w)).filter((text_of(F.col("value")) != ""))
    numbered = numbered.filter(~t.isin("seizure_frequency", "diagnosis_type") | (F.col("n") == 1))
    prefix = F.create_map(*[F.lit(v) for p in TASK_PREFIX.items() for v in p])
    category = (F.when(t.startswith("medication"), "medication").when(t == "seizure_type", "seizure_type")
                .when(t == "seizure_frequency", "seizure_frequency").otherwise("diagnosis"))
    return numbered.withColumn("id", F.concat(F.try_element_at(prefix, t), F.col("n").cast("string"))).withColumn("category", category)


# ---- merged records ---------------------------------------------------------------------

#: What a candidate may hold besides document_id, task, idx and value; columns that aren't there are null.
CANDIDATE_PARTS = {"dose": "string", "dose_unit": "string", "frequency": "string", "temporality": "string", "temporal_scope": "string", "seizure_type": "string",
                   "quote": "string", "sentence_id": "string", "char_start": "int", "char_end": "int"}


def _shaped(schema, **own: Column) -> Column:
    """A struct of the schema with the given leaves, the others null."""
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def merged_records(documents: DataFrame, candidates: DataFrame, pipeline_id: str, model: str | None = None) -> DataFrame:
    """document_id, record: the canonical record of every document from its merged candidates (see `merge_candidates`).

    One aggregation per document puts the candidates' fields and events together, each field linked to its event. Medications of
    one name share the parts of the last of them. A value without a quote is uncertain instead of present. Documents without
    candidates get the empty record; candidates of other documents are left out.
    """
    rows = candidates.select("document_id", "task", "idx", "value", *[(F.col(c) if c in candidates.columns else F.lit(None)).cast(t).alias(c) for c, t in CANDIDATE_PARTS.items()])
    merged = merge_candidates(rows)
    same_name = W.partitionBy("document_id", "task", "value").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_med = F.col("category") == "medication"
    parts = [c for c in CANDIDATE_PARTS]
    last = F.last(F.struct(*parts)).over(same_name)
    merged = merged.withColumn("_last", F.when(is_med, last).otherwise(F.struct(*parts))).select("document_id", "task", "n", "id", "category", "value", "_last.*")

    quoted = text_of(F.col("quote")) != ""
    one = _shaped(EVIDENCE, quote=F.col("quote"), sentence_id=F.col("sentence_id"), char_start=F.col("char_start"), char_end=F.col("char_end"))
    link = {"missingness": F.when(quoted, "present").otherwise("uncertain"), "evidence": F.when(quoted, F.array(one)), "evidence_event_ids": F.array("id")}
    said = R.recoded_temporality(F.nullif(F.col("temporality"), F.lit("")))
    usual = F.when(F.col("category") == "seizure_type", "uncertain").otherwise("current")
    time = F.when(is_med, "current").otherwise(F.coalesce(said, usual))
    med = _shaped(MEDICATION, name=F.col("value"), dose=F.col("dose"), dose_unit=F.col("dose_unit"), frequency=F.col("frequency"), status=F.lit("current"), temporality=F.lit("current"), **link)
    scalar = _shaped(SCALAR, value=F.col("value"), temporality=time, **link)
    rate = _shaped(FREQUENCY, value=F.col("value"), temporality=time, temporal_scope=F.col("temporal_scope"), seizure_type=F.col("seizure_type"), **link)
    is_rate = F.col("category") == "seizure_frequency"
    event = _shaped(EVENT, id=F.col("id"), category=F.col("category"), temporality=F.when(is_rate, "current").otherwise(time), status=F.when(is_med, "current"), value=F.col("value"),
                    medication_name=F.when(is_med, F.col("value")), dose=F.when(is_med, F.col("dose")), dose_unit=F.when(is_med, F.col("dose_unit")), frequency=F.when(is_med, F.col("frequency")),
                    temporal_scope=F.when(is_rate, F.col("temporal_scope")), seizure_type=F.when(is_rate, F.col("seizure_type")), evidence=F.when(quoted, one).otherwise(_shaped(EVIDENCE, quote=F.lit(""))))
    place = F.array_position(F.array(*[F.lit(t) for t in TASK_PREFIX]), F.col("task"))

    def listed(kind: str, made: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("category") == kind, F.struct(F.col("n"), made.alias("x"))))), lambda p: p["x"])

    put = merged.withColumn("_event", event).groupBy("document_id").agg(
        listed("medication", med).alias("_meds"), listed("seizure_type", scalar).alias("_types"), F.min_by(F.when(is_rate, rate), F.when(is_rate, F.col("n"))).alias("_rate"),
        F.min_by(F.when(F.col("category") == "diagnosis", scalar), F.when(F.col("category") == "diagnosis", F.col("n"))).alias("_dx"),
        F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("n"), F.col("_event").alias("x")))), lambda p: p["x"]).alias("_events"))
    every = documents.select("document_id").distinct().join(put, "document_id", "left")
    nothing = F.lit(None).cast("string")
    empty = {"current_seizure_frequency": R.frequency_field(nothing, nothing), "epilepsy_diagnosis": R.scalar_field(nothing), "eeg": R.investigation_field(nothing), "mri": R.investigation_field(nothing)}
    schema = {f.name: f.dataType for f in FIELDS.fields}
    none = {n: F.array().cast(schema[n]) for n in ("current_anti_seizure_medications", "previous_anti_seizure_medications", "seizure_types")}
    own = {"current_anti_seizure_medications": "_meds", "seizure_types": "_types", "current_seizure_frequency": "_rate", "epilepsy_diagnosis": "_dx"}
    fields = [F.coalesce(*([F.col(own[n])] if n in own else []), (none | empty)[n].cast(t)).alias(n) for n, t in schema.items()]
    metadata = _shaped(METADATA, model=F.lit(model), format=F.lit("json"), input_tokens=F.lit(0.0), output_tokens=F.lit(0.0), repair_attempted=F.lit(False), repair_succeeded=F.lit(False))
    record = F.struct(F.col("document_id").cast("string").alias("document_id"), F.lit(pipeline_id).alias("pipeline_id"), F.struct(*fields).alias("fields"),
                      F.coalesce("_events", F.array().cast(CANONICAL["events"].dataType)).alias("events"), metadata.alias("metadata"))
    return every.select("document_id", record.cast(CANONICAL).alias("record"))
