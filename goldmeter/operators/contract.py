"""Provider output of any shape as canonical records: JSON trees are read as VARIANT, reshaped and recoded, and typed last.

Nothing is lost before it has been looked at: a single evidence object becomes a list, `text` becomes `quote`, numbers become
text where the contract has text, an event's object value gives its parts, and results that stand beside `fields` are taken in.
Whether a key is there, null or empty makes a difference and is kept apart until the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldmeter.functions.text import let
from goldmeter.operators.records import INVESTIGATIONS, MED_LISTS, recoded_result, recoded_status, recoded_temporality, suffixed_ids
from goldmeter.sources.schemas import CANONICAL, EVENT, EVIDENCE, EVIDENCE_LIST, FREQUENCY, INVESTIGATION, MEDICATION, METADATA, SCALAR

# fixed values: parts of a medication that an event's object value may hold
VALUE_PARTS = ["medication_name", "dose", "dose_unit", "frequency"]
# fixed values: keys that make an object a field, or an investigation
FIELD_KEYS = ["missingness", "temporality", "evidence", "evidence_event_ids"]
INVESTIGATION_KEYS = ["status", "result", "missingness", "temporality", "evidence_event_ids"]


def child(v: Column, key: str) -> Column:
    """The value under a key as VARIANT; NULL if there is none. A JSON null is a value."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def leaf(v: Column, key: str) -> Column:
    """The value under a key as text, NULL for a JSON null."""
    return F.try_variant_get(v, f"$.{key}", "string")


def items(v: Column, key: str) -> Column:
    """The elements of the list under a key; NULL if no list is there."""
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def has(v: Column, key: str) -> Column:
    return child(v, key).isNotNull()


def has_all(v: Column, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & has(v, k)
    return out


def _typed(v: Column, schema, **own: Column) -> Column:
    """A struct of the schema's leaves: those given, else the text, number or flag under the same name."""
    kinds = {"string": "string", "int": "int", "double": "double", "boolean": "boolean"}
    cols = [own[f.name] if f.name in own else F.try_variant_get(v, f"$.{f.name}", kinds[f.dataType.simpleString()]) for f in schema.fields]
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, schema.fields)])


def _quoted(v: Column) -> Column:
    """One evidence object with `text` read as `quote` where no quote key is there."""
    return F.when(is_object(v), _typed(v, EVIDENCE, quote=F.when(has(v, "quote"), leaf(v, "quote")).otherwise(leaf(v, "text"))))


def field_evidence(v: Column) -> Column:
    """Evidence of a field: a list as it is, a single object as a list of one."""
    e = child(v, "evidence")
    listed = F.transform(items(v, "evidence"), lambda x: _typed(x, EVIDENCE))
    return F.when(is_list(e), listed).when(is_object(e), F.array(_quoted(e))).otherwise(F.lit(None).cast(EVIDENCE_LIST))


def event_evidence(v: Column) -> Column:
    """Evidence of an event: the object, or the first of a list."""
    return F.when(is_list(child(v, "evidence")), _quoted(F.get(items(v, "evidence"), F.lit(0)))).otherwise(_quoted(child(v, "evidence")))


def _absent(v: Column) -> Column:
    """No evidence, an empty list or an empty value; an object counts as evidence, whatever it holds."""
    e = child(v, "evidence")
    empty = F.when(is_list(e), F.size(items(v, "evidence")) == 0).otherwise(F.to_json(e).isin('""', "0", "false"))
    return e.isNull() | F.is_variant_null(e) | F.coalesce(empty, F.lit(False))


def _field(v: Column, schema) -> Column:
    """A field object recoded; what isn't an object is no field."""
    own = {"evidence": field_evidence(v), "evidence_event_ids": F.try_variant_get(v, "$.evidence_event_ids", "array<string>"), "temporality": recoded_temporality(leaf(v, "temporality"))}
    own["missingness"] = F.when((leaf(v, "missingness") == "present") & has_all(v, FIELD_KEYS) & _absent(v), "uncertain").otherwise(leaf(v, "missingness"))
    if "status" in schema.fieldNames():
        status = recoded_status(leaf(v, "status"))
        own["status"] = F.when(has_all(v, INVESTIGATION_KEYS) & (status == "planned"), "requested").otherwise(status)
    if "result" in schema.fieldNames():
        own["result"] = recoded_result(leaf(v, "result"))
    return F.when(is_object(v), _typed(v, schema, **own))


def _first_text(*texts: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _event(v: Column) -> Column:
    """An event recoded: parts of an object value fill those that are missing, and the value is text."""
    like = has(v, "id") & has(v, "category")
    value = child(v, "value")
    nested = like & is_object(value)
    own = {k: F.when(nested, F.coalesce(leaf(v, k), leaf(value, k))).otherwise(leaf(v, k)) for k in VALUE_PARTS}
    result = recoded_result(leaf(v, "result"))
    of_object = _first_text(own["medication_name"], leaf(value, "value"), F.to_json(value))
    own["value"] = F.when(nested, of_object).when(like & value.isNull(), _first_text(own["medication_name"], result)).otherwise(leaf(v, "value"))
    own |= {"result": result, "temporality": recoded_temporality(leaf(v, "temporality")), "status": recoded_status(leaf(v, "status"))}
    kind = leaf(v, "investigation_type")
    own |= {"investigation_type": F.when(kind.isin("EEG", "MRI"), kind), "evidence": F.when(like, event_evidence(v)).otherwise(F.get(field_evidence(v), F.lit(0)))}
    return _typed(v, EVENT, **own)


def _record(v: Column, document_id: Column, pipeline_id: Column) -> Column:
    fields = child(v, "fields")
    made = []
    for name in MED_LISTS:
        made.append(F.transform(items(fields, name), lambda x: _field(x, MEDICATION)).alias(name))
    made.append(_field(child(fields, "current_seizure_frequency"), FREQUENCY).alias("current_seizure_frequency"))
    made.append(F.transform(items(fields, "seizure_types"), lambda x: _field(x, SCALAR)).alias("seizure_types"))
    for name, schema in [(n, INVESTIGATION) for n in INVESTIGATIONS] + [("epilepsy_diagnosis", SCALAR)]:
        inside = _field(child(fields, name), schema)
        made.append(F.when(has(fields, name), inside).otherwise(_field(child(v, name), schema)).alias(name))

    def renamed(events):
        return F.zip_with(events, suffixed_ids(F.transform(events, lambda e: e["id"])), lambda e, i: e.withField("id", i))

    events = let(F.transform(items(v, "events"), _event), renamed)
    meta = child(v, "metadata")
    tokens = {k: F.coalesce(F.try_variant_get(meta, f"$.{k}", "double"), F.lit(0.0)) for k in ("input_tokens", "output_tokens")}
    return F.struct(
        F.coalesce(F.nullif(leaf(v, "document_id"), F.lit("")), document_id).alias("document_id"),
        F.coalesce(F.nullif(leaf(v, "pipeline_id"), F.lit("")), pipeline_id).alias("pipeline_id"),
        F.when(is_object(fields), F.struct(*made)).alias("fields"), events.alias("events"), _typed(meta, METADATA, **tokens).alias("metadata"))


def recode_tree(payload: Column, document_id: Column | None = None, pipeline_id: Column | None = None) -> Column:
    """The canonical record that a JSON payload means, NULL if the payload is no JSON object.

    `document_id` and `pipeline_id` stand in where the payload has none. Repeated event ids get _2, _3, ... in order. A payload
    with a repeated key is no JSON object here. Line breaks inside strings count as blanks.
    """
    none = F.lit(None).cast("string")
    tree = F.try_parse_json(F.translate(payload, "\n\r\t", "   "))

    def made(v):
        return F.when(is_object(v), _record(v, none if document_id is None else document_id, none if pipeline_id is None else pipeline_id))

    return let(tree, made).cast(CANONICAL)
