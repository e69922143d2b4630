"""Canonical records: flattening, constraint checks, shaping and recoding.

A record is one nested struct per (system, document_id). Everything that only needs the
record runs inside the row; rows are exploded late and carry small columns only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions import normalize as N
from goldmeter.functions import vocabulary as V
from goldmeter.functions.frequency import frequency_parts
from goldmeter.functions.text import let, norm_label, norm_text, norm_value, text_of
from goldmeter.operators.passages import quote_is_valid

MED_LISTS = ["current_anti_seizure_medications", "previous_anti_seizure_medications"]
SCALARS = ["current_seizure_frequency", "epilepsy_diagnosis"]
INVESTIGATIONS = ["eeg", "mri"]


def _claim(path: Column, category: str, value: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(category).alias("category"), value.alias("value"))


def _fill(array: Column, like: str) -> Column:
    return F.coalesce(array, F.array().cast(like))


_CLAIMS = "array<struct<path:string,category:string,value:string>>"


def claims_of(record: Column) -> Column:
    """Present values that need evidence, as array of (path, category, value) in field order."""
    f = record["fields"]

    def listed(name: str, leaf: str, category: str) -> Column:
        made = F.transform(f[name], lambda x, i: F.struct(
            F.concat(F.lit(f"fields.{name}["), i.cast("string"), F.lit(f"].{leaf}")).alias("path"),
            F.lit(category).alias("category"),
            F.when((x["missingness"] == "present") & (x[leaf] != ""), x[leaf]).alias("value"),
        ))
        return _fill(F.filter(made, lambda c: c["value"].isNotNull()), _CLAIMS)

    def single(name: str, leaves: list[str], category: str) -> Column:
        made = []
        for leaf in leaves:
            value = f[name][leaf]
            usable = (f[name]["missingness"] == "present") & (value != "")
            if category == "investigation":
                usable = usable & ~F.lower(value).isin("not_stated", "", "null", "none")
            made.append(_claim(F.lit(f"fields.{name}.{leaf}"), category, F.when(usable, value)))
        return F.filter(F.array(*made), lambda c: c["value"].isNotNull())

    return F.concat(
        listed("current_anti_seizure_medications", "name", "medication"),
        listed("previous_anti_seizure_medications", "name", "medication"),
        listed("seizure_types", "value", "seizure_type"), single("epilepsy_diagnosis", ["value"], "diagnosis"),
        single("current_seizure_frequency", ["value"], "frequency"),
        single("eeg", ["status", "result"], "investigation"), single("mri", ["status", "result"], "investigation"),
    )


def flatten_claims(records: DataFrame) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    return records.select(*keep, F.posexplode(claims_of(F.col("record"))).alias("claim_no", "c")).select(
        *keep, "claim_no", "c.path", "c.category", "c.value")


_EVIDENCE = "array<struct<path:string,quote:string>>"


def evidence_of(record: Column) -> Column:
    """Every quoted evidence object with its path: fields first, then events."""
    f = record["fields"]

    def quotes(path: Column, evidence: Column) -> Column:
        made = F.transform(evidence, lambda e, i: F.struct(
            F.concat(path, F.lit(".evidence["), i.cast("string"), F.lit("]")).alias("path"), e["quote"].alias("quote")))
        return _fill(F.filter(made, lambda e: e["quote"].isNotNull()), _EVIDENCE)

    def listed(name: str) -> Column:
        return _fill(F.flatten(F.transform(f[name], lambda x, i: quotes(
            F.concat(F.lit(f"$.fields.{name}["), i.cast("string"), F.lit("]")), x["evidence"]))), _EVIDENCE)

    singles = [quotes(F.lit(f"$.fields.{n}"), f[n]["evidence"]) for n in [*SCALARS, *INVESTIGATIONS]]
    events = F.filter(F.transform(record["events"], lambda e, i: F.struct(
        F.concat(F.lit("$.events["), i.cast("string"), F.lit("].evidence")).alias("path"),
        e["evidence"]["quote"].alias("quote"))), lambda e: e["quote"].isNotNull())
    return F.concat(*[listed(n) for n in [*MED_LISTS, "seizure_types"]], *singles, _fill(events, _EVIDENCE))


def quotes_of(record: Column) -> Column:
    """The quotes of `evidence_of` without their paths."""
    f = record["fields"]
    texts = [F.flatten(F.array_compact(f[n]["evidence"]))["quote"] for n in [*MED_LISTS, "seizure_types"]]
    texts += [f[n]["evidence"]["quote"] for n in [*SCALARS, *INVESTIGATIONS]] + [record["events"]["evidence"]["quote"]]
    return F.array_compact(F.concat(*[_fill(c, "array<string>") for c in texts]))


def flatten_evidence(records: DataFrame) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    return records.select(*keep, F.inline(evidence_of(F.col("record"))))


_FIELD = "array<struct<path:string,missingness:string,with_evidence:boolean>>"


def fields_of(record: Column) -> Column:
    """All field objects with path, missingness and an evidence flag."""
    f = record["fields"]

    def row(path: Column, x: Column) -> Column:
        return F.struct(path.alias("path"), x["missingness"].alias("missingness"),
                        (F.when(x["evidence"].isNull(), 0).otherwise(F.size(x["evidence"])) > 0).alias("with_evidence"))

    def listed(n: str) -> Column:
        def of(x, i):
            return row(F.concat(F.lit(f"$.fields.{n}["), i.cast("string"), F.lit("]")), x)

        return _fill(F.transform(f[n], of), _FIELD)

    lists = [listed(n) for n in [*MED_LISTS, "seizure_types"]]
    return F.concat(*lists, F.array(*[row(F.lit(f"$.fields.{n}"), f[n]) for n in [*SCALARS, *INVESTIGATIONS]]))


def field_flags(record: Column) -> Column:
    """`fields_of` without the paths."""
    f = record["fields"]

    def row(x: Column) -> Column:
        return F.struct(x["missingness"].alias("missingness"), (F.when(x["evidence"].isNull(), 0).otherwise(F.size(x["evidence"])) > 0).alias("with_evidence"))

    lists = [_fill(F.transform(f[n], row), "array<struct<missingness:string,with_evidence:boolean>>") for n in [*MED_LISTS, "seizure_types"]]
    return F.concat(*lists, F.array(*[row(f[n]) for n in [*SCALARS, *INVESTIGATIONS]]))


def flatten_present_fields(records: DataFrame) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    return records.select(*keep, F.inline(fields_of(F.col("record")))).filter(F.col("missingness") == "present")


def _bad_evidence(missingness: Column, evidence: Column, required: bool) -> Column:
    absent = F.when(evidence.isNull(), 0).otherwise(F.size(evidence)) == 0
    blank = F.coalesce(F.exists(evidence, lambda e: F.trim(text_of(e["quote"])) == ""), F.lit(False))
    return ((missingness == "present") & absent & F.lit(required)) | blank


def _not_in(c: Column, allowed: list[str], null_ok: bool = False) -> Column:
    return ~F.coalesce(c.isin(allowed), F.lit(null_ok))


def _rules(record: Column, required: bool) -> list[tuple[list[str], Column | None, object]]:
    """Every rule group as (names, list or None, checks): checks of a list are functions of its element, others are columns."""
    f = record["fields"]

    def med_bad(x):
        return _not_in(x["status"], V.MEDICATION_STATUS), _not_in(x["missingness"], V.MISSINGNESS), \
            _not_in(x["temporality"], V.TEMPORALITY), _bad_evidence(x["missingness"], x["evidence"], required)

    def scalar_bad(x):
        return _not_in(x["missingness"], V.MISSINGNESS), _not_in(x["temporality"], V.TEMPORALITY), \
            _bad_evidence(x["missingness"], x["evidence"], required), x["evidence_event_ids"].isNull()

    def inv_bad(x):
        return _not_in(x["status"], V.INVESTIGATION_STATUS), _not_in(x["result"], V.INVESTIGATION_RESULT, True), \
            _not_in(x["missingness"], V.MISSINGNESS), _not_in(x["temporality"], V.TEMPORALITY), \
            _bad_evidence(x["missingness"], x["evidence"], required)

    def event_bad(x):
        return F.trim(text_of(x["id"])) == "", _not_in(x["category"], V.EVENT_CATEGORY), \
            _not_in(x["temporality"], V.TEMPORALITY), _not_in(x["status"], V.EVENT_STATUS, True), \
            F.trim(text_of(x["evidence"]["quote"])) == ""

    med = ["status", "missingness", "temporality", "evidence"]
    scalar = ["missingness", "temporality", "evidence", "evidence_event_ids"]
    inv = ["status", "result", "missingness", "temporality", "evidence"]
    event = ["id", "category", "temporality", "status", "evidence"]

    def single(name, parts, bad):
        return [f"missing.{name}", *[f"{name}.{p}" for p in parts]], None, [f[name].isNull(), *[f[name].isNotNull() & b for b in bad(f[name])]]

    keys = ("document_id", "pipeline_id", "fields", "events", "metadata")
    groups: list = [([f"missing.{key}" for key in keys], None, [record[key].isNull() for key in keys])]
    for name in MED_LISTS:
        groups += [([f"missing.{name}"], None, [f[name].isNull()]), ([f"{name}.{p}" for p in med], f[name], med_bad)]
    groups.append(([f"seizure_types.{p}" for p in scalar], f["seizure_types"], scalar_bad))
    groups += [single(name, scalar, scalar_bad) for name in SCALARS] + [single(name, inv, inv_bad) for name in INVESTIGATIONS]
    groups.append(([f"events.{p}" for p in event], record["events"], event_bad))
    ids = F.transform(record["events"], lambda e: e["id"])
    groups.append((["events.duplicate_id"], None, [F.size(F.array_distinct(ids)) < F.size(ids)]))
    return groups


def violations(record: Column, required: bool = True) -> Column:
    """Names of violated record rules (empty array = valid). One rule per enumeration, key and quote contract."""
    def part_of(check, i):
        return lambda x: check(x)[i]

    rules: list[Column] = []
    for names, listed, checks in _rules(record, required):
        for i, name in enumerate(names):
            broken = checks[i] if listed is None else F.exists(listed, part_of(checks, i))
            rules.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def is_valid(record: Column, required: bool = True) -> Column:
    """Does no rule of `violations` break? Each list is looked through once."""
    def any_part(check):
        return lambda x: reduce(lambda a, b: a | b, check(x))

    broken = [c for _, listed, checks in _rules(record, required) for c in (checks if listed is None else [F.exists(listed, any_part(checks))])]
    return ~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in broken])


def check_records(records: DataFrame, required: bool = True) -> DataFrame:
    keep = [c for c in records.columns if c != "record"]
    return records.select(*keep, violations(F.col("record"), required).alias("violations")).withColumn(
        "valid", F.size("violations") == 0)


def duplicate_event_ids(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once in a document."""
    return events.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_expectations(expectations: DataFrame, values: DataFrame) -> DataFrame:
    """Expected (document_id, path, expected) against flattened (document_id, path, value)."""
    def fold(c):
        return F.lower(norm_text(c))

    return expectations.join(values.select("document_id", "path", "value"), ["document_id", "path"], "left").withColumn(
        "met", F.col("value").isNotNull() & (fold(F.col("expected")) == fold(F.col("value"))))


# ---- recoding provider output to the contract ------------------------------------------

# fixed values: provider words -> contract words
TEMPORALITY_ALIASES = {"not_stated": "uncertain", "previous": "historical", "recent": "current"}


def recoded_temporality(c: Column) -> Column:
    return reduce(lambda acc, kv: F.when(c == kv[0], kv[1]).otherwise(acc), TEMPORALITY_ALIASES.items(), c)


def recoded_status(c: Column, investigation: bool = False) -> Column:
    out = F.when(c == "historical", "previous").otherwise(c)
    return F.when(out == "planned", "requested").otherwise(out) if investigation else out


def recoded_result(c: Column) -> Column:
    return F.when(c == "negative", "normal").otherwise(c)


def _downgrade(missingness: Column, evidence: Column) -> Column:
    absent = F.when(evidence.isNull(), 0).otherwise(F.size(evidence)) == 0
    return F.when((missingness == "present") & absent, "uncertain").otherwise(missingness)


def suffixed_ids(ids: Column) -> Column:
    """Repeated ids get _2, _3, ... in order of appearance."""
    def rename(all_ids):
        def one(x, i):
            earlier = F.size(F.filter(F.slice(all_ids, F.lit(1), i), lambda y: y == x))
            return F.when(x.isNotNull() & (earlier > 0), F.concat(x, F.lit("_"), (earlier + 1).cast("string"))).otherwise(x)

        return F.transform(all_ids, one)

    return let(ids, rename)


def recode_record(record: Column) -> Column:
    """The record with every provider alias replaced by its contract word."""
    f = record["fields"]

    def scalar(x):
        return x.withField("temporality", recoded_temporality(x["temporality"])).withField(
            "missingness", _downgrade(x["missingness"], x["evidence"]))

    def med(x):
        return scalar(x).withField("status", recoded_status(x["status"]))

    def inv(x):
        return scalar(x).withField("status", recoded_status(x["status"], True)).withField(
            "result", recoded_result(x["result"]))

    ids = suffixed_ids(F.transform(record["events"], lambda e: e["id"]))

    def event(e, new_id):
        return (
            e.withField("id", new_id).withField("temporality", recoded_temporality(e["temporality"]))
            .withField("status", recoded_status(e["status"])).withField("result", recoded_result(e["result"]))
            .withField("investigation_type", F.when(e["investigation_type"].isin("EEG", "MRI"), e["investigation_type"]))
            .withField("value", F.coalesce(e["value"], e["medication_name"], e["result"]))
        )

    def kept(x, made):
        return F.when(x.isNotNull(), made)

    fields = f
    for n in MED_LISTS:
        fields = fields.withField(n, F.transform(f[n], med))
    fields = fields.withField("seizure_types", F.transform(f["seizure_types"], scalar))
    for n in SCALARS:
        fields = fields.withField(n, kept(f[n], scalar(f[n])))
    for n in INVESTIGATIONS:
        fields = fields.withField(n, kept(f[n], inv(f[n])))
    meta = record["metadata"]
    for k in ("input_tokens", "output_tokens"):
        meta = meta.withField(k, F.coalesce(record["metadata"][k], F.lit(0.0)))
    return record.withField("fields", F.when(f.isNotNull(), fields)).withField(
        "events", F.zip_with(record["events"], ids, event)).withField("metadata", meta)


# ---- building fields --------------------------------------------------------------------

_NO_EVIDENCE = "array<struct<quote:string,sentence_id:string,char_start:int,char_end:int>>"


def no_evidence() -> Column:
    return F.array().cast(_NO_EVIDENCE)


def scalar_field(value: Column, temporality: str = "current", evidence: Column | None = None) -> Column:
    there = text_of(value) != ""
    ev = no_evidence() if evidence is None else evidence
    return F.struct(
        F.when(there, value).alias("value"), F.when(there, "present").otherwise("not_stated").alias("missingness"),
        F.when(there, temporality).otherwise("uncertain").alias("temporality"),
        F.when(there, ev).alias("evidence"), F.array().cast("array<string>").alias("evidence_event_ids"),
    )


def frequency_field(value: Column, seizure_type: Column) -> Column:
    base = scalar_field(value)
    return F.struct(
        base["value"].alias("value"), base["missingness"].alias("missingness"), base["temporality"].alias("temporality"),
        F.when(text_of(value) != "", "current").alias("temporal_scope"), seizure_type.alias("seizure_type"),
        base["evidence"].alias("evidence"), base["evidence_event_ids"].alias("evidence_event_ids"),
    )


def investigation_field(value: Column) -> Column:
    def made(canonical):
        result = F.when(canonical.isin("normal", "abnormal", "uncertain"), canonical).otherwise("not_stated")
        done = canonical.isin("normal", "abnormal")
        return F.struct(
            F.when(done, "completed").otherwise("not_stated").alias("status"), result.alias("result"),
            F.when(done, "present").otherwise("not_stated").alias("missingness"),
            F.when(done, "completed").otherwise("uncertain").alias("temporality"),
            F.when(done, no_evidence()).alias("evidence"), F.array().cast("array<string>").alias("evidence_event_ids"),
        )

    return let(N.investigation_result(value), made)


DOSE_IN_TEXT = r"(?iU)\b(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml)\b"
SCHEDULE_IN_TEXT = (
    r"(?iU)\b(once daily|twice daily|three times daily|four times daily|bd|od|tds|qds|daily|nocte)\b"
)


def medication_from_text(text: Column) -> Column:
    """(name, dose, dose_unit, frequency) read from one line of text."""
    hit = F.regexp_substr(text, F.lit(DOSE_IN_TEXT))
    before = F.when(hit.isNotNull(), F.btrim(F.get(F.split(text, DOSE_IN_TEXT, 2), F.lit(0)), F.lit(" ,-"))).otherwise(text)
    name = F.btrim(F.substring_index(before, "(", 1), F.lit(" ,-"))

    def nonblank(c):
        return F.when(c != "", c)

    return F.struct(
        F.when(name == "", text).otherwise(name).alias("name"), nonblank(F.regexp_extract(text, DOSE_IN_TEXT, 1)).alias("dose"),
        nonblank(F.regexp_extract(text, DOSE_IN_TEXT, 2)).alias("dose_unit"),
        nonblank(F.regexp_extract(text, SCHEDULE_IN_TEXT, 1)).alias("frequency"),
    )


def medication_field(parts: Column, evidence: Column | None = None) -> Column:
    return F.struct(
        *[parts[k].alias(k) for k in ("name", "dose", "dose_unit", "frequency")], F.lit("current").alias("status"),
        F.lit("present").alias("missingness"), F.lit("current").alias("temporality"),
        (no_evidence() if evidence is None else evidence).alias("evidence"),
        F.array().cast("array<string>").alias("evidence_event_ids"),
    )


def merge_frequency(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace each record's frequency by another system's label (document_id, label, quote)."""
    joined = records.join(labels.select("document_id", "label", "quote"), "document_id", "left")
    said = norm_label(F.col("label"))
    absent = said.isin(V.NO_REFERENCE_LABEL, "")
    quoted = F.array(F.struct(
        F.trim("quote").alias("quote"), F.lit(None).cast("string").alias("sentence_id"),
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end")))
    evidence = F.when(~absent & (text_of(F.col("quote")) != ""), quoted).otherwise(no_evidence())
    scope = F.when(~absent, "current")
    field = F.struct(
        F.when(~absent, said).alias("value"), F.when(absent, "not_stated").otherwise("present").alias("missingness"),
        scope.alias("temporality"), scope.alias("temporal_scope"),
        F.col("record.fields.current_seizure_frequency.seizure_type").alias("seizure_type"), evidence.alias("evidence"),
        F.array().cast("array<string>").alias("evidence_event_ids"),
    )
    return joined.withColumn("record", F.col("record").withField("fields.current_seizure_frequency", field)).drop("label", "quote")


def populated_fields(record: Column) -> Column:
    """Number of populated fields, the score of a best-of-n pick."""
    f = record["fields"]

    def n(array):
        return F.when(array.isNull(), 0).otherwise(F.size(array))

    def one(flag):
        return F.coalesce(flag, F.lit(False)).cast("int")

    return (
        n(f["current_anti_seizure_medications"]) + n(f["seizure_types"])
        + one(f["epilepsy_diagnosis"]["value"] != "") + one(f["current_seizure_frequency"]["value"] != "")
        + one(f["eeg"]["result"].isin("normal", "abnormal")) + one(f["mri"]["result"].isin("normal", "abnormal"))
    )


def best_of(candidates: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Row with the highest score per key; the earliest wins ties."""
    rest = [c for c in candidates.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order)))
    return candidates.groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p.*")


# ---- keys for scoring -------------------------------------------------------------------


def metric_keys(record: Column, medications: bool = True) -> Column:
    """array<(metric, key)> of all set-scored predictions of a record; without `medications` of its seizure types only."""
    f = record["fields"]
    types = seizure_type_keys(F.transform(f["seizure_types"], lambda s: N.seizure_type(s["value"])))
    if not medications:
        return types
    meds = F.transform(f["current_anti_seizure_medications"], lambda m: F.struct(
        N.medication_name(m["name"]).alias("n"), N.dose_value(m["dose"]).alias("d"),
        N.dose_unit(m["dose_unit"]).alias("u"), N.dosing_schedule(m["frequency"]).alias("s")))
    return F.concat(medication_keys(meds), types)


_KEYS = "array<struct<metric:string,key:string>>"


def medication_keys(meds: Column) -> Column:
    """Keys of normalised (n, d, u, s) medications under the five medication metrics."""
    def key(metric, *parts):
        return F.struct(F.lit(metric).alias("metric"), F.concat_ws(" | ", *parts).alias("key"))

    def of(m):
        made = [key("medication_name", m["n"]), key("medication_full", m["n"], m["d"], m["u"], m["s"])]
        for metric, c in (("dose", "d"), ("dose_unit", "u"), ("frequency", "s")):
            made.append(F.when((m["n"] != "") & (m[c] != ""), key(f"medication_{metric}", m["n"], m[c])))
        return F.filter(F.array(*made), lambda k: k.isNotNull())

    return _fill(F.flatten(F.transform(meds, of)), _KEYS)


def seizure_type_keys(types: Column) -> Column:
    def of(t):
        made = F.array(
            F.struct(F.lit("seizure_type").alias("metric"), t.alias("key")),
            F.struct(F.lit("seizure_type_collapsed").alias("metric"), N.coarse_seizure_of(t).alias("key")),
        )
        return F.filter(made, lambda k: k["key"] != "")

    return _fill(F.flatten(F.transform(types, of)), _KEYS)


def scalar_predictions(record: Column) -> dict[str, Column]:
    """Normalised scalar predictions of a record by column name."""
    f = record["fields"]
    freq = f["current_seizure_frequency"]
    dx = f["epilepsy_diagnosis"]["value"]
    return {
        "p_frequency": norm_value(freq["value"]),
        "p_parts": frequency_parts(freq["value"]),
        "p_frequency_type": N.seizure_type(freq["seizure_type"]),
        "p_frequency_missingness": freq["missingness"],
        "p_frequency_temporality": freq["temporality"],
        "p_eeg": N.investigation_result(f["eeg"]["result"]),
        "p_mri": N.investigation_result(f["mri"]["result"]),
        "p_diagnosis": N.diagnosis(dx),
        "p_diagnosis_coarse": N.coarse_diagnosis(dx),
    }


def temporal_checks(record: Column) -> Column:
    """array<boolean>: is each present claim's time status acceptable?"""
    f = record["fields"]
    meds = F.transform(f["current_anti_seizure_medications"],
                       lambda m: F.coalesce((m["temporality"] == "current") & (m["status"] == "current"), F.lit(False)))
    singles = [F.when(f[n]["missingness"] == "present",
                      F.coalesce(f[n]["temporality"].isin("current", "uncertain"), F.lit(False))) for n in SCALARS]
    singles += [F.when(f[n]["missingness"] == "present", F.coalesce(f[n]["status"] == "completed", F.lit(False)))
                for n in INVESTIGATIONS]
    return F.filter(F.concat(_fill(meds, "array<boolean>"), F.array(*singles)), lambda x: x.isNotNull())


def quote_counts(record: Column, folded: Column) -> Column:
    """(quotes, valid) of all evidence in a record against its normalised letter (a column, not an expression)."""
    def count(quotes):
        valid = F.filter(quotes, lambda q: quote_is_valid(folded, q))
        return F.struct(F.size(quotes).cast("long").alias("quotes"), F.size(valid).cast("long").alias("valid"))

    return let(quotes_of(record), count)


def invalid_quote_paths(record: Column, folded: Column) -> Column:
    """Paths of quotes that do not occur in the normalised letter (a column, not an expression)."""
    bad = F.filter(evidence_of(record), lambda q: ~quote_is_valid(folded, q["quote"]))
    return F.transform(bad, lambda q: q["path"])
