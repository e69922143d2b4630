"""Records, scores, support, grounding and review tables over the clinic corpus derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldmeter.functions.text import norm_text
from goldmeter.operators import chains as CH
from goldmeter.operators import contract as CT
from goldmeter.operators import costs as CO
from goldmeter.operators import grounding as G
from goldmeter.operators import matching as M
from goldmeter.operators import records as R
from goldmeter.operators import review as RV
from goldmeter.operators import scoring as S
from goldmeter.operators import selection as SEL
from goldmeter.operators import statistics as ST
from goldmeter.session import ensure_checkpoint_dir
from goldmeter.sources.schemas import EVENT
from verify import clinic as C
from verify.base import lit_sql, norm_text_sql, pick_sql, query

# ---- flattening -------------------------------------------------------------------------

CLAIMS = f"""{C.SYS}, clm AS (SELECT system, document_id, 'fields.current_anti_seizure_medications[0].name' AS path, 'medication' AS category, {pick_sql(C.MEDS, 'c + off')} AS value FROM sy
 UNION ALL SELECT system, document_id, 'fields.current_anti_seizure_medications[1].name', 'medication', {pick_sql(C.MEDS, 'c + k')} FROM sy WHERE t % 3 = 0
 UNION ALL SELECT system, document_id, 'fields.seizure_types[0].value', 'seizure_type', ty FROM sy UNION ALL SELECT system, document_id, 'fields.seizure_types[1].value', 'seizure_type', 'focal aware' FROM sy WHERE k % 4 = 0
 UNION ALL SELECT system, document_id, 'fields.epilepsy_diagnosis.value', 'diagnosis', {pick_sql(C.DX, 'c + t + off')} FROM sy WHERE {pick_sql(C.DX, 'c + t + off')} <> ''
 UNION ALL SELECT system, document_id, 'fields.current_seizure_frequency.value', 'frequency', fq FROM sy WHERE fq <> ''
 UNION ALL SELECT system, document_id, 'fields.eeg.status', 'investigation', {pick_sql(C.STATUS, 'c')} FROM sy WHERE c % 4 <> 2 UNION ALL SELECT system, document_id, 'fields.eeg.result', 'investigation', eeg FROM sy WHERE c % 4 <> 2
 UNION ALL SELECT system, document_id, 'fields.mri.status', 'investigation', {pick_sql(C.STATUS, 't')} FROM sy WHERE t % 4 <> 2 UNION ALL SELECT system, document_id, 'fields.mri.result', 'investigation', mri FROM sy WHERE t % 4 <> 2)"""


@query("claim_flattening", f"WITH {CLAIMS} SELECT * FROM clm")
def claim_flattening(spark, d):
    return R.flatten_claims(C.records(spark, d).drop("text")).select("system", "document_id", "path", "category", "value")


EVID = f"""{C.SYS}, mq AS (SELECT *, CASE WHEN k % 5 = 1 THEN 'not in the letter' WHEN k % 5 <> 0 THEN m1 END AS q FROM sy),
evd AS (SELECT system, document_id, '$.fields.current_anti_seizure_medications[0].evidence[0]' AS path, q AS quote, text FROM mq WHERE q IS NOT NULL
 UNION ALL SELECT system, document_id, '$.fields.current_anti_seizure_medications[1].evidence[0]', q, text FROM mq WHERE q IS NOT NULL AND t % 3 = 0
 UNION ALL SELECT system, document_id, '$.fields.seizure_types[0].evidence[0]', ty, text FROM sy UNION ALL SELECT system, document_id, '$.fields.seizure_types[1].evidence[0]', 'He has', text FROM sy WHERE k % 4 = 0
 UNION ALL SELECT system, document_id, '$.fields.current_seizure_frequency.evidence[0]', 'Seizures: ' || fq, text FROM sy WHERE fq <> ''
 UNION ALL SELECT system, document_id, '$.fields.epilepsy_diagnosis.evidence[0]', dx, text FROM sy WHERE {pick_sql(C.DX, 'c + t + off')} <> ''
 UNION ALL SELECT system, document_id, '$.fields.eeg.evidence[0]', eeg, text FROM sy WHERE c % 4 <> 2 UNION ALL SELECT system, document_id, '$.fields.mri.evidence[0]', mri, text FROM sy WHERE t % 4 <> 2)"""


@query("evidence_flattening", f"WITH {EVID} SELECT system, document_id, path, quote FROM evd")
def evidence_flattening(spark, d):
    return R.flatten_evidence(C.records(spark, d).drop("text"))


@query("invalid_quote_paths", f"WITH {EVID} SELECT system, document_id, count(*) AS quotes, string_agg(CASE WHEN NOT contains({norm_text_sql('text')}, {norm_text_sql('quote')}) THEN path END, '|' ORDER BY path) AS invalid FROM evd GROUP BY 1, 2")
def invalid_quote_paths(spark, d):
    r = C.records(spark, d).withColumn("_folded", norm_text(F.col("text")))
    bad = F.array_join(F.array_sort(R.invalid_quote_paths(F.col("record"), F.col("_folded"))), "|")
    return r.select("system", "document_id", F.size(R.evidence_of(F.col("record"))).cast("long").alias("quotes"), F.nullif(bad, F.lit("")).alias("invalid"))


FACTS = f"""{EVID}, qc AS (SELECT system, document_id, count(*) AS quotes, count(*) FILTER (contains({norm_text_sql('text')}, {norm_text_sql('quote')})) AS valid_quotes FROM evd GROUP BY 1, 2),
fa AS (SELECT system, document_id, (dx = '' AND {pick_sql(C.DX, 'c + t + off')} <> '') AS blank_dx, quotes, valid_quotes, 1 + CAST(t % 3 = 0 AS INT) AS meds, k, c, t, off, fq, 1 + CAST(t % 3 = 0 AS INT) + 1 + CAST(k % 4 = 0 AS INT) + CAST(fq <> '' AS INT) + CAST({pick_sql(C.DX, 'c + t + off')} <> '' AS INT) + CAST(c % 4 <> 2 AS INT) + CAST(t % 4 <> 2 AS INT) AS present_fields FROM sy JOIN qc USING (system, document_id)),
fx AS (SELECT system, document_id, k % 5 <> 0 AND NOT blank_dx AS schema_valid, CAST(present_fields AS BIGINT) AS present_fields, CAST(present_fields - CASE WHEN k % 5 = 0 THEN meds ELSE 0 END AS BIGINT) AS with_evidence, quotes, valid_quotes,
 CAST(meds + CAST(fq <> '' AS INT) + CAST({pick_sql(C.DX, 'c + t + off')} <> '' AS INT) + CAST(c % 4 <> 2 AS INT) + CAST(t % 4 <> 2 AS INT) AS BIGINT) AS temporal_checked,
 CAST(CASE WHEN k % 3 = 0 THEN meds ELSE 0 END + CAST(fq <> '' AS INT) + CAST({pick_sql(C.DX, 'c + t + off')} <> '' AS INT) + CAST(c % 4 < 2 AS INT) + CAST(t % 4 < 2 AS INT) AS BIGINT) AS temporal_correct,
 CAST(k % 100 AS DOUBLE) AS latency_ms, CAST(c % 1000 AS DOUBLE) AS input_tokens, CASE WHEN k % 2 = 0 THEN CAST(t % 50 AS DOUBLE) END AS output_tokens FROM fa)"""
_FACT_COLS = ["system", "document_id", "schema_valid", "present_fields", "with_evidence", "quotes", "valid_quotes", "temporal_checked", "temporal_correct", "latency_ms", "input_tokens", "output_tokens"]


@query("document_facts", f"WITH {FACTS} SELECT {', '.join(_FACT_COLS)} FROM fx")
def document_facts(spark, d):
    return S.document_facts(C.records(spark, d)).select(*_FACT_COLS)


@query("present_fields", f"WITH {FACTS} SELECT system, CAST(sum(present_fields) AS BIGINT) AS present, CAST(sum(with_evidence) AS BIGINT) AS with_evidence FROM fx GROUP BY 1")
def present_fields(spark, d):
    return R.flatten_present_fields(C.records(spark, d).drop("text")).groupBy("system").agg(F.count(F.lit(1)).alias("present"), F.count_if("with_evidence").alias("with_evidence"))


@query("record_violations", f"""WITH {C.SYS} SELECT system, document_id, coalesce(array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'current_anti_seizure_medications.evidence' END, CASE WHEN k % 6 = 0 THEN 'eeg.status' END,
 CASE WHEN dx = '' AND {pick_sql(C.DX, 'c + t + off')} <> '' THEN 'epilepsy_diagnosis.evidence' END], lambda x: x IS NOT NULL), '|'), '') AS violations FROM sy""")
def record_violations(spark, d):
    r = C.records(spark, d)
    bad = F.substring("document_id", 2, 20).cast("bigint") % 6 == 0
    r = r.withColumn("record", F.when(bad, F.col("record").withField("fields.eeg.status", F.lit("lost"))).otherwise(F.col("record")))
    return R.check_records(r.drop("text")).select("system", "document_id", F.array_join(F.array_sort("violations"), "|").alias("violations"))


@query("expectation_check", f"""WITH {CLAIMS}, ex AS (SELECT document_id, 'fields.current_seizure_frequency.value' AS path, CASE WHEN k % 2 = 0 THEN upper(fq) ELSE 'x' END AS expected FROM bl)
SELECT ex.document_id, ex.path, coalesce(lower(trim(ex.expected)) = lower(trim(clm.value)), false) AS met FROM ex LEFT JOIN clm ON clm.document_id = ex.document_id AND clm.path = ex.path AND clm.system = 'A'""")
def expectation_check(spark, d):
    ex = C.base(spark, d).select("document_id", F.lit("fields.current_seizure_frequency.value").alias("path"), F.when(F.col("k") % 2 == 0, F.upper("fq")).otherwise("x").alias("expected"))
    values = R.flatten_claims(C.records(spark, d).drop("text")).filter("system = 'A'")
    return R.check_expectations(ex, values).select("document_id", "path", "met")


@query("contract_recode", f"""WITH {C.SYS} SELECT system, document_id, CASE k % 3 WHEN 2 THEN 'historical' ELSE 'current' END AS temporality, CASE k % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'increased' ELSE 'previous' END AS status,
 CASE WHEN k % 5 = 0 THEN 'uncertain' ELSE 'present' END AS missingness, CASE WHEN c % 2 = 0 THEN 'requested' ELSE {pick_sql(C.STATUS, 'c')} END AS eeg_status, CASE WHEN c % 2 = 0 THEN 'normal' ELSE eeg END AS eeg_result, 'e1|e1_2|e1_3' AS ids FROM sy""")
def contract_recode(spark, d):
    r = C.records(spark, d).drop("text")
    rec = F.col("record")
    k_even = F.col("record.metadata.input_tokens") % 2 == 0
    ev = F.struct(*[(F.lit("e1") if f.name == "id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT.fields])
    aliased = F.transform(rec["fields"]["current_anti_seizure_medications"], lambda m: m.withField("temporality", F.when(m["temporality"] == "historical", "previous").otherwise(
        F.when(m["temporality"] == "current", "recent"))).withField("status", F.when(m["status"] == "previous", "historical").otherwise(m["status"])))
    rec = rec.withField("fields.current_anti_seizure_medications", aliased).withField("events", F.array(ev, ev, ev))
    eeg = F.when(k_even, F.lit("planned")).otherwise(rec["fields"]["eeg"]["status"])
    rec = rec.withField("fields.eeg.status", eeg).withField("fields.eeg.result", F.when(k_even, F.lit("negative")).otherwise(rec["fields"]["eeg"]["result"]))
    out = r.withColumn("record", rec).withColumn("record", R.recode_record(F.col("record")))
    m = F.col("record.fields.current_anti_seizure_medications")[0]
    return out.select("system", "document_id", m["temporality"].alias("temporality"), m["status"].alias("status"), m["missingness"].alias("missingness"),
                      F.col("record.fields.eeg.status").alias("eeg_status"), F.col("record.fields.eeg.result").alias("eeg_result"), F.array_join(F.transform("record.events", lambda e: e["id"]), "|").alias("ids"))




# payload shapes of order {k} with medication {m}, and what each means: pipeline, name, dose, missingness, quotes, eeg status and result,
# diagnosis, event ids, event values, event quotes, input tokens
_T = '"missingness": "present", "temporality": "recent", "evidence_event_ids": []'
RAW_SHAPES = [
    ('{"fields": {"current_anti_seizure_medications": [{"name": "{m}", "dose": {k}, %s, "evidence": {"text": "says {m}"}}]}}' % _T, ("P", "{m}", "{k}", "present", "says {m}", None, None, None, None, None, None, "0")),
    ('{"pipeline_id": "own", "fields": {"current_anti_seizure_medications": [{"name": "{m}", %s, "evidence": [{"quote": "a"}, {"quote": "b{k}"}]}]}, "metadata": {"input_tokens": {k}}}' % _T, ("own", "{m}", None, "present", "a|b{k}", None, None, None, None, None, None, "{k}")),
    ('{"document_id": "", "fields": {"current_anti_seizure_medications": [{"name": "{m}", %s, "evidence": []}]}, "metadata": {"input_tokens": null}}' % _T, ("P", "{m}", None, "uncertain", "", None, None, None, None, None, None, "0")),
    ('{"fields": {"current_anti_seizure_medications": [{"name": "{m}", %s}]}}' % _T, ("P", "{m}", None, "present", None, None, None, None, None, None, None, "0")),
    ('{"fields": {}, "eeg": {"status": "planned", "result": "negative", %s, "evidence": [{"quote": "q"}]}, "epilepsy_diagnosis": {"value": "dx {k}"}}' % _T, ("P", None, None, None, None, "requested", "normal", "dx {k}", None, None, None, "0")),
    ('{"fields": {"eeg": {"status": "planned", "result": "abnormal"}}, "eeg": {"status": "completed"}}', ("P", None, None, None, None, "planned", "abnormal", None, None, None, None, "0")),
    ('{"events": [{"id": "e{k}", "category": "medication", "value": {"medication_name": "{m}", "dose": {k}}}, {"id": "e{k}", "category": "x", "value": {"z": 1, "b": "{m}"}}]}', ("P", None, "{k}", None, None, None, None, None, "e{k}|e{k}_2", '{m}|{"b":"{m}","z":1}', "", "0")),
    ('{"events": [{"id": "a", "category": "x", "result": "negative", "evidence": [{"text": "one {k}"}, {"quote": "two"}]}, {"id": "b", "category": "x", "medication_name": "{m}", "evidence": {"text": "three"}}]}', ("P", None, None, None, None, None, None, None, "a|b", "normal|{m}", "one {k}|three", "0")),
    ('{"events": [{"id": "c", "value": {k}}, {"id": "c", "value": "{m}"}, {"id": "c", "value": null}]}', ("P", None, None, None, None, None, None, None, "c|c_2|c_3", "{k}|{m}", "", "0")),
    ('[{"fields": {"eeg": {"status": "{k}"}}}]', (None,) * 12),
    ('{"fields": {"eeg": {"status": "{k}"}}', (None,) * 12),
]
RAW_COLUMNS = ["pipeline_id", "name", "dose", "missingness", "quotes", "eeg_status", "eeg_result", "diagnosis", "event_ids", "event_values", "event_quotes", "input_tokens"]


def _meant(column: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {lit_sql(means[column])}" for i, (_, means) in enumerate(RAW_SHAPES))
    return f"replace(replace(CASE k % {len(RAW_SHAPES)} {cases} END, '{{k}}', CAST(k AS VARCHAR)), '{{m}}', m1) AS {RAW_COLUMNS[column]}"


@query("contract_recode_raw", f"WITH {C.BASE} SELECT document_id, k % {len(RAW_SHAPES)} < {len(RAW_SHAPES) - 2} AS read, {', '.join(_meant(i) for i in range(len(RAW_COLUMNS)))} FROM bl")
def contract_recode_raw(spark, d):
    payload = F.element_at(F.array(*[F.lit(p) for p, _ in RAW_SHAPES]), (F.col("k") % len(RAW_SHAPES) + 1).cast("int"))
    payload = F.replace(F.replace(payload, F.lit("{k}"), F.col("k").cast("string")), F.lit("{m}"), F.col("m1"))
    out = C.base(spark, d).select("document_id", CT.recode_tree(payload, F.col("document_id"), F.lit("P")).alias("r"))
    f, ev = F.col("r.fields"), F.col("r.events")
    med = F.get(f["current_anti_seizure_medications"], F.lit(0))
    joined = lambda x, g: F.array_join(F.transform(x, g), "|")
    return out.select(
        "document_id", F.col("r").isNotNull().alias("read"), F.col("r.pipeline_id").alias("pipeline_id"), med["name"].alias("name"), F.coalesce(med["dose"], F.get(ev, F.lit(0))["dose"]).alias("dose"),
        med["missingness"].alias("missingness"), joined(med["evidence"], lambda e: e["quote"]).alias("quotes"), f["eeg"]["status"].alias("eeg_status"), f["eeg"]["result"].alias("eeg_result"),
        f["epilepsy_diagnosis"]["value"].alias("diagnosis"), joined(ev, lambda e: e["id"]).alias("event_ids"), joined(ev, lambda e: e["value"]).alias("event_values"),
        joined(ev, lambda e: e["evidence"]["quote"]).alias("event_quotes"), F.col("r.metadata.input_tokens").cast("bigint").cast("string").alias("input_tokens"))


@query("frequency_sidecar", f"""WITH {C.SYS}, lb AS (SELECT document_id, CASE k % 4 WHEN 0 THEN 'No Seizure-Frequency  reference' WHEN 1 THEN ' 2-3 per Month ' ELSE 'unknown' END AS label FROM bs WHERE k % 4 <> 3)
SELECT sy.system, sy.document_id, CASE WHEN k % 4 IN (0, 3) THEN NULL WHEN k % 4 = 1 THEN '2 3 per month' ELSE 'unknown' END AS value, CASE WHEN k % 4 IN (0, 3) THEN 'not_stated' ELSE 'present' END AS missingness,
 CASE WHEN fq <> '' THEN ty ELSE ty END AS seizure_type, CASE WHEN k % 4 IN (0, 3) THEN 0 ELSE 1 END AS evidence FROM sy LEFT JOIN lb USING (document_id)""")
def frequency_sidecar(spark, d):
    k = F.col("k")
    label = F.when(k % 4 == 0, "No Seizure-Frequency  reference").when(k % 4 == 1, " 2-3 per Month ").otherwise("unknown")
    labels = C.base(spark, d).filter(k % 4 != 3).select("document_id", label.alias("label"), F.lit("quoted").alias("quote"))
    f = F.col("record.fields.current_seizure_frequency")
    return R.merge_frequency(C.records(spark, d).drop("text"), labels).select(
        "system", "document_id", f["value"].alias("value"), f["missingness"].alias("missingness"), f["seizure_type"].alias("seizure_type"), F.size(f["evidence"]).alias("evidence"))


@query("best_of_candidates", f"""WITH {C.SYS}, n AS (SELECT document_id, system, off, 1 + CAST(t % 3 = 0 AS INT) + 1 + CAST(k % 4 = 0 AS INT) + CAST({pick_sql(C.DX, 'c + t + off')} <> '' AS INT) + CAST(fq <> '' AS INT) + CAST(c % 4 < 2 AS INT) + CAST(t % 4 < 2 AS INT) AS n FROM sy)
SELECT document_id, arg_max(system, n * 10 - off) AS system, max(n) AS populated FROM n GROUP BY 1""")
def best_of_candidates(spark, d):
    r = C.records(spark, d).select("document_id", "system", R.populated_fields(F.col("record")).alias("populated"), (F.col("system") == "B").cast("int").alias("ord"))
    return R.best_of(r, ["document_id"], "populated", "ord").drop("ord")


# ---- scores -----------------------------------------------------------------------------


@query("set_match_flags", f"WITH {C.FLAGS} SELECT system, metric, key, count(*) FILTER (in_pred AND in_gold) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM fl GROUP BY 1, 2, 3")
def set_match_flags(spark, d):
    return M.count_flags(CH.key_flags(scores(spark, d, *MATCHED)), ["system", "metric", "key"])


@query("document_set_scores", f"WITH {C.SET_SCORES} SELECT * FROM ss")
def document_set_scores(spark, d):
    return CH.set_rows(scores(spark, d, "sets"))


_SCAL = ["exact", "relaxed", "loose", "per_letter", "count_hit", "period_hit", "linked", "gold_annotations", "scope_ok", "eeg_ok", "mri_ok", "dx", "dx_coarse"]


@query("document_scalar_scores", f"WITH {C.SCALARS} SELECT system, document_id, {', '.join(_SCAL)} FROM sl")
def document_scalar_scores(spark, d):
    return scores(spark, d, *_SCAL).select("system", "document_id", *_SCAL)


CLASSES = f"""{C.SCALARS}, cz AS (SELECT system, CASE WHEN gx = 1000 THEN 'UNK' WHEN gx = 0 THEN 'NS' WHEN gx <= 1.1 THEN 'infrequent' ELSE 'frequent' END AS g, CASE WHEN px = 1000 THEN 'UNK' WHEN px = 0 THEN 'NS' WHEN px <= 1.1 THEN 'infrequent' ELSE 'frequent' END AS p FROM sl)"""


@query("frequency_category_counts", f"WITH {CLASSES} SELECT system, g AS gold_coarse, p AS pred_coarse, count(*) AS n FROM cz GROUP BY 1, 2, 3")
def frequency_category_counts(spark, d):
    return scores(spark, d, "gold_coarse", "pred_coarse").groupBy("system", "gold_coarse", "pred_coarse").agg(F.count(F.lit(1)).alias("n"))


@query("frequency_category_reports", f"WITH {CLASSES} SELECT system, 'pragmatic' AS ladder, avg(CAST(g = p AS INT)) AS micro_f1, count(*) AS support FROM cz GROUP BY 1")
def frequency_category_reports(spark, d):
    out = S.category_reports(scores(spark, d, "gold_coarse", "pred_coarse", "gold_fine", "pred_fine"))
    return out.filter("ladder = 'pragmatic'").select("system", "ladder", "micro_f1", "support")


ABST = f"""{C.FLAGS}, ab AS (SELECT sy.system, sy.document_id, coalesce(bool_or(metric = 'seizure_type' AND in_gold AND key = 'unknown seizure type'), false) AS gu, coalesce(bool_or(metric = 'seizure_type' AND in_gold AND key NOT IN ('unknown seizure type', 'seizure free')), false) AS gsp,
 coalesce(bool_or(metric = 'seizure_type' AND in_pred AND key = 'unknown seizure type'), false) AS pu, coalesce(bool_or(metric = 'seizure_type' AND in_pred AND key NOT IN ('unknown seizure type', 'seizure free')), false) AS psp,
 coalesce(bool_or(metric = 'seizure_type' AND in_pred), false) AS pa, coalesce(bool_or(metric = 'seizure_type' AND in_pred <> in_gold), false) AS df, coalesce(bool_or(metric = 'seizure_type_collapsed' AND in_pred <> in_gold), false) AS cdf,
 coalesce(bool_or(metric = 'seizure_type_collapsed' AND in_pred), false) AS ca FROM sy LEFT JOIN fl USING (system, document_id) GROUP BY 1, 2),
ac AS (SELECT system, document_id, CASE WHEN gu AND NOT gsp THEN CASE WHEN pu AND NOT psp THEN 'correct_abstention' WHEN psp THEN 'unsupported_specificity' WHEN NOT pa THEN 'missed_abstention' ELSE 'other_abstention_error' END
 WHEN gsp THEN CASE WHEN pu AND NOT psp THEN 'over_abstention' WHEN NOT df THEN 'specificity_match' WHEN NOT cdf AND ca THEN 'granularity_mismatch' WHEN NOT pa THEN 'missing_specific_prediction' ELSE 'specificity_error' END ELSE 'non_abstention_case' END AS category, gu AND NOT gsp AS needs, gsp FROM ab)"""


@query("abstention_categories", f"WITH {ABST} SELECT system, document_id, category FROM ac")
def abstention_categories(spark, d):
    return CH.abstention(_typed(spark, d)).select("system", "document_id", "category")


@query("abstention_rates", f"""WITH {ABST} SELECT system, count(*) FILTER (needs) AS abstention_case_count, count(*) FILTER (category = 'correct_abstention') / count(*) FILTER (needs) AS correct_abstention_rate,
 count(*) FILTER (category = 'over_abstention') / count(*) FILTER (gsp) AS over_abstention_rate, count(*) FILTER (category = 'granularity_mismatch') AS granularity_mismatch_count FROM ac GROUP BY 1""")
def abstention_rates(spark, d):
    return S.abstention_rates(CH.abstention(_typed(spark, d)), ["system"]).select(
        "system", "abstention_case_count", "correct_abstention_rate", "over_abstention_rate", "granularity_mismatch_count")


# support: spans of this corpus are the values themselves; evidence has no offsets, so overlap is containment of normalised text
_NVQ = "(CASE WHEN trim(regexp_replace(lower(q), '[^a-z0-9./]+', ' ', 'g')) IN ('', 'unknown', 'na', 'none', 'null', 'not stated', 'n/a', 'nan') THEN '' ELSE trim(regexp_replace(lower(q), '[^a-z0-9./]+', ' ', 'g')) END)"
SUPPORT = f"""{C.SCALARS}, {C.PRED_KEYS.split('pk AS')[0].rstrip().rstrip(',')}, gm AS (SELECT document_id, {pick_sql(C.MEDS_C, 'c + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END')} AS n, {pick_sql(['500', '250'], 'k')} AS dd FROM bs),
md AS (SELECT sy.system, sy.document_id, i, CASE WHEN i = 0 THEN {pick_sql(C.MEDS_C, 'c + off')} ELSE {pick_sql(C.MEDS_C, 'c + k')} END AS v, {pick_sql(C.DOSE_C, 'k')} AS d, {pick_sql(C.UNIT_C, 'k')} AS u, {pick_sql(C.SCHED_C, 't')} AS s, CASE WHEN k % 5 = 1 THEN 'not in the letter' WHEN k % 5 <> 0 THEN m1 END AS q, m1 AS span, text
 FROM sy, (VALUES (0), (1)) x(i) WHERE i = 0 OR t % 3 = 0),
cs AS (SELECT md.system, md.document_id, '$.fields.current_anti_seizure_medications[' || i || ']' AS path, v AS value, (v = gm.n AND ((d = '' AND u = '' AND s = '') OR (d = gm.dd AND u = 'mg' AND s = 'twice daily'))) AS ok, q, span, text FROM md JOIN gm USING (document_id)
 UNION ALL SELECT system, document_id, '$.fields.seizure_types[0]', {pick_sql(C.TYPE_C, 't')}, {pick_sql(C.TYPE_C, 't')} IN (SELECT st FROM gf WHERE gf.document_id = sy.document_id), ty, nullif(dx, ''), text FROM sy
 UNION ALL SELECT system, document_id, '$.fields.seizure_types[1]', 'focal aware seizure', false, 'He has', nullif(dx, ''), text FROM sy WHERE k % 4 = 0
 UNION ALL SELECT system, document_id, '$.fields.epilepsy_diagnosis', {pick_sql(C.DX_C, 'c + t + off')}, sl.dx, sy.dx, nullif(sy.dx, ''), text FROM sy JOIN sl USING (system, document_id) WHERE {pick_sql(C.DX, 'c + t + off')} <> ''
 UNION ALL SELECT system, document_id, '$.fields.current_seizure_frequency', fq, per_letter, 'Seizures: ' || fq, CASE WHEN k % 2 = 0 THEN fq END, text FROM sy JOIN sl USING (system, document_id) WHERE fq <> ''
 UNION ALL SELECT system, document_id, '$.fields.eeg', {pick_sql(C.RESULT_C, 'c')}, eeg_ok, eeg, NULL, text FROM sy JOIN sl USING (system, document_id) WHERE c % 4 <> 2
 UNION ALL SELECT system, document_id, '$.fields.mri', {pick_sql(C.RESULT_C, 't')}, mri_ok, mri, NULL, text FROM sy JOIN sl USING (system, document_id) WHERE t % 4 <> 2),
cn AS (SELECT *, {_NVQ} AS qn, trim(regexp_replace(lower(span), '[^a-z0-9./]+', ' ', 'g')) AS sn, contains({norm_text_sql('text')}, {norm_text_sql('q')}) AS valid FROM cs),
sts AS (SELECT system, document_id, path, value, ok AS supported_by_gold, CASE WHEN q IS NULL THEN 'no_quote' WHEN NOT valid THEN 'invalid_quote' WHEN span IS NULL THEN 'ambiguous' WHEN qn <> '' AND (contains(sn, qn) OR contains(qn, sn)) THEN CASE WHEN ok THEN 'supported' ELSE 'contradicts_gold' END ELSE 'co_located' END AS status FROM cn)"""


def _support(spark, d):
    return CH.evidence_support(C.records(spark, d), C.gold(spark, d))


@query("evidence_support", f"WITH {SUPPORT} SELECT * FROM sts")
def evidence_support(spark, d):
    return _support(spark, d).select("system", "document_id", "path", "value", "supported_by_gold", "status")


@query("evidence_support_rates", f"""WITH {SUPPORT} SELECT system, count(*) AS claims, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'ambiguous') AS ambiguous,
 count(*) FILTER (status = 'supported') / count(*) AS support_rate, count(*) FILTER (status = 'supported') / count(*) FILTER (status <> 'ambiguous') AS decidable_rate FROM sts GROUP BY 1""")
def evidence_support_rates(spark, d):
    return S.support_summary(_support(spark, d), ["system"]).select("system", "claims", "supported", "ambiguous", "support_rate", "decidable_rate")


def parts(spark, d):
    """Shared inputs of the corpus-level queries."""
    r, g = C.records(spark, d), C.gold(spark, d)
    scored = CH.score_sides(CH.record_side(r), CH.gold_side(g))
    return r, g, scored, CH.key_flags(scored), CH.set_rows(scored), scored


MATCHED = ["tp_keys", "fp_keys", "fn_keys"]


def quality(spark, d):
    """Rows with set scores and what is told of the record itself, for queries that need no scalar verdict."""
    return CH.score_sides(CH.record_side(C.records(spark, d), predictions=False), CH.gold_side(C.gold(spark, d)), ["sets", *CH.QUALITY])


def _typed(spark, d):
    g = C.gold(spark, d)
    return CH.score_sides(CH.type_side(C.records(spark, d)), CH.gold_side(g | {"medications": g["medications"].limit(0)}), MATCHED)


def scores(spark, d, *only):
    """Scored rows with these made columns only, for queries that need neither facts nor the other verdicts."""
    return CH.score_sides(CH.record_side(C.records(spark, d), facts=False), CH.gold_side(C.gold(spark, d)), list(only))


SUMMARY = f"""{C.SET_SCORES}, sums AS (SELECT system, metric, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sc GROUP BY 1, 2), mr AS (SELECT system, metric, {C._P} FROM sums), mf AS (SELECT *, {C._F} FROM mr)"""


@query("system_summary", f"""WITH {SUMMARY}, {FACTS.split(C.SYS + ',')[1]}, {C.SCALARS.split(C.GOLD_FREQ + ',')[1]}
SELECT f.system, (SELECT count(*) FROM orders) AS documents_expected, f.n AS documents_available, f.schema_valid_rate, f.quote_presence_rate, f.quote_validity_rate, f.temporal_accuracy, f.mean_latency_ms, f.mean_output_tokens,
 (SELECT f1 FROM mf WHERE mf.system = f.system AND metric = 'medication_name') AS medication_name_f1, (SELECT f1 FROM mf WHERE mf.system = f.system AND metric = 'medication_full') AS medication_full_f1,
 (SELECT f1 FROM mf WHERE mf.system = f.system AND metric = 'seizure_type_collapsed') AS seizure_type_f1_collapsed, s.eeg_accuracy, s.epilepsy_diagnosis_accuracy, s.current_seizure_frequency_per_letter_accuracy
FROM (SELECT system, count(*) AS n, avg(CAST(schema_valid AS INT)) AS schema_valid_rate, sum(with_evidence) / sum(present_fields) AS quote_presence_rate, sum(valid_quotes) / sum(quotes) AS quote_validity_rate, sum(temporal_correct) / sum(temporal_checked) AS temporal_accuracy,
 avg(latency_ms) AS mean_latency_ms, avg(output_tokens) AS mean_output_tokens FROM fx GROUP BY 1) f JOIN (SELECT system, avg(CAST(eeg_ok AS INT)) AS eeg_accuracy, avg(CAST(dx AS INT)) AS epilepsy_diagnosis_accuracy, avg(CAST(per_letter AS INT)) AS current_seizure_frequency_per_letter_accuracy FROM sl GROUP BY 1) s USING (system)""")
def system_summary(spark, d):
    out = CH.record_summary(C.records(spark, d), C.expected(spark, d), C.gold(spark, d))
    return out.select("system", "documents_expected", "documents_available", "schema_valid_rate", "quote_presence_rate", "quote_validity_rate", "temporal_accuracy", "mean_latency_ms", "mean_output_tokens",
                      "medication_name_f1", "medication_full_f1", "seizure_type_f1_collapsed", "eeg_accuracy", "epilepsy_diagnosis_accuracy", "current_seizure_frequency_per_letter_accuracy")


@query("field_precision_recall", f"""WITH {SUMMARY}, {C.SCALARS.split(C.GOLD_FREQ + ',')[1]}, ll AS (SELECT system, metric AS field, key AS label, count(*) FILTER (in_pred AND in_gold) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM fl GROUP BY 1, 2, 3
 UNION ALL SELECT system, metric, '__micro__', sum(tp), sum(fp), sum(fn) FROM sc GROUP BY 1, 2), lr AS (SELECT *, {C._P} FROM ll), lf AS (SELECT *, {C._F} FROM lr)
SELECT system, field, label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, precision, recall, f1 FROM lf
UNION ALL SELECT system, m, '__document_accuracy__', count(*) FILTER (v), count(*) FILTER (NOT v), 0, avg(CAST(v AS INT)), 1.0, avg(CAST(v AS INT)) FROM (SELECT system, unnest(['current_seizure_frequency', 'current_seizure_frequency_relaxed', 'current_seizure_frequency_loose', 'current_seizure_frequency_per_letter']) AS m, unnest([exact, relaxed, loose, per_letter]) AS v FROM sl) GROUP BY 1, 2""")
def field_precision_recall(spark, d):
    wanted = S.SCALAR_METRICS[:4]
    return CH.field_table(scores(spark, d, *MATCHED, *CH.columns_for(wanted)), wanted)


@query("error_budget", f"""WITH {C.SET_SCORES}, {FACTS.split(C.SYS + ',')[1]}, ex AS (SELECT 'O' || o_orderkey AS document_id, v.system FROM orders, (VALUES ('A'), ('B')) v(system))
SELECT ex.system, m.metric, count(*) AS documents, count(*) FILTER (coalesce(f1, 0) < 1) AS field_failures, count(*) FILTER (fx.document_id IS NULL) AS unavailable_outputs, count(*) FILTER (NOT fx.schema_valid) AS schema_invalid_outputs,
 count(*) FILTER (fx.quotes > fx.valid_quotes) AS quote_invalid_outputs, count(*) FILTER (coalesce(f1, 0) < 1) / count(*) AS field_failure_rate
FROM ex CROSS JOIN (VALUES ('medication_name'), ('medication_full'), ('seizure_type')) m(metric) LEFT JOIN ss ON ss.system = ex.system AND ss.document_id = ex.document_id AND ss.metric = m.metric LEFT JOIN fx ON fx.system = ex.system AND fx.document_id = ex.document_id GROUP BY 1, 2""")
def error_budget(spark, d):
    return CH.error_budget(C.expected(spark, d), quality(spark, d), ["medication_name", "medication_full", "seizure_type"])


@query("document_utility", f"""WITH {C.SET_SCORES}, {FACTS.split(C.SYS + ',')[1]} SELECT ss.system, ss.document_id, round((avg(f1) + any_value(CAST(schema_valid AS INT)) + any_value(temporal_correct / temporal_checked) + any_value(valid_quotes / quotes)) / 4, 9) AS score FROM ss JOIN fx USING (system, document_id) GROUP BY 1, 2""")
def document_utility(spark, d):
    return CH.document_utility(quality(spark, d)).withColumn("score", F.round("score", 9))


WRONG = f"{C.SET_SCORES}, wr AS (SELECT system, document_id, string_agg(CASE WHEN fp > 0 OR fn > 0 THEN metric END, '|' ORDER BY metric) AS incorrect, count(*) FILTER (fp > 0 OR fn > 0) AS incorrect_count FROM ss GROUP BY 1, 2)"


def _set_scores_only(sets):
    return sets.select("system", "document_id", "metric", F.lit("set").alias("kind"), "tp", "fp", "fn", F.lit(None).cast("boolean").alias("correct"))


@query("incorrect_fields", f"WITH {WRONG} SELECT system, document_id, coalesce(incorrect, '') AS incorrect, incorrect_count FROM wr")
def incorrect_fields(spark, d):
    return RV.incorrect_fields(_set_scores_only(CH.set_rows(scores(spark, d, "sets"))))


@query("failure_tags", f"""WITH {WRONG}, {FACTS.split(C.SYS + ',')[1]}, tg AS (SELECT system, document_id, list_sort(list_filter([CASE WHEN quotes > valid_quotes THEN 'evidence_selection' END, CASE WHEN NOT schema_valid THEN 'schema_or_parse' END, CASE WHEN temporal_correct < temporal_checked THEN 'temporality' END,
 CASE WHEN regexp_matches('|' || coalesce(incorrect, '') || '|', '\\|(medication_name|medication_full|seizure_type)\\|') THEN 'normalization_or_missingness' END], lambda x: x IS NOT NULL)) AS tags,
 CASE WHEN quotes > valid_quotes THEN 'quote_invalid' WHEN incorrect_count > 0 THEN 'quote_valid_but_semantically_wrong_or_missing' ELSE 'no_field_error' END AS quote_error_class FROM wr JOIN fx USING (system, document_id))
SELECT system, document_id, CASE WHEN len(tags) = 0 THEN 'none_flagged' ELSE array_to_string(tags, '|') END AS tags, quote_error_class FROM tg""")
def failure_tags(spark, d):
    return CH.failure_tags(quality(spark, d))


ERR = f"{C.FLAGS}, er AS (SELECT system, document_id, metric, key, CASE WHEN in_pred THEN 'fp' ELSE 'fn' END AS error_type FROM fl WHERE in_pred <> in_gold AND metric IN ('medication_name', 'medication_full', 'seizure_type'))"
_FAILSQL = "(CASE WHEN (contains(key,'focal') OR contains(key,'partial')) AND (contains(key,'generalized') OR contains(key,'absence') OR contains(key,'tonic clonic')) THEN 'c' WHEN contains(key,'focal') THEN 'f' WHEN contains(key,'generalized') THEN 'g' WHEN contains(key,'seizure') THEN 'u' ELSE '' END)"
ATTR = f"""{ERR}, sd AS (SELECT system, document_id, metric, in_pred, in_gold, CASE WHEN metric = 'medication_full' THEN split_part(key, ' | ', 1) ELSE {_FAILSQL} END AS part FROM fl WHERE metric IN ('medication_full', 'seizure_type')),
at_ AS (SELECT er.*, CASE WHEN er.metric <> 'medication_name' AND EXISTS (SELECT 1 FROM sd WHERE sd.system = er.system AND sd.document_id = er.document_id AND sd.metric = er.metric AND sd.part = CASE WHEN er.metric = 'medication_full' THEN split_part(er.key, ' | ', 1) ELSE {_FAILSQL.replace('key', 'er.key')} END
 AND CASE WHEN error_type = 'fp' THEN sd.in_gold ELSE sd.in_pred END) THEN 'normalizer' WHEN system = 'B' THEN 'event_extraction' ELSE 'prompt_extraction' END AS failure_source FROM er)"""


def _attributed(spark, d):
    errors = RV.attribute_errors(CH.key_flags(scores(spark, d, *MATCHED)), None, "B")
    return errors.filter(F.col("metric").isin("medication_name", "medication_full", "seizure_type"))


@query("attributed_errors", f"WITH {ATTR} SELECT * FROM at_")
def attributed_errors(spark, d):
    return _attributed(spark, d)


@query("failure_pareto", f"""WITH {ATTR}, ct AS (SELECT metric, system, failure_source, count(*) AS error_count FROM at_ GROUP BY 1, 2, 3)
SELECT metric, system, failure_source, error_count, CAST(sum(error_count) OVER (PARTITION BY metric, system) AS BIGINT) AS group_errors, error_count / sum(error_count) OVER (PARTITION BY metric, system) AS share,
 sum(error_count) OVER (PARTITION BY metric, system ORDER BY error_count DESC, failure_source ROWS UNBOUNDED PRECEDING) / sum(error_count) OVER (PARTITION BY metric, system) AS cumulative_share FROM ct""")
def failure_pareto(spark, d):
    return ST.failure_pareto(_attributed(spark, d), ["metric", "system"], "failure_source")


@query("cost_per_correct_unit", f"""WITH {C.SET_SCORES} SELECT system, round(sum(f1) FILTER (metric IN ('medication_name', 'seizure_type')), 6) AS correct_units, round(avg(c.cost), 9) AS mean_cost, round(avg(c.cost) / sum(f1) FILTER (metric IN ('medication_name', 'seizure_type')), 9) AS cost_per_correct_unit
FROM ss JOIN (SELECT system, avg((c % 1000) / 1000.0) AS cost FROM sy GROUP BY 1) c USING (system) GROUP BY 1""")
def cost_per_correct_unit(spark, d):
    sets = CH.set_rows(scores(spark, d, "sets")).filter(F.col("metric").isin("medication_name", "seizure_type")).select("system", F.round("f1", 12).alias("utility"))
    calls = C.systems(spark, d).select("system", (F.col("c") % 1000 / 1000).alias("cost"))
    out = CO.cost_per_unit(sets, calls, ["system"])
    return out.select("system", F.round("correct_units", 6).alias("correct_units"), F.round("mean_cost", 9).alias("mean_cost"), F.round("cost_per_correct_unit", 9).alias("cost_per_correct_unit"))


@query("paired_examples", f"""WITH {WRONG}, u AS (SELECT system, document_id, round(avg(f1), 9) AS score FROM ss GROUP BY 1, 2), p AS (SELECT b.document_id, b.score, a.score AS base_score, b.score - a.score AS delta, wb.incorrect_count > 0 AND wa.incorrect_count > 0 AS both_ FROM u b JOIN u a ON a.document_id = b.document_id AND a.system = 'A' AND b.system = 'B'
 JOIN wr wb ON wb.document_id = b.document_id AND wb.system = 'B' JOIN wr wa ON wa.document_id = b.document_id AND wa.system = 'A'),
c AS (SELECT *, 'comparator_improves' AS category, -delta AS k FROM p WHERE delta > 0 UNION ALL SELECT *, 'baseline_outperforms', delta FROM p WHERE delta < 0 UNION ALL SELECT *, 'all_systems_fail', greatest(score, base_score) FROM p WHERE both_)
SELECT 'B' AS comparator, category, document_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k, document_id) AS rank FROM c) WHERE rank <= 5""")
def paired_examples(spark, d):
    # utilities and wrong fields are each read for both systems: the narrow scored rows are written once
    ensure_checkpoint_dir(spark)
    sets = CH.set_rows(scores(spark, d, "sets").checkpoint())
    u = sets.groupBy("system", "document_id").agg(F.round(F.avg("f1"), 9).alias("score"))
    return RV.paired_examples(u, RV.incorrect_fields(_set_scores_only(sets)), "A", 5).select("comparator", "category", "document_id", "rank")


@query("error_examples", f"WITH {WRONG} SELECT system, document_id, incorrect FROM wr WHERE incorrect_count > 0 ORDER BY system, document_id LIMIT 25")
def error_examples(spark, d):
    return RV.error_examples(RV.incorrect_fields(_set_scores_only(CH.set_rows(scores(spark, d, "sets")))), 25).select("system", "document_id", "incorrect")


@query("frequency_failure_modes", f"""WITH {C.SCALARS}, md AS (SELECT sl.*, fq, k FROM sl JOIN sy USING (system, document_id))
SELECT system, document_id, CASE WHEN per_letter THEN NULL WHEN gold_annotations = 0 AND fq <> '' THEN 'no_gold_frequency' WHEN gold_annotations > 0 AND fq = '' THEN 'missing_prediction' WHEN fq = 'rare' THEN 'unparsed_prediction'
 WHEN fq <> '' AND k % 3 = 0 THEN 'wrong_span' WHEN NOT scope_ok THEN 'wrong_temporality' WHEN NOT period_hit THEN 'wrong_period' WHEN NOT count_hit THEN 'wrong_count' ELSE 'task_definition_mismatch' END AS failure_mode FROM md""")
def frequency_failure_modes(spark, d):
    scalars = scores(spark, d, "per_letter", "gold_annotations", "scope_ok", "period_hit", "count_hit")
    p = C.systems(spark, d).select("system", "document_id", F.col("fq").alias("predicted"), F.when(F.col("fq") == "rare", "unparsed").when(F.col("fq") == "", "").otherwise("rate").alias("parsed_class"),
                                   (F.col("fq") != "").alias("has_evidence"), (F.col("k") % 3 != 0).alias("evidence_overlaps"))
    return RV.frequency_failure_mode(scalars, p)


@query("fails_first_order", f"WITH {C.SCALARS} SELECT document_id, per_letter AS correct FROM sl WHERE system = 'A'")
def fails_first_order(spark, d):
    return RV.fails_first(scores(spark, d, "per_letter").filter("system = 'A'").select("document_id", F.col("per_letter").alias("correct")))


@query("frequency_rescore_gap", f"WITH {C.SCALARS} SELECT system, avg(CAST(loose AS INT)) AS loose_accuracy, avg(CAST(per_letter AS INT)) AS per_letter_accuracy, avg(CAST(per_letter AS INT)) - 0.68 AS gap_to_target, count(*) FILTER (loose AND NOT per_letter) AS invariant_breaches FROM sl GROUP BY 1")
def frequency_rescore_gap(spark, d):
    s = scores(spark, d, "loose", "per_letter")
    out = s.groupBy("system").agg(F.avg(F.col("loose").cast("double")).alias("loose_accuracy"), F.avg(F.col("per_letter").cast("double")).alias("per_letter_accuracy"), F.count_if(F.col("loose") & ~F.col("per_letter")).alias("invariant_breaches"))
    return out.withColumn("gap_to_target", F.col("per_letter_accuracy") - 0.68)


@query("gold_frequency_candidates", f"""WITH {C.BASE}, {C.GOLD_FREQ}, c AS (SELECT document_id, g[1] AS count, g[2] AS period_count, g[3] AS period_unit, CASE WHEN g[3] <> '' THEN 'rate' WHEN g[1] <> '' THEN 'count_only' ELSE '' END AS class FROM gf
 UNION SELECT document_id, CASE g[4] WHEN '2 per month' THEN '2' WHEN 'seizure free' THEN '0' ELSE '1' END, CASE g[4] WHEN 'seizure free' THEN '' ELSE '1' END, CASE g[4] WHEN '2 per month' THEN 'month' WHEN 'seizure free' THEN '' ELSE 'day' END, CASE g[4] WHEN 'seizure free' THEN 'seizure_free' ELSE 'rate' END FROM gf WHERE g[4] IN ('2 per month', 'seizure free', 'daily'))
SELECT DISTINCT document_id, count AS n, period_count, period_unit, class FROM c WHERE count <> '' OR period_count <> '' OR period_unit <> '' OR class <> ''""")
def gold_frequency_candidates(spark, d):
    return S.candidate_parts(C.gold(spark, d)["frequencies"]).withColumnRenamed("count", "n")


@query("first_gold_annotation", f"WITH {C.BASE}, {C.GOLD_FREQ} SELECT document_id, arg_min(g[4], ord) AS surface, count(*) AS annotations FROM gf GROUP BY 1")
def first_gold_annotation(spark, d):
    return C.gold(spark, d)["frequencies"].groupBy("document_id").agg(F.min_by("surface", "ord").alias("surface"), F.count(F.lit(1)).alias("annotations"))


# ---- grounding --------------------------------------------------------------------------

_GROUND = f"""{CLAIMS}, gq AS (SELECT clm.*, text, k, c, t, instr(lower(text), lower(value)) AS pos_ FROM clm JOIN sy USING (system, document_id))"""


@query("grounding_exact_share", f"""WITH {_GROUND}, e AS (SELECT *, regexp_extract(substr(text, 1, pos_ - 1), '[^.!?\\n]*$') || substr(text, pos_, length(value)) || regexp_extract(substr(text, pos_ + length(value)), '^[^.!?\\n]*') AS sent FROM gq WHERE pos_ > 0)
SELECT system, category, count(*) AS n FROM e WHERE NOT (contains(lower(sent), 'family') AND contains(lower(sent), 'history')) GROUP BY 1, 2""")
def grounding_exact_share(spark, d):
    return G.ground_records(C.records(spark, d)).filter("grounded_by = 'exact'").groupBy("system", "category").agg(F.count(F.lit(1)).alias("n"))


@query("grounding_cascade")
def grounding_cascade(spark, d):
    return G.ground_records(C.records(spark, d))


@query("grounding_statistics", f"WITH {CLAIMS} SELECT system, count(*) AS total_values, count(*) AS accounted FROM clm GROUP BY 1")
def grounding_statistics(spark, d):
    s = G.grounding_stats(G.ground_records(C.records(spark, d)), ["system"])
    return s.select("system", "total_values", (F.col("deterministic_hits") + F.col("fallback_hits") + F.col("ungrounded")).alias("accounted"))


@query("evidence_injection", f"""WITH {EVID} SELECT system, count(*) AS kept FROM evd GROUP BY 1""")
def evidence_injection(spark, d):
    """Old quotes all survive, in place: the mutation invariant of the injection."""
    r = C.records(spark, d)
    keys = ["system", "document_id"]
    new = G.inject_evidence(r.drop("text"), G.ground_records(r), keys)
    old_q, new_q = R.flatten_evidence(r.drop("text")), R.flatten_evidence(new)
    return old_q.join(new_q, [*keys, "path", "quote"], "left_semi").groupBy("system").agg(F.count(F.lit(1)).alias("kept"))


@query("external_answers", f"""WITH {C.BASE} SELECT document_id, CASE WHEN k % 2 = 0 THEN 'fallback' ELSE 'ungrounded' END AS grounded_by FROM bl""")
def external_answers(spark, d):
    b = C.base(spark, d)
    grounded = b.select("document_id", F.lit("p").alias("path"), F.lit(None).cast("string").alias("quote"), F.lit("ungrounded").alias("grounded_by"))
    answers = b.select("document_id", F.lit("p").alias("path"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("Seizures:   "), F.col("fq"))).otherwise("made up").alias("answer"))
    return G.apply_answers(grounded, answers, C.letters(spark, d), ["document_id"]).select("document_id", "grounded_by")


# ---- overlay, gold events, oracle of the aggregation ------------------------------------


@query("field_overlay", f"""WITH {C.BASE}, f AS (SELECT document_id, text, dx, CASE k % 3 WHEN 0 THEN dx WHEN 1 THEN 'absent words' END AS q, instr(text, 'Diagnosis: ') + 10 AS gs FROM bl WHERE dx <> ''),
p AS (SELECT *, instr(text, q) - 1 AS s FROM f) SELECT document_id, 'fields.epilepsy_diagnosis.value' AS field_path, CASE WHEN q IS NOT NULL AND s >= 0 AND s < gs + length(dx) AND s + length(q) > gs THEN 'overlaps_gold' WHEN q IS NOT NULL THEN 'evidence_only' ELSE 'ungrounded' END AS status FROM p""")
def field_overlay(spark, d):
    b = C.base(spark, d).filter("dx <> ''")
    q = F.when(F.col("k") % 3 == 0, F.array("dx")).when(F.col("k") % 3 == 1, F.array(F.lit("absent words"))).otherwise(F.array().cast("array<string>"))
    fields = b.select("document_id", F.lit("fields.epilepsy_diagnosis.value").alias("field_path"), F.lit("epilepsy_diagnosis").alias("field_group"), F.col("dx").alias("value"), F.lit("present").alias("missingness"), q.alias("quotes"), "text")
    at = F.instr("text", F.lit("Diagnosis: ")) + 10
    ann = b.select("document_id", F.lit("Diagnosis").alias("label"), F.lit("T1").alias("ann_id"), at.alias("char_start"), (at + F.length("dx")).alias("char_end"))
    return RV.field_overlay(fields, ann).select("document_id", "field_path", "status")


GEV = f"""{C.BASE}, {C.GOLD_FREQ}, gn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS n FROM gf),
gv AS (SELECT document_id, 'gold_med_1' AS id, 'medication' AS category, {pick_sql(C.MEDS_C, 'c + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END')} AS value FROM bs UNION ALL SELECT document_id, 'gold_freq_' || n, 'seizure_frequency', g[5] FROM gn WHERE g[5] <> ''
 UNION ALL SELECT document_id, 'gold_type_from_freq_' || n, 'seizure_type', st FROM gn WHERE g[5] <> '' UNION ALL SELECT document_id, 'gold_dx_1', 'diagnosis', v FROM (SELECT document_id, {pick_sql(C.DX_C, 'c + t + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END')} AS v FROM bs) WHERE v NOT IN ('', 'syncope')
 UNION ALL SELECT document_id, 'gold_eeg', 'investigation', CASE c % 3 WHEN 1 THEN 'normal' ELSE 'abnormal' END FROM bs WHERE c % 3 <> 0 UNION ALL SELECT document_id, 'gold_mri', 'investigation', 'normal' FROM bs WHERE t % 2 = 0)"""


@query("gold_events", f"WITH {GEV} SELECT * FROM gv")
def gold_events(spark, d):
    return SEL.gold_events(C.gold(spark, d)).select("document_id", "id", "category", "value")


@query("aggregation_oracle", f"""WITH {GEV} SELECT document_id, count(DISTINCT CASE WHEN category IN ('medication', 'diagnosis', 'investigation', 'seizure_frequency') THEN category || CASE WHEN category = 'investigation' THEN id ELSE '' END END)
 + count(DISTINCT CASE WHEN category = 'seizure_type' AND value <> 'dizzy turns' THEN value END) AS selected FROM gv GROUP BY 1""")
def aggregation_oracle(spark, d):
    """Gold events through the ranked selection: every field with a selectable candidate gets exactly one winner."""
    return SEL.aggregate_events(SEL.gold_events(C.gold(spark, d))).groupBy("document_id").agg(F.count(F.lit(1)).alias("selected"))


