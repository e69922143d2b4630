"""Sources, corpus and label audits, statistics, costs, payloads and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.functions.text import norm_source
from goldmeter.operators import corpus_audit as CA
from goldmeter.operators import label_audit as LA
from goldmeter.operators import statistics as ST
from goldmeter.sources import annotations as SA
from goldmeter.sources import artifacts as AR
from goldmeter.sources import letters as SL
from goldmeter.sources import markup as MK
from goldmeter.sources import runs as RU
from goldmeter.session import ensure_checkpoint_dir
from verify.base import WS, lit_sql, norm_label_sql, pick, pick_sql, query, table
from verify.function_queries import EV, coarse_sql, fine_sql, label_sql, label_text, rate_cte
from verify.match_queries import ANN, annotations


def scratch(spark) -> str:
    """A fresh folder below the shared one the cluster names (below /tmp only in a local session without one)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/goldmeter-{uuid.uuid4().hex}"


# ---- sources ----------------------------------------------------------------------------


@query("letter_source_shape", f"""SELECT 'D' || doc_id AS document_id, length(trim(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), {WS})) AS normalized_chars FROM documents""")
def letter_source_shape(spark, d):


    return table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), F.length(norm_source(F.col("text"))).alias("normalized_chars"))


def ann_files(spark, d):
    """One stand-off file per order line: two T lines, three A lines (one repeated name), an R and an N line."""
    p, s, n = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    text = F.concat(
        F.lit("T1\tPrescription "), p, F.lit(" "), (F.col("l_partkey") + 5).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ";900 910").otherwise(""), F.lit("\tword-"), n,
        F.lit("\nA1\tDrugDose T1 "), s, F.lit("\nA2\tDrugDose T1 "), n, F.lit("\nA3\tFlag T1\nT2\tDiagnosis 1 4\tabc\nR1\tLink Arg1:T1 Arg2:T2\nN1\tnote\nT9\tbroken"))
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return li.select(F.concat_ws("-", p, s, n).alias("document_id"), text.alias("text"))


AF = "af AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS document_id FROM lineitem)"


@query("annotation_file_parse", f"""WITH {AF} SELECT document_id, 'T1' AS ann_id, 'Prescription' AS label, CAST(p AS INT) AS char_start, CAST(CASE WHEN n % 2 = 0 THEN 910 ELSE p + 5 END AS INT) AS char_end, 'word-' || n AS annotation_text, CAST(n AS VARCHAR) AS dose, 'true' AS flag FROM af
 UNION ALL SELECT document_id, 'T2', 'Diagnosis', 1, 4, 'abc', NULL, NULL FROM af""")
def annotation_file_parse(spark, d):
    a = SA.parse_annotations(ann_files(spark, d))
    return a.select("document_id", "ann_id", "label", "char_start", "char_end", "annotation_text", F.try_element_at("attributes", F.lit("DrugDose")).alias("dose"), F.try_element_at("attributes", F.lit("Flag")).alias("flag"))


@query("relation_and_note_lines", f"WITH {AF} SELECT 'relation' AS kind, count(*) AS n FROM af UNION ALL SELECT 'note', count(*) FROM af")
def relation_and_note_lines(spark, d):
    return SA.relation_and_note_lines(ann_files(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("fragment_free_spans", f"WITH {AF} SELECT ann_id, count(*) AS n FROM (SELECT 'T1' AS ann_id FROM af WHERE n % 2 <> 0 UNION ALL SELECT 'T2' FROM af) GROUP BY 1")
def fragment_free_spans(spark, d):
    return SA.parse_annotations(ann_files(spark, d), fragments=False).groupBy("ann_id").agg(F.count(F.lit(1)).alias("n"))


@query("markup_table_parse", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 40 ELSE 200 END AS width, p_name AS name, 'a, "' || p_type || '"' || chr(10) || 'b' AS quoted, CASE WHEN p_partkey % 3 > 0 THEN 'last' END AS last FROM part""")
def markup_table_parse(spark, d):
    width = F.when(F.col("p_partkey") % 3 == 1, 36).otherwise(196)
    tail = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.repeat(F.lit(","), width), F.lit(", last"))).otherwise("")
    row = F.concat(F.col("p_partkey").cast("string"), F.lit(", "), F.col("p_name"), F.lit(' ,"a, ""'), F.col("p_type"), F.lit('""\nb"'), tail)
    lines = table(spark, d, "part").select("p_partkey", F.explode(MK.split_rows(F.concat(row, F.lit("\n")))).alias("line"))
    rows = MK.parse_markup_lines(lines)
    return rows.select("p_partkey", F.size("cells").alias("width"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("quoted"),
                       F.when(F.size("cells") > 3, F.element_at("cells", -1)).alias("last"))


def markup_lines(spark, d, cells):
    t = table(spark, d, "orders").select(F.monotonically_increasing_id().alias("row_no"), "o_orderkey", "o_custkey", F.floor("o_totalprice").alias("t"))
    return t.select("row_no", F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).alias("cells"))


@query("gold_medication_assembly", f"""SELECT 'O' || o_orderkey AS document_id, CASE WHEN o_custkey % 2 = 0 THEN 'levetiracetam' ELSE 'lamotrigine' END AS name, CAST(o_custkey AS VARCHAR) AS dose, 'mg' AS dose_unit, 'twice daily' AS frequency FROM orders""")
def gold_medication_assembly(spark, d):
    doc = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    name = F.when(F.col("o_custkey") % 2 == 0, "null").otherwise("Lamictal-25mg")
    return MK.gold_medications(markup_lines(spark, d, [doc, "1", "2", "C", name, "Keppra", F.concat(F.col("o_custkey").cast("string"), F.lit("mg")), "mg", "2", "x"])).drop("ord")


@query("gold_frequency_assembly", """WITH r AS (SELECT 'O' || o_orderkey AS document_id, CASE o_custkey % 4 WHEN 0 THEN '2-4' WHEN 1 THEN '3' WHEN 2 THEN '1' ELSE '' END AS count, CASE WHEN o_custkey % 4 < 3 THEN 'month' ELSE '' END AS period_unit FROM orders)
SELECT document_id, count AS n, CASE WHEN period_unit <> '' THEN '1' ELSE '' END AS period_count, period_unit, CASE WHEN period_unit <> '' THEN replace(count, '-', ' ') || ' per 1 month' ELSE count END AS value, 'focal seizure' AS seizure_type, 'since' AS temporal_scope FROM r""")
def gold_frequency_assembly(spark, d):
    doc = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    m = F.col("o_custkey") % 4
    rows = markup_lines(spark, d, [doc, "0", "3", "C", "focal-seizures", "null", "x", F.when(m == 1, "3").otherwise("null"), F.when(m == 0, "2").otherwise("null"), F.when(m == 0, "4").otherwise("null"),
                                   F.when(m < 3, "Months").otherwise("null"), "null", "Since", "null"])
    docs = table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("document_id"), F.lit("text").alias("text"))
    return MK.gold_frequencies(rows, docs).drop("ord", "surface").withColumnRenamed("count", "n")


def label_rows(spark, d):
    """Label records of the driver: gold label, reference label, evidence and analysis from the events table."""
    block = F.struct(
        F.when(F.col("event_id") % 9 != 0, F.array(F.upper(label_text(None)))).otherwise(F.array().cast("array<string>")).alias("seizure_frequency_number"),
        F.array(F.when(F.col("event_id") % 3 == 0, label_text(None, 3)).otherwise(label_text(None)), pick(SAID, F.col("event_id"))).alias("reference"), pick(ANALYSIS, F.col("event_id")).alias("analysis"))
    e = table(spark, d, "events").select(F.col("event_id").alias("source_row_index"), pick(TEXTS, F.col("event_id")).alias("clinic_date"), F.lit(True).alias("row_ok"), block.alias("check__Seizure Frequency Number"))
    return SL.label_example_rows(e)


SAID = ["6 months free", "no word", "3 seizures per week and clusters", "two years", "2 clusters per month", "5 to 6 events a day", "previously well"]
ANALYSIS = ["4 seizures over 2 months", "no further seizures since May", "previously several seizures", "currently stable", "3 seizures per cluster, 2 per week", ""]
TEXTS = ["no further seizures, still has seizures daily", "NEAD noted. since the last clinic", "every day he counts", "Ã broken he and she", "fine", "since last visit on 12/3"]
LR = f"""{EV}, lr AS (SELECT 'GAN' || event_id AS document_id, event_id, {norm_label_sql('upper(' + label_sql() + ')')} AS gold_label, {norm_label_sql('CASE WHEN event_id % 3 = 0 THEN ' + label_sql(3) + ' ELSE ' + label_sql() + ' END')} AS reference_label,
 {pick_sql(SAID, 'event_id')} AS said, {pick_sql(ANALYSIS, 'event_id')} AS analysis, {pick_sql(TEXTS, 'event_id')} AS text FROM ev WHERE event_id % 9 <> 0)"""


@query("label_example_scan", f"WITH {LR} SELECT document_id, gold_label, reference_label, said AS evidence_reference, analysis, text FROM lr")
def label_example_scan(spark, d):
    return label_rows(spark, d).select("document_id", "gold_label", "reference_label", "evidence_reference", "analysis", "text")


@query("entity_export_parse", "SELECT p_partkey AS document_id, 'Diagnosis' AS label, p_size AS char_start, p_size + 3 AS char_end, p_name AS annotation_text, p_type AS cui FROM part")
def entity_export_parse(spark, d):
    e = F.struct(F.lit("Diagnosis").alias("entity"), F.col("p_size").cast("string").alias("start_index"), (F.col("p_size") + 3).cast("string").alias("end_index"), F.col("p_name").alias("text"), F.create_map(F.lit("CUI"), F.col("p_type")).alias("attributes"))
    rows = SA.parse_entity_exports(table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.to_json(F.array(e)).alias("text")))
    return rows.select("document_id", "label", "char_start", "char_end", "annotation_text", F.col("attributes")["CUI"].alias("cui"))


@query("canonical_record_parse", "SELECT o_orderkey AS document_id, o_custkey % 5 <> 0 AS available, CASE WHEN o_custkey % 5 > 1 THEN 'pipe' || o_custkey END AS pipeline_id FROM orders")
def canonical_record_parse(spark, d):
    body = F.when(F.col("o_custkey") % 5 == 0, "not { json").when(F.col("o_custkey") % 5 == 1, '{"document_id": "x"}').otherwise(F.concat(F.lit('{"pipeline_id": "pipe'), F.col("o_custkey").cast("string"), F.lit('", "events": []}')))
    out = RU.parse_canonical(table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), body.alias("text")))
    return out.select("document_id", F.col("record").isNotNull().alias("available"), F.col("record.pipeline_id").alias("pipeline_id"))


@query("preferred_record_file", "SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CASE WHEN bool_or(l_linenumber = 1) THEN 'e4.json' ELSE 'e2.json' END AS file FROM lineitem GROUP BY 1")
def preferred_record_file(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("E2").alias("system"), F.col("l_orderkey").cast("string").alias("document_id"), F.when(F.col("l_linenumber") == 1, "e4.json").otherwise("e2.json").alias("file"))
    return RU.first_existing(rows, ["e4.json", "e2.json"]).select("document_id", "file")


@query("raw_response_metadata", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN 'DX' || o_orderkey ELSE 'd' || o_orderkey END AS document_id, 'h' || o_custkey % 4 AS harness_id, 'm1' AS model_label FROM orders")
def raw_response_metadata(spark, d):
    o = table(spark, d, "orders")
    folder = F.concat(F.lit("/runs/m1/h"), (F.col("o_custkey") % 4).cast("string"), F.lit("/d"), F.col("o_orderkey").cast("string"))
    raw = o.select(F.concat(folder, F.lit("/raw_response.txt")).alias("source_path"), F.col("o_orderkey").cast("string").alias("text"))
    side = RU.parse_canonical(o.filter("o_custkey % 3 = 0").select(F.concat(folder, F.lit("/canonical_projection.json")).alias("source_path"), F.concat(F.lit('{"document_id": "DX'), F.col("o_orderkey").cast("string"), F.lit('"}')).alias("text")))
    return RU.describe_raw_responses(raw, side).select(F.col("text").cast("bigint").alias("k"), "document_id", "harness_id", "model_label")


@query("run_log_round_trip", "SELECT event_type AS baseline, count(*) AS n, count(*) FILTER (value > 50) AS parsed FROM events GROUP BY 1")
def run_log_round_trip(spark, d):
    path = scratch(spark)
    flags = F.struct((F.col("value") > 50).alias("parse_success"))
    RU.append_run_log(table(spark, d, "events").select(F.col("event_type").alias("baseline"), F.col("user_id").cast("string").alias("document_id"), flags.alias("parse"), F.col("event_id").alias("log_order")), path)
    return RU.run_log(spark, path).groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.count_if("parse.parse_success").alias("parsed"))


@query("condition_log_rows", "SELECT system, count(*) AS n FROM (SELECT unnest(['S2', 'E2', 'E3']) AS system, event_type FROM events) WHERE (system = 'S2' AND event_type = 'view') OR (system = 'E2' AND event_type IN ('click', 'error')) OR (system = 'E3' AND event_type = 'signup') GROUP BY 1")
def condition_log_rows(spark, d):
    e = table(spark, d, "events")
    t = F.col("event_type")
    log = e.select(F.when(t == "view", "S2").alias("baseline"), F.when(t == "click", "E1").when(t == "error", "E2").when(t == "signup", "E3").alias("pipeline"))
    out = None
    for s in ("S2", "E2", "E3"):
        n = RU.log_rows_of_condition(log, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("system"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("csv_round_trip", "SELECT p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes, max(p_name || ' \"quoted\", ' || p_type) AS text FROM part GROUP BY 1")
def csv_round_trip(spark, d):
    path = scratch(spark) + "/csv"
    AR.write_table(table(spark, d, "part").select("p_type", "p_size", F.concat("p_name", F.lit(' "quoted", '), "p_type").alias("text")), path, "csv")
    back = AR.read_csv_table(spark, path, "p_type string, p_size bigint, text string")
    return back.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"), F.max("text").alias("text"))


@query("artifact_inventory", """SELECT doc_id AS id, doc_id % 4 <> 0 AS exists, CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'jsonl' ELSE 'other' END AS kind, CASE WHEN doc_id % 4 <> 0 THEN octet_length(encode(text)) END AS size_bytes, CASE WHEN doc_id % 4 <> 0 THEN sha256(text) END AS sha256 FROM documents""")
def artifact_inventory(spark, d):
    suffix = pick([".csv", ".jsonl", ".txt"], F.col("doc_id"))
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), suffix).alias("path"), F.col("text").cast("binary").alias("content"))
    seen = AR.describe_contents(t.filter("doc_id % 4 <> 0").select("path", "content"))
    return AR.artifact_inventory(t.select(F.col("doc_id").alias("id"), "path"), seen).select("id", "exists", "kind", "size_bytes", "sha256")


@query("imported_scores", "SELECT 'mine' AS condition, count(*) AS n FROM events WHERE event_type = 'view'")
def imported_scores(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("system"), "event_id")
    return RU.import_scores(e, "view", "mine").groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query("split_ids_prefix", """SELECT doc_id AS document_id, pos FROM (SELECT doc_id, doc_id % 3 AS s, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS pos FROM documents) WHERE s = 1 AND pos < 50""")
def split_ids_prefix(spark, d):
    w = W.partitionBy(F.col("doc_id") % 3).orderBy("doc_id")
    s = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), pick(["development", "validation", "test"], F.col("doc_id")).alias("split"), (F.row_number().over(w) - 1).alias("pos"))
    return SL.split_ids(s, "validation", 50).select("document_id", "pos")


# ---- annotation audits ------------------------------------------------------------------


@query("span_integrity", f"""WITH {ANN}, x AS (SELECT d, n, s, e, 'The quick-brown fox jumps over the lazy dog and runs far away from here while the sun sets slowly over the distant hills of home tonight my friend ok yes' AS text, n % 6 AS v FROM ann),
y AS (SELECT *, CASE WHEN e <= length(text) THEN substr(text, s + 1, e - s) ELSE '' END AS cut FROM x),
z AS (SELECT *, CASE v WHEN 0 THEN cut WHEN 1 THEN cut || ' tail' WHEN 2 THEN 'zzz' WHEN 3 THEN substr(cut, 2) WHEN 4 THEN upper(cut) ELSE substr(text, s + 1, e - s + 1) END AS span FROM y),
w AS (SELECT *, lower(trim(replace(span, '-', ' '))) AS nn, lower(trim(replace(cut, '-', ' '))) AS mm FROM z)
SELECT d AS document_id, 'T' || n AS ann_id, CASE WHEN nn = mm THEN 'clean' WHEN cut <> '' AND trim(rtrim(cut, '-')) = trim(rtrim(trim(span), '-')) THEN 'trailing_separator' WHEN cut <> '' AND trim(ltrim(cut, '-')) = trim(ltrim(trim(span), '-')) THEN 'leading_separator'
 WHEN cut <> '' AND starts_with(mm, nn) AND length(nn) < length(mm) THEN 'truncated_span' WHEN cut <> '' AND starts_with(nn, mm) AND length(mm) < length(nn) THEN 'span_longer_than_source' WHEN cut <> '' AND (contains(mm, nn) OR contains(nn, mm)) THEN 'partial_overlap'
 WHEN cut = '' THEN 'offset_out_of_range' WHEN nn = lower(trim(replace(substr(text, greatest(s - 1, 0) + 1, e - greatest(s - 1, 0)), '-', ' '))) OR nn = lower(trim(replace(substr(text, s + 1, least(length(text), e + 1) - s), '-', ' '))) THEN 'off_by_one' ELSE 'mismatch' END AS issue_type FROM w""")
def span_integrity(spark, d):
    text = "The quick-brown fox jumps over the lazy dog and runs far away from here while the sun sets slowly over the distant hills of home tonight my friend ok yes"
    a = annotations(spark, d)
    s, e, v, tx = F.col("char_start"), F.col("char_end"), F.col("line_no") % 6, F.lit(text)
    cut = F.when(e <= len(text), F.substring(tx, s + 1, e - s)).otherwise("")
    span = (F.when(v == 0, cut).when(v == 1, F.concat(cut, F.lit(" tail"))).when(v == 2, "zzz").when(v == 3, F.substring(cut, F.lit(2), F.length(cut))).when(v == 4, F.upper(cut)).otherwise(F.substring(tx, s + 1, e - s + 1)))
    a = a.withColumn("annotation_text", F.trim(span))
    docs = a.select("document_id").distinct().withColumn("text", tx)
    return CA.span_integrity(a, docs).select("document_id", "ann_id", "issue_type")


@query("concept_specificity", f"WITH {ANN} SELECT label, CASE WHEN concept = '' THEN 'missing' ELSE 'generic' END AS cuiphrase_class, count(*) AS n FROM ann GROUP BY 1, 2")
def concept_specificity(spark, d):
    return CA.concept_specificity(annotations(spark, d)).groupBy("label", "cuiphrase_class").agg(F.count(F.lit(1)).alias("n"))


@query("prescription_completeness", f"WITH {ANN} SELECT d AS document_id, 'T' || n AS ann_id, true AS has_dose, false AS has_frequency, dose = n % 10 AND n < 10 OR (n >= 10 AND dose = n) AS dose_in_span FROM ann WHERE label = 'Prescription'")
def prescription_completeness(spark, d):
    return CA.prescriptions(annotations(spark, d)).select("document_id", "ann_id", "has_dose", "has_frequency", "dose_in_span")


def freq_annotations(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    attrs = F.map_filter(F.create_map(
        F.lit("NumberOfSeizures"), pick(["0", "2", None, "x"], k), F.lit("TimePeriod"), F.when(k % 3 == 0, "Week"), F.lit("PointInTime"), F.when(k % 5 == 0, "Now"),
        F.lit("UpperNumberOfSeizures"), F.when(k % 7 == 0, "4"), F.lit("CUIPhrase"), F.when(k % 2 == 0, "seizures")), lambda a, v: v.isNotNull())
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("ann_id"), F.lit("SeizureFrequency").alias("label"), F.lit("span").alias("annotation_text"), attrs.alias("attributes"))


@query("frequency_statements", f"""WITH {EV}, f AS (SELECT user_id AS document_id, 'T' || event_id AS ann_id, (['0', '2', NULL, 'x'])[k % 4 + 1] AS n, CASE WHEN k % 7 = 0 THEN '4' END AS u, k % 3 = 0 AS p, k % 5 = 0 AS s, k FROM ev)
SELECT document_id, ann_id, coalesce(n = '0', false) AS is_seizure_free, CASE WHEN n = 'x' THEN false WHEN n = '2' THEN true WHEN u = '4' THEN true ELSE false END AS is_active,
 coalesce(array_to_string(list_filter([CASE WHEN (n IS NOT NULL OR u IS NOT NULL) AND NOT p AND NOT s THEN 'count_without_period_or_scope' END, CASE WHEN n IS NULL AND u IS NULL AND NOT p AND NOT s THEN 'no_count_no_period_no_scope' END, CASE WHEN k % 2 <> 0 THEN 'missing_cuiphrase' END], lambda x: x IS NOT NULL), '; '), '') AS issues FROM f""")
def frequency_statements(spark, d):
    return CA.frequency_statements(freq_annotations(spark, d)).select("document_id", "ann_id", "is_seizure_free", "is_active", "issues")


@query("attribute_completeness", f"""WITH {ANN} SELECT label, d AS document_id, count(*) AS count, count(*) FILTER (label IN ('Diagnosis', 'PatientHistory')) AS missing_negation, count(*) AS missing_certainty, count(*) AS missing_cui, 0.0::DOUBLE AS certainty_rate FROM ann GROUP BY GROUPING SETS ((label, d), (label))""")
def attribute_completeness(spark, d):
    return CA.attribute_completeness(annotations(spark, d)).select("label", "document_id", "count", "missing_negation", "missing_certainty", "missing_cui", "certainty_rate")


@query("low_count_documents", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT avg(n) - 2 * stddev_samp(n) AS lim FROM c) SELECT user_id, n, n < lim AS is_outlier FROM c, m")
def low_count_documents(spark, d):
    return CA.low_count_documents(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))).select("user_id", "n", "is_outlier")


@query("temporal_sparsity", f"""WITH {EV} SELECT user_id AS document_id, count(*) AS n FROM ev WHERE k % 3 <> 0 AND k % 5 <> 0 GROUP BY 1""")
def temporal_sparsity(spark, d):
    return CA.temporal_sparsity(freq_annotations(spark, d)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("incomplete_prescriptions", f"WITH {ANN} SELECT 'DrugName|DoseUnit|Frequency' AS missing_fields, count(*) AS n FROM ann WHERE label = 'Prescription'")
def incomplete_prescriptions(spark, d):
    return CA.incomplete_prescriptions(annotations(spark, d)).groupBy("missing_fields").agg(F.count(F.lit(1)).alias("n"))


@query("timeline_events", f"WITH {EV} SELECT 'T' || event_id AS ann_id, CASE WHEN k % 3 = 0 THEN 'Week' ELSE '' END AS period, CASE WHEN k % 5 = 0 THEN 'Now' ELSE '' END AS point_in_time FROM ev WHERE k % 3 = 0 OR k % 5 = 0")
def timeline_events(spark, d):
    a = freq_annotations(spark, d).withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(1))
    return CA.timeline(a).select("ann_id", "period", "point_in_time")


def manifest_annotations(spark, d):
    a = annotations(spark, d)
    more = F.map_filter(F.create_map(F.lit("Negation"), F.when(F.col("line_no") % 4 == 0, "Negated"), F.lit("Certainty"), (F.col("line_no") % 6).cast("string")), lambda k, v: v.isNotNull())
    return a.withColumn("attributes", F.map_concat("attributes", more))


@query("entity_flags", f"WITH {ANN} SELECT label, count(*) FILTER (n % 4 = 0) AS negated, count(*) FILTER (n % 6 < 5) AS low_certainty, 0 AS unknown_type FROM ann GROUP BY 1")
def entity_flags(spark, d):
    return CA.entity_flags(manifest_annotations(spark, d)).groupBy("label").agg(F.count_if("negated").alias("negated"), F.count_if("low_certainty").alias("low_certainty"), F.count_if("unknown_type").alias("unknown_type"))


@query("letter_manifest", f"""WITH {ANN}, sh AS (SELECT d, count(*) AS c FROM (SELECT d, s, e FROM ann GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1)
SELECT ann.d AS document_id, count(*) AS entities, count(*) FILTER (label = 'Diagnosis') AS "n_Diagnosis", count(*) FILTER (label = 'Prescription') AS incomplete_medications, count(*) FILTER (label IN ('Prescription', 'SeizureFrequency', 'PatientHistory')) AS temporal_sparse,
 count(*) FILTER (n % 4 = 0) AS negated, coalesce(any_value(sh.c), 0) AS overlapping_spans FROM ann LEFT JOIN sh USING (d) GROUP BY 1""")
def letter_manifest(spark, d):
    return CA.letter_manifest(manifest_annotations(spark, d), ["Diagnosis"]).select("document_id", "entities", "n_Diagnosis", "incomplete_medications", "temporal_sparse", "negated", "overlapping_spans")


@query("annotation_corpus_summary", f"""WITH {ANN} SELECT "check", measure, n FROM (SELECT 'concept' AS "check", CASE WHEN concept = '' THEN 'missing' ELSE 'generic' END AS measure, count(*) AS n FROM ann GROUP BY 1, 2 UNION ALL SELECT 'prescription', 'total', count(*) FROM ann WHERE label = 'Prescription'
 UNION ALL SELECT 'prescription', 'missing_unit', count(*) FROM ann WHERE label = 'Prescription' UNION ALL SELECT 'letters', 'total', count(*) FROM documents)""")
def annotation_corpus_summary(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), "text")
    a = annotations(spark, d).withColumn("document_id", F.concat(F.lit("O"), F.col("document_id").cast("string")))
    out = CA.corpus_summary(a, docs)
    return out.filter((F.col("check") == "concept") | ((F.col("check") == "prescription") & F.col("measure").isin("total", "missing_unit")) | ((F.col("check") == "letters") & (F.col("measure") == "total")))


@query("annotation_location_flags", """SELECT count(DISTINCT o_orderkey) AS documents, count(*) AS annotations, count(*) FILTER (o_custkey % 4 IN (1, 3)) AS offset_mismatches, count(*) FILTER (o_custkey % 4 = 3) AS document_mismatches FROM orders""")
def annotation_location_flags(spark, d):
    k = F.col("o_custkey") % 4
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("document_id"), k.alias("v"), F.lit("He had Tonic–Clonic  fits here").alias("text"))
    a = o.select("document_id", "v", F.lit("T1").alias("ann_id"), F.when(F.col("v") == 1, 0).otherwise(7).alias("char_start"), F.when(F.col("v") == 1, 4).otherwise(25).alias("char_end"), F.when(F.col("v") == 3, "absent").otherwise("tonic-clonic fits").alias("annotation_text"))
    return CA.location_summary(SA.locate_annotations(a, o.select("document_id", "text")))


# ---- label audits -----------------------------------------------------------------------

LRX = f"{LR}, gx AS ({rate_cte('lr', 'gold_label', 'document_id AS di', 'g')}), rx AS ({rate_cte('lr', 'reference_label', 'document_id AS di', 'r')}), la AS (SELECT lr.*, g, r, {coarse_sql('g')} AS gp, {coarse_sql('r')} AS rp FROM lr JOIN gx ON gx.di = document_id JOIN rx ON rx.di = document_id)"
_U = "('unknown', 'no seizure frequency reference')"


@query("label_reference_consistency", f"""WITH {LRX} SELECT document_id, CASE WHEN gold_label = '' OR reference_label = '' THEN 'missing_field' WHEN gold_label = reference_label THEN 'match' WHEN reference_label IN {_U} AND gold_label NOT IN {_U} THEN 'ref_unknown_label_specific'
 WHEN reference_label NOT IN {_U} AND gold_label IN {_U} THEN 'ref_specific_label_unknown' WHEN starts_with(reference_label, 'seizure free') AND NOT starts_with(gold_label, 'seizure free') THEN 'ref_seizure_free_label_rate'
 WHEN starts_with(gold_label, 'seizure free') AND NOT starts_with(reference_label, 'seizure free') THEN 'ref_rate_label_seizure_free' ELSE 'ref_rate_differs' END AS mismatch_type, gp <> rp AS category_changes FROM la""")
def label_reference_consistency(spark, d):
    return LA.reference_consistency(label_rows(spark, d)).select("document_id", "mismatch_type", "category_changes")


@query("label_parsability", f"""WITH {LRX} SELECT document_id, CASE WHEN g <> 1000 THEN g END AS x_per_month, gp AS pragmatic, {fine_sql('g')} AS purist, {' OR '.join(f"regexp_matches(gold_label, {lit_sql(p)})" for p in LA.LABEL_FORMS)} AS matches_pattern, g = 1000 AND gold_label NOT IN {_U} AS unparsable FROM la""")
def label_parsability(spark, d):
    return LA.parsability(label_rows(spark, d)).select("document_id", "x_per_month", "pragmatic", "purist", "matches_pattern", "unparsable")


@query("vague_label_evidence", f"""WITH {LR} SELECT document_id, CASE WHEN event_id % 7 = 0 THEN '6 months' WHEN event_id % 6 = 0 THEN '2 months' WHEN event_id % 7 = 3 THEN 'two years' ELSE '' END AS found FROM lr WHERE gold_label IN ('seizure free for multiple month', 'seizure free for multiple year')
UNION ALL SELECT document_id, CASE WHEN event_id % 7 = 2 THEN '3 seizures per' WHEN event_id % 7 = 5 THEN '5 to 6 events a' WHEN event_id % 6 = 4 THEN '3 seizures per' ELSE '' END FROM lr WHERE regexp_matches(gold_label, '^multiple per (day|week|month|year)$')""")
def vague_label_evidence(spark, d):
    e = label_rows(spark, d)
    dur = LA.vague_durations(e).select("document_id", F.col("specific_duration_found").alias("found"))
    return dur.unionByName(LA.vague_counts(e).select("document_id", F.col("specific_count_found").alias("found")))


@query("label_analysis_consistency", f"""WITH {LR}, f AS (SELECT *, event_id % 6 AS a, starts_with(gold_label, 'seizure free') AS fr, gold_label IN {_U} AS un FROM lr)
SELECT document_id, a = 0 AS arithmetic_found, coalesce(array_to_string(list_filter([CASE WHEN a = 0 AND NOT starts_with(gold_label, '4 per 2') THEN 'arithmetic_mismatch' END, CASE WHEN a = 1 AND NOT fr AND NOT un THEN 'seizure_free_in_analysis_but_label_is_rate' END,
 CASE WHEN fr AND a IN (0, 2, 4) THEN 'label_seizure_free_but_analysis_has_active_seizures' END, CASE WHEN a = 2 THEN 'historical_language_may_affect_current_label' END, CASE WHEN gold_label = 'unknown' AND a IN (0, 4) THEN 'unknown_label_but_specific_rate_in_analysis' END], lambda x: x IS NOT NULL), '; '), '') AS issues FROM f""")
def label_analysis_consistency(spark, d):
    return LA.analysis_consistency(label_rows(spark, d)).select("document_id", "arithmetic_found", "issues")


@query("label_cluster_handling", f"""WITH {LRX} SELECT document_id, contains(gold_label, 'cluster per') AS is_cluster_label, CASE WHEN event_id % 7 = 4 AND event_id % 6 = 4 AND NOT contains(gold_label, 'cluster per') THEN 6.0::DOUBLE END AS estimate_per_month,
 event_id % 7 = 4 AND event_id % 6 = 4 AND NOT contains(gold_label, 'cluster per') AND gp <> 'frequent' AS category_change_possible FROM la WHERE event_id % 7 IN (2, 4) OR event_id % 6 = 4""")
def label_cluster_handling(spark, d):
    return LA.cluster_handling(label_rows(spark, d)).select("document_id", "is_cluster_label", "estimate_per_month", "category_change_possible")


@query("letter_contradictions", f"""WITH {LR}, f AS (SELECT *, event_id % 6 AS a, starts_with(gold_label, 'seizure free') AS fr FROM lr), g AS (SELECT *, a = 0 AS c, (a IN (0, 2, 4)) AND fr AS fm, a = 1 AND fr AS ne FROM f)
SELECT document_id, CASE WHEN c AND fm THEN 'irresolvable' WHEN c OR fm OR ne THEN 'annotator_dependent' ELSE 'acceptable' END AS severity FROM g""")
def letter_contradictions(spark, d):
    return LA.letter_contradictions(label_rows(spark, d)).select("document_id", "severity")


PREDS = f"""{LRX}, pr AS (SELECT document_id AS di, {norm_label_sql(label_sql(1).replace('event_id', 'ev.event_id').replace(' k ', ' ev.k '))} AS pl FROM ev JOIN lr ON lr.event_id = ev.event_id), px AS ({rate_cte('pr', 'pl', 'di, pl', 'p')}),
sc AS (SELECT document_id, event_id, gold_label, pl AS predicted_label, gp AS gold_pragmatic, {coarse_sql('p')} AS predicted_pragmatic, {fine_sql('g')} AS gold_purist, {fine_sql('p')} AS predicted_purist, gold_label = pl AS exact_label_match, g, p FROM la JOIN px ON px.di = document_id)"""


def scored_labels(spark, d):
    pred = table(spark, d, "events").select(F.concat(F.lit("GAN"), F.col("event_id").cast("string")).alias("document_id"), label_text(None, 1).alias("predicted_label"))
    return LA.evaluate_labels(label_rows(spark, d), pred)


@query("label_evaluation", f"WITH {PREDS} SELECT document_id, gold_label, predicted_label, gold_pragmatic, predicted_pragmatic, gold_purist, predicted_purist, exact_label_match FROM sc")
def label_evaluation(spark, d):
    return scored_labels(spark, d).select("document_id", "gold_label", "predicted_label", "gold_pragmatic", "predicted_pragmatic", "gold_purist", "predicted_purist", "exact_label_match")


BUCK = f"""{PREDS}, wr AS (SELECT *, predicted_label NOT IN {_U} AS sp FROM sc WHERE NOT (exact_label_match AND gold_pragmatic = predicted_pragmatic)),
bu AS (SELECT document_id, list_filter([CASE WHEN gold_pragmatic = 'NS' AND predicted_pragmatic = 'UNK' THEN 'gold_NS_pred_UNK' END, CASE WHEN gold_pragmatic = 'NS' AND predicted_pragmatic = 'frequent' THEN 'gold_NS_pred_frequent' END,
 CASE WHEN gold_pragmatic = 'UNK' AND predicted_pragmatic NOT IN ('UNK', 'NS') THEN 'gold_UNK_pred_numeric' END, CASE WHEN gold_pragmatic = 'UNK' AND predicted_pragmatic = 'NS' THEN 'gold_UNK_pred_NS' END,
 CASE WHEN gold_pragmatic = 'infrequent' AND predicted_pragmatic = 'frequent' THEN 'threshold_flip_infrequent_to_frequent' END, CASE WHEN gold_pragmatic = 'frequent' AND predicted_pragmatic = 'infrequent' THEN 'threshold_flip_frequent_to_infrequent' END,
 CASE WHEN contains(gold_label, 'cluster') AND NOT contains(predicted_label, 'cluster') AND sp THEN 'cluster_collapsed_to_plain_rate' END, CASE WHEN contains(gold_label, ' to ') AND NOT contains(predicted_label, ' to ') AND sp THEN 'range_collapsed_to_single_value' END,
 CASE WHEN gold_label = 'no seizure frequency reference' AND predicted_label = 'unknown' THEN 'no_ref_confused_with_unknown' END, CASE WHEN gold_label = 'unknown' AND predicted_label = 'no seizure frequency reference' THEN 'unknown_confused_with_no_ref' END,
 CASE WHEN event_id % 2 = 0 THEN 'quote_missing' END], lambda x: x IS NOT NULL) AS b FROM wr)"""


@query("label_error_buckets", f"WITH {BUCK} SELECT bucket, count(*) AS n FROM (SELECT unnest(CASE WHEN len(b) = 0 THEN ['other'] ELSE b END) AS bucket FROM bu) GROUP BY 1")
def label_error_buckets(spark, d):
    n = F.regexp_extract("document_id", "[0-9]+", 0).cast("bigint")
    return LA.bucket_counts(LA.error_buckets(scored_labels(spark, d).withColumn("quote", F.when(n % 2 == 0, " ").otherwise("said"))))


@query("label_distribution", f"WITH {LRX} SELECT gp AS pragmatic, count(*) AS n FROM la GROUP BY 1")
def label_distribution(spark, d):
    return ST.value_counts(LA.label_categories(label_rows(spark, d)), ["pragmatic"])


@query("label_sweep", f"""WITH {PREDS} SELECT 'h' || event_id % 4 AS harness, count(*) AS documents, avg(CAST(gold_pragmatic = predicted_pragmatic AS INT)) AS pragmatic_micro_f1, avg(CAST(gold_purist = predicted_purist AS INT)) AS purist_micro_f1, avg(CAST(exact_label_match AS INT)) AS exact_label_accuracy,
 avg(CAST(gold_pragmatic = predicted_pragmatic AS INT)) >= 0.75 AS promoted FROM sc GROUP BY 1""")
def label_sweep(spark, d):
    n = F.regexp_extract("document_id", "[0-9]+", 0).cast("bigint")
    return LA.sweep_table(scored_labels(spark, d).withColumn("harness", F.concat(F.lit("h"), (n % 4).cast("string"))), ["harness"])


@query("label_failure_modes", f"""WITH {PREDS} SELECT document_id, CASE WHEN exact_label_match THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'evidence_missing_or_invalid' END WHEN gold_pragmatic = predicted_pragmatic AND gold_purist <> predicted_purist THEN 'purist_wrong_pragmatic_correct'
 WHEN gold_purist = predicted_purist OR gold_pragmatic = predicted_pragmatic THEN 'exact_label_mismatch_category_correct' WHEN (gold_pragmatic = 'UNK' AND predicted_pragmatic = 'NS') OR (gold_pragmatic = 'NS' AND predicted_pragmatic = 'UNK') THEN 'unknown_vs_no_reference'
 WHEN gold_pragmatic = 'UNK' OR predicted_pragmatic = 'UNK' THEN 'unknown_vs_specific' WHEN gold_pragmatic = 'NS' OR predicted_pragmatic = 'NS' THEN 'ns_vs_short_seizure_free' WHEN abs(g - 1.1) <= 0.25 OR abs(p - 1.1) <= 0.25 THEN 'frequent_infrequent_boundary'
 WHEN contains(gold_label, 'cluster') OR contains(predicted_label, 'cluster') THEN 'cluster_format_error' WHEN contains(gold_label, ' to ') OR contains(predicted_label, ' to ') THEN 'range_format_error' ELSE 'highest_frequency_error' END AS mode FROM sc""")
def label_failure_modes(spark, d):
    n = F.regexp_extract("document_id", "[0-9]+", 0).cast("bigint")
    s = scored_labels(spark, d)
    return s.select("document_id", LA.label_failure(F.col("gold_label"), F.col("predicted_label"), F.col("gold_x"), F.col("predicted_x"), n % 2 == 0).alias("mode"))


@query("label_corpus_summary", f"""WITH {LRX} SELECT 'pragmatic' AS "check", gp AS measure, count(*) AS n FROM la GROUP BY 1, 2 UNION ALL SELECT 'vague_count', 'total', count(*) FROM la WHERE regexp_matches(gold_label, '^multiple per (day|week|month|year)$') UNION ALL SELECT 'analysis', 'total', count(*) FROM la""")
def label_corpus_summary(spark, d):
    e = label_rows(spark, d)
    out = LA.corpus_summary(e, e)
    return out.filter((F.col("check") == "pragmatic") | (F.col("check").isin("vague_count", "analysis") & (F.col("measure") == "total")))


