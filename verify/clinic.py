"""Clinic corpus derived from the orders table: one letter, two extractions and gold per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.functions.text import computed_once
from goldmeter.operators import matching as M
from goldmeter.sources.schemas import CANONICAL
from verify.base import lit_sql, pick, pick_sql, table

MEDS = ["Keppra", "lamictal", "Epilim", "sodium valproate", "carbamazepine", "vitamin D", "Topamax", "levitiracetam", "zonegran", "clobazam"]
MEDS_C = ["levetiracetam", "lamotrigine", "sodium valproate", "sodium valproate", "carbamazepine", "vitamin d", "topiramate", "levetiracetam", "zonisamide", "clobazam"]
DOSE, DOSE_C = ["500 mg", "250mg", "1.5 g", ""], ["500", "250", "1.5", ""]
UNIT, UNIT_C = ["mg", "Milligrams", "g", ""], ["mg", "mg", "g", ""]
SCHED, SCHED_C = ["bd", "2", "nocte", "once daily", ""], ["twice daily", "twice daily", "nightly", "once daily", ""]
TYPE = ["focal seizures", "absence", "GTC", "seizures", "dizzy turns"]
TYPE_C = ["focal seizure", "generalized absence seizure", "generalized tonic clonic seizure", "unknown seizure type", "dizzy turns"]
TYPE_K = ["focal seizure or epilepsy", "generalized seizure or epilepsy", "generalized seizure or epilepsy", "unknown seizure or epilepsy", "unknown seizure or epilepsy"]
FREQ = ["2 per month", "seizure free", "every 3 weeks", "3 to 5 seizures per week", "daily", "", "rare"]
FREQ_P = [("2", "1", "month", "rate"), ("0", "", "", "seizure_free"), ("1", "3", "week", "rate"), ("3-5", "1", "week", "rate"), ("1", "1", "day", "rate"), ("", "", "", ""), ("", "", "", "unparsed")]
FREQ_X = [2.0, 0.0, 4.0 / 3.0, 16.0, 30.0, 1000.0, 1000.0]
RESULT, RESULT_C, STATUS = ["normal", "abnormal", "not_stated", "uncertain"], ["normal", "abnormal", "", "uncertain"], ["completed", "completed", "not_stated", "requested"]
DX, DX_C = ["epilepsy", "Focal epilepsy", "JME", "generalised epilepsy", "syncope", ""], ["epilepsy", "focal epilepsy", "juvenile myoclonic epilepsy", "generalized epilepsy", "syncope", ""]
DX_K = ["unknown_epilepsy", "focal_epilepsy", "generalized_epilepsy", "generalized_epilepsy", "", ""]
MED_TIME, MED_STATUS = ["current", "current", "historical"], ["current", "increased", "previous"]
# gold frequency forms: count, period count, unit, surface, value
GOLD_F = [("2", "1", "month", "2 per month", "2 per 1 month"), ("", "", "", "seizure free", ""), ("3-5", "1", "week", "often", "3 5 per 1 week"), ("1", "1", "day", "daily", "1 per 1 day"), None]
GOLD_F_X = [2.0, 0.0, 16.0, 30.0, 1000.0]

LETTER = ["Dear Dr Smith,\n\nMedication:\n- ", "@m1", " ", "@d1", " ", "@s1", "\n- Vitamin B\n\nSeizures: ", "@fq", ". He has ", "@ty", ".", "@trap",
          "\n\nInvestigations:\nEEG was ", "@eeg", ".\nMRI: ", "@mri", ".\n\nDiagnosis: ", "@dx", ".\n"]
TRAP = " Family history of clobazam use. He previously was on lamotrigine 50 mg."


def _spark_letter():
    return F.concat(*[F.col(p[1:]) if p.startswith("@") else F.lit(p) for p in LETTER])


def _sql_letter() -> str:
    return " || ".join(p[1:] if p.startswith("@") else lit_sql(p) for p in LETTER)


def base(spark: SparkSession, d: str) -> DataFrame:
    """Flat values of every order; `text` is the letter (written from the values of system A)."""
    k, c, t = F.col("k"), F.col("c"), F.col("t")
    o = table(spark, d, "orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("document_id"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.floor("o_totalprice").alias("t"))
    # narrow rows are placed by document before letters and records are written, so later joins on the document find them in place
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id")
    o = o.select(
        "document_id", "k", "c", "t", pick(MEDS, c).alias("m1"), pick(DOSE, k).alias("d1"), pick(UNIT, k).alias("u1"),
        pick(SCHED, t).alias("s1"), pick(FREQ, k).alias("fq"), pick(TYPE, t).alias("ty"), pick(RESULT, c).alias("eeg"), pick(RESULT, t).alias("mri"),
        pick(DX, c + t).alias("dx"), F.when(k % 5 == 0, TRAP).otherwise("").alias("trap"))
    return o.withColumn("text", _spark_letter())


BASE = f"""bs AS (SELECT 'O' || o_orderkey AS document_id, o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders),
bt AS (SELECT *, {pick_sql(MEDS, 'c')} AS m1, {pick_sql(DOSE, 'k')} AS d1, {pick_sql(UNIT, 'k')} AS u1, {pick_sql(SCHED, 't')} AS s1, {pick_sql(FREQ, 'k')} AS fq, {pick_sql(TYPE, 't')} AS ty,
 {pick_sql(RESULT, 'c')} AS eeg, {pick_sql(RESULT, 't')} AS mri, {pick_sql(DX, 'c + t')} AS dx, CASE WHEN k % 5 = 0 THEN {lit_sql(TRAP)} ELSE '' END AS trap FROM bs),
bl AS (SELECT *, {_sql_letter()} AS text FROM bt)"""


def letters(spark, d):
    return base(spark, d).select("document_id", "text")


def systems(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the available extractions: system A everywhere, B (shifted by one) except every tenth order."""
    b = base(spark, d)
    out = b.withColumn("off", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("off") == 0) | (F.col("k") % 10 != 0))
    return out.withColumn("system", F.when(F.col("off") == 0, "A").otherwise("B"))


SYS = f"{BASE}, sy AS (SELECT bl.*, v.off, v.system FROM bl, (VALUES (0, 'A'), (1, 'B')) v(off, system) WHERE v.off = 0 OR k % 10 <> 0)"


def expected(spark, d):
    return M.expected_pairs(base(spark, d).select("document_id"), ["A", "B"])


def _ev(*quotes):
    made = F.array(*[F.struct(q.alias("quote"), F.lit(None).cast("string").alias("sentence_id"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end")) for q in quotes])
    return F.filter(made, lambda e: e["quote"].isNotNull())


def records(spark: SparkSession, d: str) -> DataFrame:
    """records(system, document_id, record, text) for the scoring flow."""
    s = systems(spark, d)
    k, c, t, off = F.col("k"), F.col("c"), F.col("t"), F.col("off")
    none = F.lit(None).cast("string")
    ids = F.array().cast("array<string>")
    quote = F.when(k % 5 == 1, F.lit("not in the letter")).when(k % 5 != 0, F.col("m1"))

    def med(name, present):
        made = F.struct(name.alias("name"), F.col("d1").alias("dose"), F.col("u1").alias("dose_unit"), F.col("s1").alias("frequency"), pick(MED_STATUS, k).alias("status"),
                        F.lit("present").alias("missingness"), pick(MED_TIME, k).alias("temporality"), _ev(quote).alias("evidence"), ids.alias("evidence_event_ids"))
        return F.when(present, made)

    def scalar(value, evidence, temporality="current"):
        there = value != ""
        return [F.when(there, value).alias("value"), F.when(there, "present").otherwise("not_stated").alias("missingness"),
                F.when(there, temporality).otherwise("uncertain").alias("temporality")], F.when(there, evidence).alias("evidence")

    def struct(value, evidence, *extra):
        head, ev = scalar(value, evidence)
        return F.struct(*head, *extra, ev, ids.alias("evidence_event_ids"))

    def inv(i, name):
        st = pick(STATUS, i)
        return F.struct(st.alias("status"), F.col(name).alias("result"), F.when(st == "not_stated", "not_stated").otherwise("present").alias("missingness"),
                        F.when(st == "completed", "completed").otherwise("uncertain").alias("temporality"), _ev(F.when(st != "not_stated", F.col(name))).alias("evidence"), ids.alias("evidence_event_ids"))

    meds = F.filter(F.array(med(pick(MEDS, c + off), F.lit(True)), med(pick(MEDS, c + k), t % 3 == 0)), lambda m: m.isNotNull())
    types = F.filter(F.array(struct(F.col("ty"), _ev(F.col("ty"))), F.when(k % 4 == 0, struct(F.lit("focal aware"), _ev(F.lit("He has"))))), lambda x: x.isNotNull())
    freq = struct(F.col("fq"), _ev(F.concat(F.lit("Seizures: "), F.col("fq"))), F.lit("current").alias("temporal_scope"), F.col("ty").alias("seizure_type"))
    fields = F.struct(
        meds.alias("current_anti_seizure_medications"), F.slice(meds, F.lit(1), F.lit(0)).alias("previous_anti_seizure_medications"), freq.alias("current_seizure_frequency"),
        types.alias("seizure_types"), inv(c, "eeg").alias("eeg"), inv(t, "mri").alias("mri"),
        struct(pick(DX, c + t + off), _ev(F.col("dx"))).alias("epilepsy_diagnosis"))
    meta = F.struct(*[none.alias(n) for n in ("model", "model_label", "harness_id", "format", "projection")], (k % 100).cast("double").alias("latency_ms"),
                    (c % 1000).cast("double").alias("input_tokens"), F.when(k % 2 == 0, (t % 50).cast("double")).alias("output_tokens"), F.lit(None).cast("double").alias("estimated_cost_usd"),
                    F.lit(False).alias("repair_attempted"), F.lit(False).alias("repair_succeeded"))
    events = F.array().cast(CANONICAL["events"].dataType.simpleString())
    record = F.struct(F.col("document_id").alias("document_id"), F.lit("p").alias("pipeline_id"), fields.alias("fields"), events.alias("events"), meta.alias("metadata"))
    return computed_once(s, ["system", "document_id", "text"], record=record.cast(CANONICAL)).select("system", "document_id", "record", "text")


def gold(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    b = base(spark, d)
    k, c, t = F.col("k"), F.col("c"), F.col("t")
    form = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(g or [None] * 5, ("count", "period_count", "period_unit", "surface", "value"))]) for g in GOLD_F])
    one = F.element_at(form, (k % 5 + 1).cast("int"))
    two = F.when(t % 7 == 0, F.struct(F.lit("4").alias("count"), F.lit("").alias("period_count"), F.lit("").alias("period_unit"), F.lit("often").alias("surface"), F.lit("4").alias("value")))
    freqs = b.select("document_id", pick(TYPE_C, t + k % 2).alias("seizure_type"), F.posexplode(F.array(F.when(k % 5 != 4, one), two)).alias("ord", "g")).filter(F.col("g").isNotNull()).select(
        "document_id", "ord", "g.value", "g.count", "g.period_count", "g.period_unit", "seizure_type", F.lit("").alias("temporal_scope"), "g.surface")
    at = F.instr("text", F.concat(F.lit("- "), F.col("m1"))) + 1
    dxa = F.instr("text", F.lit("Diagnosis: ")) + 10
    sfa = F.instr("text", F.lit("Seizures: ")) + 9
    spans = b.select("document_id", F.inline(F.filter(F.array(
        F.struct(F.lit("medications").alias("group"), F.lit(0).cast("long").alias("ord"), at.alias("start"), (at + F.length("m1")).alias("end"), F.lit("Prescription").alias("label"), F.col("m1").alias("value")),
        F.when(F.col("dx") != "", F.struct(F.lit("diagnosis").alias("group"), F.lit(1).cast("long").alias("ord"), dxa.alias("start"), (dxa + F.length("dx")).alias("end"), F.lit("Diagnosis").alias("label"), F.col("dx").alias("value"))),
        F.when((F.col("fq") != "") & (k % 2 == 0), F.struct(F.lit("seizure_frequency").alias("group"), F.lit(2).cast("long").alias("ord"), sfa.alias("start"), (sfa + F.length("fq")).alias("end"), F.lit("SeizureFrequency").alias("label"), F.col("fq").alias("value")))),
        lambda s: s.isNotNull())))
    dx = pick(DX_C, c + t + F.when(k % 3 == 0, 1).otherwise(0))
    return {
        "medications": b.select("document_id", F.lit(0).alias("ord"), pick(MEDS_C, c + F.when(k % 4 == 0, 1).otherwise(0)).alias("name"), pick(["500", "250"], k).alias("dose"),
                                F.lit("mg").alias("dose_unit"), F.lit("twice daily").alias("frequency")),
        "frequencies": freqs, "types": freqs.select("document_id", "ord", F.col("seizure_type").alias("label")),
        "investigations": b.select("document_id", F.when(c % 3 == 1, "normal").when(c % 3 == 2, "abnormal").alias("eeg"), F.when(t % 2 == 0, "normal").alias("mri")),
        "diagnoses": b.select("document_id", F.lit(0).alias("ord"), dx.alias("label")).filter(~F.col("label").isin("", "syncope")), "spans": spans,
    }


# ---- SQL side -----------------------------------------------------------------------------

PRED_KEYS = f"""pm AS (SELECT system, document_id, unnest(CASE WHEN t % 3 = 0 THEN [{pick_sql(MEDS_C, 'c + off')}, {pick_sql(MEDS_C, 'c + k')}] ELSE [{pick_sql(MEDS_C, 'c + off')}] END) AS n,
 {pick_sql(DOSE_C, 'k')} AS dd, {pick_sql(UNIT_C, 'k')} AS uu, {pick_sql(SCHED_C, 't')} AS ss FROM sy),
pt AS (SELECT system, document_id, unnest(CASE WHEN k % 4 = 0 THEN [{pick_sql(TYPE_C, 't')}, 'focal aware seizure'] ELSE [{pick_sql(TYPE_C, 't')}] END) AS n FROM sy),
coarse(n, g) AS (VALUES {', '.join(f"({lit_sql(a)}, {lit_sql(b)})" for a, b in zip(TYPE_C + ['focal aware seizure'], TYPE_K + ['focal seizure or epilepsy']))}),
pk AS (SELECT DISTINCT * FROM (
 SELECT system, document_id, 'medication_name' AS metric, n AS key FROM pm UNION ALL SELECT system, document_id, 'medication_full', n || ' | ' || dd || ' | ' || uu || ' | ' || ss FROM pm
 UNION ALL SELECT system, document_id, 'medication_dose', n || ' | ' || dd FROM pm WHERE dd <> '' UNION ALL SELECT system, document_id, 'medication_dose_unit', n || ' | ' || uu FROM pm WHERE uu <> ''
 UNION ALL SELECT system, document_id, 'medication_frequency', n || ' | ' || ss FROM pm WHERE ss <> '' UNION ALL SELECT system, document_id, 'seizure_type', n FROM pt
 UNION ALL SELECT system, document_id, 'seizure_type_collapsed', g FROM pt JOIN coarse USING (n)))"""
GOLD_FREQ = f"""gf AS (SELECT document_id, k, t, 0 AS ord, {pick_sql(TYPE_C, 't + k % 2')} AS st, ({[list(g or ['', '', '', '', '']) for g in GOLD_F]!r})[k % 5 + 1] AS g FROM bs WHERE k % 5 <> 4
 UNION ALL SELECT document_id, k, t, 1, {pick_sql(TYPE_C, 't + k % 2')}, ['4', '', '', 'often', '4'] FROM bs WHERE t % 7 = 0)"""
GOLD_KEYS = f"""{GOLD_FREQ}, gm AS (SELECT document_id, {pick_sql(MEDS_C, 'c + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END')} AS n, {pick_sql(['500', '250'], 'k')} AS dd FROM bs),
gk AS (SELECT DISTINCT * FROM (SELECT document_id, 'medication_name' AS metric, n AS key FROM gm UNION ALL SELECT document_id, 'medication_full', n || ' | ' || dd || ' | mg | twice daily' FROM gm
 UNION ALL SELECT document_id, 'medication_dose', n || ' | ' || dd FROM gm UNION ALL SELECT document_id, 'medication_dose_unit', n || ' | mg' FROM gm UNION ALL SELECT document_id, 'medication_frequency', n || ' | twice daily' FROM gm
 UNION ALL SELECT document_id, 'seizure_type', st FROM gf UNION ALL SELECT document_id, 'seizure_type_collapsed', g2.g FROM gf JOIN coarse g2 ON g2.n = gf.st))"""
FLAGS = f"""{SYS}, {PRED_KEYS}, {GOLD_KEYS}, gs AS (SELECT sy.system, gk.* FROM sy JOIN gk USING (document_id)),
fl AS (SELECT system, document_id, metric, key, p.x IS NOT NULL AS in_pred, g.x IS NOT NULL AS in_gold FROM (SELECT *, 1 AS x FROM pk) p FULL JOIN (SELECT *, 1 AS x FROM gs) g USING (system, document_id, metric, key))"""
METRICS = "(VALUES ('medication_name'), ('medication_dose'), ('medication_dose_unit'), ('medication_frequency'), ('medication_full'), ('seizure_type'), ('seizure_type_collapsed')) m(metric)"
_P = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0::DOUBLE END AS recall"
_F = "CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1"
SET_SCORES = f"""{FLAGS}, sc AS (SELECT sy.system, sy.document_id, m.metric, count(*) FILTER (in_pred AND in_gold) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn
 FROM sy CROSS JOIN {METRICS} LEFT JOIN fl ON fl.system = sy.system AND fl.document_id = sy.document_id AND fl.metric = m.metric GROUP BY 1, 2, 3),
sr AS (SELECT *, {_P} FROM sc), ss AS (SELECT *, {_F} FROM sr)"""

_PARTS = "[" + ", ".join("[" + ", ".join(lit_sql(v) for v in p) + "]" for p in FREQ_P) + "]"
_XS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in FREQ_X) + "]"
_GXS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in GOLD_F_X) + "]"
# loose match written for the few shapes of this corpus: a predicted range "3-5" only equals the same gold text
_LOOSE = "(p[4] <> 'seizure_free' AND p[1] <> '' AND g[1] <> '' AND p[1] = g[1] AND p[2] = g[2] AND p[3] = g[3])"
_STRICT = "(p[4] <> 'seizure_free' AND p[1] <> '' AND p[1] = g[1] AND p[2] = g[2] AND p[3] = g[3])"
# surfaces that parse: "2 per month", "seizure free", "daily"
_SURF = "((g[4] = '2 per month' AND p[1] = '2' AND p[2] = '1' AND p[3] = 'month') OR (g[4] = 'seizure free' AND p[4] = 'seizure_free') OR (g[4] = 'daily' AND p[1] = '1' AND p[2] = '1' AND p[3] = 'day'))"
_NV = "replace(fq, '-', ' ')"
SCALARS = f"""{SYS}, {GOLD_FREQ}, sp AS (SELECT *, ({_PARTS})[k % 7 + 1] AS p, ({_XS})[k % 7 + 1] AS px, CASE WHEN k % 5 = 4 THEN CASE WHEN t % 7 = 0 THEN 1000.0::DOUBLE ELSE 1000.0::DOUBLE END ELSE ({_GXS})[k % 5 + 1] END AS gx,
 {pick_sql(DX_C, 'c + t + off')} AS dxc, {pick_sql(DX_K, 'c + t + off')} AS dxk, {pick_sql(DX_C, 'c + t + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END')} AS gdx, {pick_sql(DX_K, 'c + t + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END')} AS gdk,
 {pick_sql(RESULT_C, 'c')} AS pe, {pick_sql(RESULT_C, 't')} AS pmr, CASE c % 3 WHEN 1 THEN 'normal' WHEN 2 THEN 'abnormal' END AS ge, CASE WHEN t % 2 = 0 THEN 'normal' END AS gmr, {pick_sql(TYPE_C, 't')} AS pty FROM sy),
fj AS (SELECT sp.system, sp.document_id, coalesce(bool_or(fq <> '' AND fq = g[5]), false) AS exact, coalesce(bool_or({_STRICT}), false) AS relaxed, coalesce(bool_or({_LOOSE}), false) AS loose,
 coalesce(bool_or({_LOOSE} OR {_SURF}), false) AS per_letter, coalesce(bool_or(p[1] <> '' AND p[1] = g[1]), false) AS count_hit, coalesce(bool_or(p[3] <> '' AND p[3] = g[3] AND p[2] = g[2]), false) AS period_hit,
 coalesce(bool_or(pty = gf.st), false) AS linked, coalesce(bool_or(g[5] <> ''), false) AS has_gold, count(gf.ord) AS gold_annotations FROM sp LEFT JOIN gf ON gf.document_id = sp.document_id GROUP BY 1, 2),
sl AS (SELECT system, document_id, exact, relaxed, loose, per_letter, count_hit, period_hit, linked, gold_annotations, CASE WHEN fq <> '' THEN true ELSE NOT has_gold END AS scope_ok, px, gx,
 CASE WHEN ge IS NOT NULL THEN pe = ge ELSE pe = '' END AS eeg_ok, CASE WHEN gmr IS NOT NULL THEN pmr = gmr ELSE pmr = '' END AS mri_ok,
 (dxc <> '' AND gdx NOT IN ('', 'syncope') AND (contains(dxc, gdx) OR contains(gdx, dxc))) AS dx, (dxk <> '' AND gdx NOT IN ('', 'syncope') AND dxk = gdk) AS dx_coarse FROM sp JOIN fj USING (system, document_id))"""
