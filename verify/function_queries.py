"""Scalar functions over values derived from the part, orders and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldmeter.functions import frequency as Q
from goldmeter.functions import normalize as N
from goldmeter.functions import text as T
from goldmeter.functions import vocabulary as V
from goldmeter.functions.spans import attribute_agreement
from goldmeter.operators import intervals as I
from goldmeter.operators import label_audit as LA
from verify.base import (contains_any_sql, lit_sql, map_sql, norm_label_sql, norm_text_sql, norm_value_sql, pick, pick_sql,
                         query, table)

SURFACES = list(V.MEDICATION_SYNONYMS)
HEADS = ["", "Oral ", "generic-", "Started ", "keppra and "]
TAILS = ["", " 500 mg", " 250mg Tablets", " MR", " (twice)", "_1.5g capsules"]


def med_text():
    p, s = F.col("p_partkey"), F.col("p_size")
    return F.concat(pick(HEADS, s), F.initcap(pick(SURFACES, p)), pick(TAILS, p + s))


MED_SQL = (f"{pick_sql(HEADS, 'p_size')} || {pick_sql([' '.join(w.capitalize() for w in s.split(' ')) for s in SURFACES], 'p_partkey')} || "
           f"{pick_sql(TAILS, 'p_partkey + p_size')}")
BARE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(nv, '\\b(tablets?|tabs?|capsules?|caps?|liquid|solution|syrup|modified release|mr|xr|cr)\\b', ' ', 'g'), "
    "'\\b\\d+(?:\\.\\d+)?\\s*(?:mg|g|mcg|microgram|ml)s?\\b', ' ', 'g'), '\\s+', ' ', 'g'))")
SYN_VALUES = ", ".join(f"({i}, {lit_sql(s)}, {lit_sql(c)})" for i, (s, c) in enumerate(V.MEDICATION_SYNONYMS.items()))


@query("value_normaliser", f"""
SELECT p_partkey, {norm_value_sql("p_name || '_' || p_type || '-N/A'")} AS named, {norm_value_sql("CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE p_type END")} AS maybe
FROM part""")
def value_normaliser(spark, d):
    name = F.concat("p_name", F.lit("_"), "p_type", F.lit("-N/A"))
    maybe = F.when(F.col("p_size") % 3 == 0, "N/A").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.norm_value(name).alias("named"), T.norm_value(maybe).alias("maybe"))


MED_NAME_SQL = f"""
WITH raw AS (SELECT p_partkey, {MED_SQL} AS txt FROM part),
n AS (SELECT p_partkey, txt, {norm_value_sql('txt')} AS nv FROM raw),
b AS (SELECT p_partkey, txt, {BARE} AS bare FROM n),
syn(ord, surface, concept) AS (VALUES {SYN_VALUES}),
u AS (SELECT DISTINCT bare FROM b),
hit AS (SELECT bare, concept, row_number() OVER (PARTITION BY bare ORDER BY (bare = surface) DESC, length(surface) DESC, ord) AS rn
        FROM u JOIN syn ON bare = surface OR regexp_matches(bare, '\\b' || surface || '\\b'))
"""


@query("medication_name", MED_NAME_SQL + """
SELECT p_partkey, txt AS surface, coalesce(concept, bare) AS medication FROM b LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (bare)""")
def medication_name(spark, d):
    t = table(spark, d, "part").select("p_partkey", med_text().alias("surface"))
    return t.withColumn("medication", N.medication_name(F.col("surface")))


@query("dictionary_lookup_counts", MED_NAME_SQL + """
SELECT coalesce(concept, '(none)') AS concept, count(*) AS n FROM b LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (bare) GROUP BY 1""")
def dictionary_lookup_counts(spark, d):
    t = table(spark, d, "part").select(N.medication_surface(med_text()).alias("bare"))
    found = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in V.MEDICATION_SYNONYMS.items() for v in p]), F.col("bare")),
                       N.longest_surface(F.col("bare"), V.MEDICATION_SYNONYMS), F.lit("(none)"))
    return t.groupBy(found.alias("concept")).agg(F.count(F.lit(1)).alias("n"))


UNITS = ["mg", "Milligrams", "MGS", "micrograms", "g", "puffs", None, "ml"]
_W = "(?:mg|g|mcg|micrograms?|ml|milligrams?|grams?)"


@query("dose_and_unit", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) || {pick_sql(['mg', ' mg', '.5 g', ' x 2micrograms', ''], 'l_partkey')} AS dose,
  {pick_sql(UNITS, 'l_suppkey + l_linenumber')} AS unit FROM lineitem),
n AS (SELECT *, {norm_value_sql('dose')} AS nv, {norm_value_sql('unit')} AS nu FROM r)
SELECT dose_value, dose_unit, count(*) AS n FROM (
  SELECT replace(regexp_replace(regexp_replace(nv, '(\\d){_W}\\b', '\\1', 'g'), '\\b{_W}\\b', '', 'g'), ' ', '') AS dose_value, {map_sql('nu', V.DOSE_UNITS)} AS dose_unit FROM n)
GROUP BY 1, 2""")
def dose_and_unit(spark, d):
    dose = F.concat(F.floor("l_quantity").cast("string"), pick(["mg", " mg", ".5 g", " x 2micrograms", ""], F.col("l_partkey")))
    unit = pick(UNITS, F.col("l_suppkey") + F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy(N.dose_value(dose).alias("dose_value"), N.dose_unit(unit).alias("dose_unit")).agg(F.count(F.lit(1)).alias("n"))


SCHED = list(V.DOSING_SYNONYMS) + ["At night", "B-D", None]


@query("dosing_schedule", f"""
SELECT p_partkey, {map_sql(norm_value_sql(pick_sql(SCHED, 'p_partkey + p_size')), V.DOSING_SYNONYMS)} AS schedule,
  regexp_replace({norm_value_sql(pick_sql(['Weeks', 'day', 'Months', 'years', 'fortnight'], 'p_partkey'))}, 's$', '') AS unit FROM part""")
def dosing_schedule(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", N.dosing_schedule(pick(SCHED, p + s)).alias("schedule"),
                                          N.singular_unit(pick(["Weeks", "day", "Months", "years", "fortnight"], p)).alias("unit"))


TYPES = list(V.SEIZURE_TYPE_SYNONYMS) + [
    "GTC fits", "Focal to bilateral tonic-clonic events", "complex partial fit", "focal seizures with impaired awareness", "partial thing",
    "generalised tonic clonic fits", "myoclonic jerks", "absence-like spells", "seizures", "fit", "dizzy", None, "secondary generalized seizures",
    "unusual smell", "aura with seizure", "dissociative attack", "generalised seizures", "convulsive seizure", "temporal lobe", "jme epilepsy"]


def seizure_sql(t: str) -> str:
    return f"""(CASE WHEN {t} IN ({', '.join(lit_sql(k) for k in V.SEIZURE_TYPE_SYNONYMS)}) THEN {map_sql(t, V.SEIZURE_TYPE_SYNONYMS)}
 WHEN contains({t}, 'focal') AND contains({t}, 'bilateral') AND contains({t}, 'tonic clonic') THEN 'focal to bilateral tonic clonic seizure'
 WHEN contains({t}, 'complex partial') OR (contains({t}, 'focal') AND contains({t}, 'impaired awareness')) THEN 'focal impaired awareness seizure'
 WHEN {contains_any_sql(t, ['focal', 'partial'])} THEN 'focal seizure'
 WHEN {contains_any_sql(t, ['tonic clonic', 'gtc'])} THEN 'generalized tonic clonic seizure'
 WHEN contains({t}, 'absence') THEN 'generalized absence seizure' WHEN contains({t}, 'myoclonic') THEN 'generalized myoclonic seizure'
 WHEN {t} IN ('seizure', 'seizures') THEN 'unknown seizure type' ELSE {t} END)"""


def seizure_text_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({norm_value_sql(x)}, 'generalised', 'generalized'), '\\bfits?\\b', 'seizure', 'g'), '\\s+', ' ', 'g'))"


def coarse_seizure_sql(c: str) -> str:
    return f"""(CASE WHEN {c} = '' THEN '' WHEN {c} IN ({', '.join(lit_sql(k) for k in V.COARSE_SEIZURE)}) THEN {map_sql(c, V.COARSE_SEIZURE)}
 WHEN {contains_any_sql(c, ['focal', 'partial'])} THEN 'focal seizure or epilepsy'
 WHEN {contains_any_sql(c, ['generalized', 'tonic clonic', 'absence', 'myoclonic'])} THEN 'generalized seizure or epilepsy' ELSE 'unknown seizure or epilepsy' END)"""


PROJ = """(CASE WHEN pt IN ('', 'not stated', 'none', 'null') THEN NULL
 WHEN (contains(pt, 'aura') OR contains(pt, 'warning') OR contains(pt, 'unusual smell') OR contains(pt, 'strange smell') OR contains(pt, 'strange taste') OR contains(pt, 'abdominal sensation') OR contains(pt, 'epigastric'))
   AND NOT (contains(pt, 'seizure') OR contains(pt, 'fit') OR contains(pt, 'convulsive') OR contains(pt, 'convulsion')) THEN NULL
 WHEN contains(pt, 'dissociative') OR contains(pt, 'nonepileptic') OR contains(pt, 'non epileptic') OR contains(pt, 'dizzy spell') THEN 'unknown seizure type'
 WHEN contains(pt, 'secondary') AND (contains(pt, 'generalized') OR contains(pt, 'convulsive') OR contains(pt, 'tonic clonic')) THEN 'secondary generalized seizures'
 WHEN contains(pt, 'focal to bilateral') AND contains(pt, 'tonic clonic') THEN 'secondary generalized seizures'
 WHEN contains(pt, 'focal') OR contains(pt, 'partial') OR contains(pt, 'temporal') THEN 'focal seizure'
 WHEN contains(pt, 'tonic clonic') OR contains(pt, 'gtc') THEN 'generalized tonic clonic seizure' WHEN contains(pt, 'absence') THEN 'generalized absence seizure'
 WHEN contains(pt, 'myoclonic') THEN 'generalized myoclonic seizure' WHEN contains(pt, 'generalized seizure') THEN 'generalized seizures'
 WHEN pt IN ('seizure', 'seizures', 'fits') THEN 'unknown seizure type' ELSE raw END)"""
FAIL = """(CASE WHEN fo AND ge THEN 'combined_generalized_focal' WHEN fo THEN 'focal' WHEN ge THEN 'generalized'
 WHEN contains(nv, 'seizure') OR contains(nv, 'epilepsy') OR contains(nv, 'jme') THEN 'unknown' ELSE '' END)"""


@query("seizure_labels", f"""
WITH r AS (SELECT p_partkey, {pick_sql(TYPES, 'p_partkey + p_size')} AS raw FROM part),
n AS (SELECT *, {norm_value_sql('raw')} AS nv, {seizure_text_sql('raw')} AS st,
  trim(regexp_replace(replace(replace(lower(coalesce(raw, '')), 'generalised', 'generalized'), '-', ' '), '[^a-z0-9/ ]+', ' ', 'g')) AS pt FROM r),
c AS (SELECT *, {seizure_sql('st')} AS canonical, {contains_any_sql('nv', ['focal', 'partial', 'temporal lobe', 'frontal lobe'])} AS fo,
  {contains_any_sql('nv', ['generalised', 'generalized', 'absence', 'myoclonic', 'tonic clonic'])} AS ge FROM n)
SELECT p_partkey, canonical, {coarse_seizure_sql('canonical')} AS coarse, {PROJ} AS projection, {FAIL} AS failure FROM c""")
def seizure_labels(spark, d):
    t = table(spark, d, "part").select("p_partkey", pick(TYPES, F.col("p_partkey") + F.col("p_size")).alias("raw"))
    return t.withColumn("canonical", N.seizure_type(F.col("raw"))).select(
        "p_partkey", "canonical", N.coarse_seizure_of(F.col("canonical")).alias("coarse"), N.projection_label(F.col("raw")).alias("projection"),
        N.failure_label(F.col("raw")).alias("failure"))


DXS = list(V.DIAGNOSIS_SYNONYMS) + ["left temporal lobe", "Generalised thing", "idiopathic general", "status epilepticus", "Some Epilepsy", "syncope", None, "combined generalized and focal epilepsy"]


def diagnosis_sql(t: str) -> str:
    return f"""(CASE WHEN {t} IN ({', '.join(lit_sql(k) for k in V.DIAGNOSIS_SYNONYMS)}) THEN {map_sql(t, V.DIAGNOSIS_SYNONYMS)}
 WHEN {contains_any_sql(t, ['temporal lobe', 'focal', 'partial'])} THEN 'focal epilepsy' WHEN {contains_any_sql(t, ['generalized', 'idiopathic general'])} THEN 'generalized epilepsy'
 WHEN contains({t}, 'epilepsy') THEN 'epilepsy' ELSE {t} END)"""


def coarse_dx_sql(c: str) -> str:
    return f"""(CASE WHEN {c} = '' THEN '' WHEN {c} IN ({', '.join(lit_sql(k) for k in V.COARSE_DIAGNOSIS)}) THEN {map_sql(c, V.COARSE_DIAGNOSIS)}
 WHEN contains({c}, 'focal') THEN 'focal_epilepsy' WHEN contains({c}, 'generalized') THEN 'generalized_epilepsy'
 WHEN contains({c}, 'combined') THEN 'combined_generalized_and_focal_epilepsy' WHEN contains({c}, 'epilepsy') THEN 'unknown_epilepsy' ELSE '' END)"""


RESULTS = ["No abnormality detected", "Abnormal", "normal", "Sharp spikes", "within normal limits", "awaited", "", None, "Unremarkable", "unclear"]


def result_sql(t: str) -> str:
    return f"""(CASE WHEN {t} = '' THEN '' WHEN {contains_any_sql(t, V.NORMAL_RESULT_TERMS)} THEN 'normal' WHEN {contains_any_sql(t, V.ABNORMAL_RESULT_TERMS)} THEN 'abnormal'
 WHEN contains({t}, 'normal') THEN 'normal' WHEN {contains_any_sql(t, V.PENDING_RESULT_TERMS)} THEN 'uncertain' ELSE {t} END)"""


WORDS = ["current", "previously tried", "plan to start", "taking", "Soon", "", None, "possible", "conflicting", "query"]


@query("diagnosis_and_results", f"""
WITH r AS (SELECT o_orderkey, {pick_sql(DXS, 'o_orderkey')} AS dx, {pick_sql(RESULTS, 'o_custkey')} AS res, {pick_sql(WORDS, 'o_custkey + o_orderkey')} AS tv, {pick_sql(WORDS, 'o_orderkey')} AS ev FROM orders),
n AS (SELECT o_orderkey, replace({norm_value_sql('dx')}, 'generalised', 'generalized') AS dt, {norm_value_sql('res')} AS rt, {norm_value_sql('tv')} AS own,
  trim({norm_value_sql('tv')} || ' ' || {norm_value_sql('ev')}) AS tt FROM r),
c AS (SELECT *, {diagnosis_sql('dt')} AS diagnosis FROM n)
SELECT o_orderkey, diagnosis, {coarse_dx_sql('diagnosis')} AS coarse, {result_sql('rt')} AS result,
 CASE WHEN tt = '' THEN '' WHEN {contains_any_sql('tt', V.HISTORICAL_TERMS)} THEN 'historical' WHEN {contains_any_sql('tt', V.PLANNED_TERMS)} THEN 'planned'
   WHEN {contains_any_sql('tt', V.CURRENT_TERMS)} THEN 'current' WHEN own = '' THEN 'uncertain' ELSE own END AS temporality,
 CASE WHEN tt = '' THEN 'not_stated' WHEN {contains_any_sql('tt', V.UNCERTAIN_TERMS)} THEN 'uncertain' WHEN {contains_any_sql('tt', V.CONFLICT_TERMS)} THEN 'conflicting' ELSE 'present' END AS missingness
FROM c""")
def diagnosis_and_results(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, d, "orders").select("o_orderkey", pick(DXS, k).alias("dx"), pick(RESULTS, c).alias("res"), pick(WORDS, c + k).alias("tv"), pick(WORDS, k).alias("ev"))
    return t.withColumn("diagnosis", N.diagnosis(F.col("dx"))).select(
        "o_orderkey", "diagnosis", N.coarse_diagnosis_of(F.col("diagnosis")).alias("coarse"), N.investigation_result(F.col("res")).alias("result"),
        N.temporality(F.col("tv"), F.col("ev")).alias("temporality"), N.missingness(F.col("tv"), F.col("ev")).alias("missingness"))


@query("text_normalisers", f"""
SELECT doc_id, {norm_text_sql("text || '–“x”'")} AS folded, length({norm_label_sql('text')}) AS label_chars,
 trim(regexp_replace(lower(text), '[^a-z0-9.]+', ' ', 'g')) AS rate_text FROM documents""")
def text_normalisers(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.norm_text(F.concat(t, F.lit("–“x”"))).alias("folded"), F.length(T.norm_label(t)).alias("label_chars"),
        T.norm_rate_text(t).alias("rate_text"))


# ---- frequency grammar ----------------------------------------------------------------

FORMS = ["{n} per {u}", "{n} to {m} per {u}", "{n} seizures in the last {m} {u}s", "every {m} {u}s", "Seizure-free since May", "every few months", "fortnightly",
         "{n}", "rare", "two-three per {u}", "every couple {u}s", "{n} or {m} seizures every {u}", "once a month", "", "a seizure a {u}", "{n} over past {u}"]
UNIT4 = ["day", "week", "month", "year"]


def frequency_text(ev):
    k = F.get_json_object("props", "$.k").cast("bigint")
    n, m, u = (k % 9 + 1).cast("string"), (k % 5 + 2).cast("string"), pick(UNIT4, k)
    text = pick(FORMS, F.col("event_id"))
    return ev.withColumn("k", k).withColumn("ftext", F.replace(F.replace(F.replace(text, F.lit("{n}"), n), F.lit("{m}"), m), F.lit("{u}"), u))


FT_SQL = f"""ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ft AS (SELECT *, replace(replace(replace({pick_sql(FORMS, 'event_id')}, '{{n}}', CAST(k % 9 + 1 AS VARCHAR)), '{{m}}', CAST(k % 5 + 2 AS VARCHAR)), '{{u}}', {pick_sql(UNIT4, 'k')}) AS ftext FROM ev)"""
_NUM = "(?:\\d+(?:\\.\\d+)?)"
_CW = "one|two|three|four|five|six|seven|eight|nine|ten"
PER = f"\\b({_NUM}|{_CW}|a|an)(?:\\s*(?:to|or|-)\\s*({_NUM}|{_CW}))?\\s+(?:seizures?\\s+)?(?:per|a|each|every)\\s+(?:(\\d+(?:\\.\\d+)?)\\s+)?(day|week|month|year)s?\\b"
INP = f"\\b({_NUM}|{_CW})(?:\\s*(?:to|or|-)\\s*({_NUM}|{_CW}))?\\s+(?:seizures?\\s+)?(?:in|over|during|last)(?:\\s+(?:the\\s+)?(?:last|past))?\\s+(?:(\\d+(?:\\.\\d+)?)\\s+)?(day|week|month|year)s?\\b"
EVERY = f"\\bevery\\s+({_NUM}|one|two|three|four|five|six|few|couple)\\s+(day|week|month|year)s?\\b"


def parts_sql(source: str, text: str, keep: str, prefix: str = "") -> str:
    """CTE body that parses `text` of `source` into count / period_count / period_unit / class columns."""
    def num(x):
        return map_sql(x, V.NUMBER_WORDS)

    pc = map_sql("nv", {k: v[0] for k, v in V.PHRASE_RATES.items()})
    pu = map_sql("nv", {k: v[1] for k, v in V.PHRASE_RATES.items()})

    def rng(p):
        return f"(CASE WHEN {p}2 = '' THEN {num(p + '1')} ELSE {num(p + '1')} || '-' || {num(p + '2')} END)"

    rules = [
        ("nv = ''", "''", "''", "''", "''"), (contains_any_sql("nv", V.SEIZURE_FREE_PHRASES), "'0'", "''", "''", "'seizure_free'"),
        (contains_any_sql("nv", V.FEW_MONTHS_PHRASES), "'1'", "'3'", "'month'", "'approximate_rate'"),
        (f"nv IN ({', '.join(lit_sql(k) for k in V.PHRASE_RATES)})", "'1'", pc, pu, "'rate'"),
        ("e2 <> ''", "'1'", f"(CASE e1 WHEN 'few' THEN '3' WHEN 'couple' THEN '2' ELSE {num('e1')} END)", "e2", "(CASE WHEN e1 IN ('few', 'couple') THEN 'approximate_rate' ELSE 'rate' END)"),
        ("p4 <> ''", rng("p"), "(CASE p3 WHEN '' THEN '1' ELSE p3 END)", "p4", "'rate'"), ("i4 <> ''", rng("i"), "(CASE i3 WHEN '' THEN '1' ELSE i3 END)", "i4", "'rate'"),
        ("regexp_full_match(nv, '\\d+(?:\\.\\d+)?')", "nv", "''", "''", "'count_only'")]
    cols = []
    for j, name in enumerate(("count", "period_count", "period_unit", "class")):
        final = "'unparsed'" if name == "class" else "''"
        cols.append("CASE " + " ".join(f"WHEN {r[0]} THEN {r[j + 1]}" for r in rules) + f" ELSE {final} END AS {prefix}{name}")
    groups = ", ".join([f"regexp_extract(nv, '{EVERY}', {i}) AS e{i}" for i in (1, 2)] + [f"regexp_extract(nv, '{PER}', {i}) AS p{i}" for i in (1, 2, 3, 4)]
                       + [f"regexp_extract(nv, '{INP}', {i}) AS i{i}" for i in (1, 2, 3, 4)])
    return f"SELECT {keep}, {', '.join(cols)} FROM (SELECT *, {groups} FROM (SELECT *, {norm_value_sql(text)} AS nv FROM {source}))"


@query("frequency_expression_parts", f"WITH {FT_SQL} {parts_sql('ft', 'ftext', 'event_id')}")
def frequency_expression_parts(spark, d):
    t = frequency_text(table(spark, d, "events")).withColumn("p", Q.frequency_parts(F.col("ftext")))
    return t.select("event_id", "p.*")


LABELS = ["{n} per {u}", "{n} to {m} per {u}", "{n} cluster per {u}, {m} per cluster", "seizure free for {m} month", "unknown", "no seizure frequency reference",
          "multiple per {m} {u}", "{n}-{m} per {u}", "seizure free for multiple year", "often", "a per {u}", "{n} per 0 {u}", "two to four per {m} {u}", "{n} cluster per {m} {u}, multiple per cluster"]


def label_text(ev, shift=0):
    k = F.get_json_object("props", "$.k").cast("bigint")
    n, m, u = (k % 9 + 1).cast("string"), (k % 5 + 2).cast("string"), pick(UNIT4, k)
    return F.replace(F.replace(F.replace(pick(LABELS, F.col("event_id") + shift), F.lit("{n}"), n), F.lit("{m}"), m), F.lit("{u}"), u)


def label_sql(shift=0) -> str:
    return (f"replace(replace(replace({pick_sql(LABELS, f'event_id + {shift}')}, '{{n}}', CAST(k % 9 + 1 AS VARCHAR)), '{{m}}', CAST(k % 5 + 2 AS VARCHAR)), '{{u}}', {pick_sql(UNIT4, 'k')})")


EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_WORDNUM = {"a": "1", "an": "1", "one": "1", "multiple": "2", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}


def qty_sql(x: str) -> str:
    def one(y):
        return f"TRY_CAST({map_sql(y, _WORDNUM)} AS DOUBLE)"

    return (f"(CASE WHEN contains({x}, ' to ') THEN ({one(f'split_part({x}, chr(32)||chr(116)||chr(111)||chr(32), 1)')} + {one(f'split_part({x}, chr(32)||chr(116)||chr(111)||chr(32), 2)')}) / 2 "
            f"WHEN contains({x}, ' ') THEN ({one(f'split_part({x}, chr(32), 1)')} + {one(f'split_part({x}, chr(32), 2)')}) / 2 ELSE {one(x)} END)")


def factor_sql(u: str) -> str:
    return f"(CASE {u} WHEN 'day' THEN 30.0::DOUBLE WHEN 'week' THEN 4.0::DOUBLE WHEN 'month' THEN 1.0::DOUBLE WHEN 'year' THEN 1.0::DOUBLE / 12.0::DOUBLE END)"


def rate_cte(source: str, label: str, keep: str, out: str = "x") -> str:
    """CTE body: monthly rate of normalised labels."""
    cl = "^(.+?) cluster per (?:(.+?) )?(day|week|month|year), (.+?) per cluster$"
    rt = "^(.+?) per (?:(.+?) )?(day|week|month|year)$"
    g = ", ".join([f"regexp_extract(lb, '{cl}', {i}) AS c{i}" for i in (1, 2, 3, 4)] + [f"regexp_extract(lb, '{rt}', {i}) AS r{i}" for i in (1, 2, 3)])

    def monthly(p):
        den = f"(CASE WHEN {p}2 = '' THEN 1.0::DOUBLE ELSE {qty_sql(p + '2')} END)"
        return f"({qty_sql(p + '1')} * {factor_sql(p + '3')} / nullif({den}, 0.0::DOUBLE))"

    return f"""SELECT {keep}, CASE WHEN lb IN ('', 'unknown', 'no seizure frequency reference') THEN 1000.0::DOUBLE WHEN starts_with(lb, 'seizure free') THEN 0.0::DOUBLE
 ELSE coalesce(CASE WHEN c3 <> '' THEN {monthly('c')} * {qty_sql('c4')} END, CASE WHEN r3 <> '' THEN {monthly('r')} END, 1000.0::DOUBLE) END AS {out}
 FROM (SELECT *, {g} FROM (SELECT *, {norm_label_sql(label)} AS lb FROM {source}))"""


def fine_sql(x: str) -> str:
    steps = " ".join(f"WHEN {x} <= {b} THEN {lit_sql(n)}" for b, n in Q.FINE_LADDER)
    return f"(CASE WHEN {x} = 1000 THEN 'UNK' WHEN {x} = 0 THEN 'NS' WHEN NOT ({x} > 0) THEN 'UNK' {steps} ELSE 'UNK' END)"


def coarse_sql(x: str) -> str:
    return f"(CASE WHEN {x} = 1000 THEN 'UNK' WHEN {x} = 0 THEN 'NS' WHEN NOT ({x} > 0) THEN 'UNK' WHEN {x} <= 1.1 THEN 'infrequent' WHEN {x} <= 999 THEN 'frequent' ELSE 'UNK' END)"


@query("label_rates_and_classes", f"""WITH {EV}, lb AS (SELECT event_id, {label_sql()} AS label FROM ev), r AS ({rate_cte('lb', 'label', 'event_id, label')})
SELECT event_id, x, {fine_sql('x')} AS purist, {coarse_sql('x')} AS pragmatic FROM r""")
def label_rates_and_classes(spark, d):
    t = table(spark, d, "events").select("event_id", label_text(None).alias("label"))
    return LA.label_categories(t, "label").select("event_id", "x", "purist", "pragmatic")


@query("quantity_values", f"""WITH {EV}, q AS (SELECT event_id, {norm_label_sql(pick_sql(['a', 'multiple', 'two', '3 to 5', '2-3', 'many', '1.5', 'four to six'], 'event_id + k'))} AS t, k FROM ev)
SELECT event_id, {qty_sql('t')} AS quantity, {factor_sql(pick_sql(UNIT4, 'k'))} AS factor FROM q""")
def quantity_values(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(
        "event_id", Q.quantity(pick(["a", "multiple", "two", "3 to 5", "2-3", "many", "1.5", "four to six"], F.col("event_id") + k)).alias("quantity"),
        Q.monthly_factor(pick(UNIT4, k)).alias("factor"))


GOLD_PARTS = """g AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN CAST(k % 9 + 1 AS VARCHAR) WHEN k % 4 = 2 THEN CAST(k % 3 + 1 AS VARCHAR) || '-' || CAST(k % 3 + 6 AS VARCHAR) ELSE '1' END AS gc,
 CASE WHEN k % 3 = 0 THEN '' ELSE '1' END AS gp, (['', 'day', 'weeks', 'month', 'year'])[k % 5 + 1] AS gu FROM ft)"""


def gold_columns():
    k = F.col("k")
    gc = (F.when(k % 4 == 0, "").when(k % 4 == 1, (k % 9 + 1).cast("string"))
          .when(k % 4 == 2, F.concat((k % 3 + 1).cast("string"), F.lit("-"), (k % 3 + 6).cast("string"))).otherwise("1"))
    return gc, F.when(k % 3 == 0, "").otherwise("1"), pick(["", "day", "weeks", "month", "year"], k)


_STRICT = "(count <> '' AND count = gc AND period_count = gp AND period_unit = gu)"
_UNITS_P, _UNITS_G = map_sql("period_unit", V.PERIOD_UNITS), map_sql("gu", V.PERIOD_UNITS)
_LOOSE = f"""(count <> '' AND gc <> '' AND period_count = gp AND {_UNITS_P} = {_UNITS_G} AND (count = gc OR (contains(gc, '-') AND
 coalesce(TRY_CAST(count AS DOUBLE) BETWEEN TRY_CAST(split_part(gc, '-', 1) AS DOUBLE) AND TRY_CAST(split_part(gc, '-', 2) AS DOUBLE), false))))"""


@query("frequency_part_matches", f"""WITH {FT_SQL}, {GOLD_PARTS}, p AS ({parts_sql('ft', 'ftext', 'event_id')})
SELECT event_id, CASE WHEN class = 'seizure_free' THEN false ELSE {_STRICT} END AS strict, CASE WHEN class = 'seizure_free' THEN false ELSE {_LOOSE} END AS loose
FROM p JOIN g USING (event_id)""")
def frequency_part_matches(spark, d):
    t = frequency_text(table(spark, d, "events")).withColumn("p", Q.frequency_parts(F.col("ftext"))).withColumn("g", Q.structured_parts(*gold_columns()))
    return t.select("event_id", Q.parts_match(F.col("p"), F.col("g")).alias("strict"), Q.parts_loose_match(F.col("p"), F.col("g")).alias("loose"))


@query("loose_match_any_candidate", f"""WITH {FT_SQL}, {GOLD_PARTS}, p AS ({parts_sql('ft', 'ftext', 'event_id')}),
u AS (SELECT user_id, count, period_count, period_unit, class FROM p JOIN events USING (event_id) WHERE event_type = 'view'),
pu AS (SELECT DISTINCT user_id, count, period_count, period_unit, class FROM u),
gd AS (SELECT DISTINCT user_id, gc, gp, gu FROM g JOIN events USING (event_id) WHERE event_type = 'click')
SELECT user_id, count AS n, period_count, period_unit, class, bool_or(CASE WHEN gc IS NULL THEN false WHEN class = 'seizure_free' THEN false ELSE {_LOOSE} END) AS correct
FROM pu LEFT JOIN gd USING (user_id) GROUP BY ALL""")
def loose_match_any_candidate(spark, d):
    t = frequency_text(table(spark, d, "events")).withColumn("p", Q.frequency_parts(F.col("ftext")))
    pred = t.filter("event_type = 'view'").select("user_id", "p").distinct()
    gold = t.filter("event_type = 'click'").select("user_id", Q.structured_parts(*gold_columns()).alias("g")).distinct()
    hit = F.coalesce(F.max(Q.parts_loose_match(F.col("p"), F.col("g"))), F.lit(False))
    out = pred.join(gold, "user_id", "left").groupBy("user_id", "p").agg(hit.alias("correct"))
    return out.select("user_id", F.col("p.count").alias("n"), "p.period_count", "p.period_unit", "p.class", "correct")


@query("parts_and_gold_rates", f"""WITH {FT_SQL}, {GOLD_PARTS}, p AS ({parts_sql('ft', 'ftext', 'event_id')}),
j AS (SELECT event_id, count, period_count, period_unit, class, gc, gp, gu, (gc = '' AND gu = '' AND class NOT IN ('', 'unparsed')) AS use_text FROM p JOIN g USING (event_id)),
s AS (SELECT *, CASE WHEN use_text THEN count ELSE gc END AS n, CASE WHEN use_text THEN period_count ELSE gp END AS pc, CASE WHEN use_text THEN period_unit ELSE gu END AS pu, CASE WHEN use_text THEN class ELSE '' END AS cl FROM j),
q AS (SELECT *, {norm_label_sql('n')} AS nn, rtrim(pu, 's') AS uu FROM s), q2 AS (SELECT *, {norm_label_sql('count')} AS cn FROM q)
SELECT event_id, CASE WHEN class = 'seizure_free' THEN 0.0::DOUBLE ELSE coalesce(CASE WHEN count <> '' AND period_unit <> '' THEN {qty_sql('cn')} * {factor_sql('period_unit')} / nullif(CASE WHEN period_count = '' THEN 1.0::DOUBLE ELSE {qty_sql('period_count')} END, 0) END, 1000.0::DOUBLE) END AS parts_rate,
 CASE WHEN cl = 'seizure_free' THEN 0.0::DOUBLE ELSE coalesce(CASE WHEN n <> '' AND pu <> '' THEN {qty_sql('nn')} * {factor_sql('uu')} / nullif(CASE WHEN pc = '' THEN 1.0::DOUBLE ELSE {qty_sql('pc')} END, 0) END, 1000.0::DOUBLE) END AS gold_rate FROM q2""")
def parts_and_gold_rates(spark, d):
    t = frequency_text(table(spark, d, "events")).withColumn("p", Q.frequency_parts(F.col("ftext"))).withColumn("g", Q.structured_parts(*gold_columns()))
    return t.select("event_id", Q.parts_rate(F.col("p")).alias("parts_rate"), Q.gold_rate(F.col("g"), F.col("p")).alias("gold_rate"))


@query("annotation_frequency_class", f"""WITH {FT_SQL}, {GOLD_PARTS}, p AS ({parts_sql('ft', "ftext || CASE WHEN event_id % 7 = 0 THEN ' increased' ELSE '' END", 'event_id, nv')})
SELECT event_id, CASE WHEN gu <> '' THEN 'rate' WHEN class = 'seizure_free' THEN 'seizure_free' WHEN {contains_any_sql('nv', ['increase', 'decrease', 'reduced', 'unchanged'])} THEN 'change'
 WHEN event_id % 5 = 0 THEN 'temporal' WHEN gc <> '' THEN 'count_only' WHEN class = '' THEN 'unparsed' ELSE class END AS kind FROM p JOIN g USING (event_id)""")
def annotation_frequency_class(spark, d):
    t = frequency_text(table(spark, d, "events"))
    gc, gp, gu = gold_columns()
    surface = F.concat("ftext", F.when(F.col("event_id") % 7 == 0, " increased").otherwise(""))
    scope = F.when(F.col("event_id") % 5 == 0, "Since").otherwise("null")
    return t.select("event_id", Q.annotation_class(gc, gp, gu, surface, scope).alias("kind"))


@query("number_coercion", """
WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || ' ' WHEN 1 THEN 'x1' WHEN 2 THEN '' WHEN 3 THEN CAST(event_id % 100 AS VARCHAR) || '.25' WHEN 4 THEN '1d' ELSE NULL END AS t, (['Yes', 'no', ' TRUE ', '1', '0', ''])[event_id % 6 + 1] AS b FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(t), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(t) AS DOUBLE) END AS number, lower(trim(b)) IN ('1', 'true', 'yes', 'y') AS truthy,
 CASE WHEN t IS NULL THEN 'n/a' ELSE printf('%.3f', CAST(event_id AS DOUBLE) / 8) END AS shown FROM r""")
def number_coercion(spark, d):
    e = F.col("event_id")
    t = (F.when(e % 6 == 0, F.concat(F.lit(" "), e.cast("string"), F.lit(" "))).when(e % 6 == 1, "x1").when(e % 6 == 2, "")
         .when(e % 6 == 3, F.concat((e % 100).cast("string"), F.lit(".25"))).when(e % 6 == 4, "1d"))
    r = table(spark, d, "events").select("event_id", t.alias("t"), pick(["Yes", "no", " TRUE ", "1", "0", ""], e).alias("b"))
    return r.select("event_id", T.to_number(F.col("t")).alias("number"), T.is_true_word(F.col("b")).alias("truthy"),
                    T.display_number(F.when(F.col("t").isNotNull(), e / 8)).alias("shown"))


@query("span_agreement", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 90 AS a0, l_partkey % 90 + CAST(floor(l_quantity) AS BIGINT) % 20 AS a1, l_suppkey % 90 AS b0, l_suppkey % 90 + l_linenumber * 3 AS b1 FROM lineitem),
o AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) AS ov FROM s)
SELECT a0, a1, b0, b1, max(ov) AS overlap, max(CASE WHEN (a1 - a0) + (b1 - b0) - ov > 0 THEN ov / ((a1 - a0) + (b1 - b0) - ov) ELSE 0.0 END) AS iou,
 max(CASE WHEN least(a1 - a0, b1 - b0) = 0 THEN 0.0 ELSE ov / least(a1 - a0, b1 - b0) END) AS fraction, count(*) AS n FROM o GROUP BY 1, 2, 3, 4""")
def span_agreement(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    t = table(spark, d, "lineitem").select(
        (p % 90).alias("l_start"), (p % 90 + F.floor("l_quantity") % 20).alias("l_end"), (s % 90).alias("r_start"), (s % 90 + F.col("l_linenumber") * 3).alias("r_end"))
    g = t.groupBy("l_start", "l_end", "r_start", "r_end").agg(F.count(F.lit(1)).alias("n"))
    return I.span_agreement(g).select(F.col("l_start").alias("a0"), F.col("l_end").alias("a1"), F.col("r_start").alias("b0"), F.col("r_end").alias("b1"),
                                      F.col("overlap"), "iou", "fraction", "n")


@query("attribute_agreement", """
SELECT p_partkey, ((CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_type = upper(p_type) THEN 1 ELSE 0 END)) / (2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS agreement FROM part""")
def attribute_agreement_query(spark, d):
    p = table(spark, d, "part")
    a = F.create_map(F.lit("Size"), (F.col("p_size") % 2).cast("string"), F.lit("Type"), F.col("p_type"), F.lit("CUI"), F.lit("x"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("Size"), F.lit("0"), F.lit("Type"), F.lower("p_type"), F.lit("Extra"), F.lit("1"))).otherwise(
        F.create_map(F.lit("Size"), F.lit("0"), F.lit("Type"), F.lower("p_type")))
    return p.select("p_partkey", attribute_agreement(a, b).alias("agreement"))


PHRASES = ["focal", "Null", None, "temporal-lobe-epilepsy", "eeg", "epilepsy-", "thing (x)", "brain injury", "other", "mri scan"]
_GEN = ", ".join(lit_sql(g) for g in V.GENERIC_CONCEPTS)


@query("concept_phrase_class", f"""
WITH r AS (SELECT p_partkey, coalesce({pick_sql(PHRASES, 'p_partkey + p_size')}, '') AS raw FROM part), n AS (SELECT *, rtrim(lower(trim(raw)), '-') AS t FROM r)
SELECT p_partkey, CASE WHEN lower(raw) IN ('null', 'none', '') THEN 'missing' WHEN t IN ({_GEN}) THEN 'generic' WHEN regexp_matches(t, '[()\\[\\]{{}}]') THEN 'malformed'
 WHEN length(t) <= 4 THEN 'generic' ELSE 'specific' END AS concept_class FROM n""")
def concept_phrase_class(spark, d):
    return table(spark, d, "part").select("p_partkey", N.concept_class(pick(PHRASES, F.col("p_partkey") + F.col("p_size"))).alias("concept_class"))


@query("normalised_medication_struct", f"""
WITH r AS (SELECT p_partkey, {pick_sql(['Keppra', 'lamictal', 'Epilim', None], 'p_partkey')} AS name, {pick_sql(WORDS, 'p_size')} AS tv, {pick_sql(['he now takes it', 'was stopped', ''], 'p_partkey')} AS q FROM part),
n AS (SELECT p_partkey, name, {norm_value_sql('tv')} AS own, trim({norm_value_sql('tv')} || ' ' || {norm_value_sql('q')}) AS tt FROM r)
SELECT p_partkey, CASE name WHEN 'Keppra' THEN 'levetiracetam' WHEN 'lamictal' THEN 'lamotrigine' WHEN 'Epilim' THEN 'sodium valproate' ELSE '' END AS name,
 CASE WHEN tt = '' THEN '' WHEN {contains_any_sql('tt', V.HISTORICAL_TERMS)} THEN 'historical' WHEN {contains_any_sql('tt', V.PLANNED_TERMS)} THEN 'planned'
   WHEN {contains_any_sql('tt', V.CURRENT_TERMS)} THEN 'current' WHEN own = '' THEN 'uncertain' ELSE own END AS temporality FROM n""")
def normalised_medication_struct(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    item = F.struct(pick(["Keppra", "lamictal", "Epilim", None], p).alias("name"), F.lit("500 mg").alias("dose"), F.lit("mg").alias("dose_unit"), F.lit("bd").alias("frequency"),
                    pick(WORDS, s).alias("temporality"), F.lit(None).cast("string").alias("missingness"),
                    F.array(F.struct(pick(["he now takes it", "was stopped", ""], p).alias("quote"))).alias("evidence"))
    t = table(spark, d, "part").select("p_partkey", item.alias("item"))
    return t.select("p_partkey", N.medication_struct(F.col("item")).alias("m")).select("p_partkey", "m.name", "m.temporality")


