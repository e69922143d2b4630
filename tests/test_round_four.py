"""Findings of round 4 that name a time: each query reads its records once and computes what it shows, inside the row."""

import pytest
from fixtures import ev, gold_frames, inv, med, record, records_frame, scalar

import __spark_entry__ as entry
from goldmeter.functions import vocabulary as V
from goldmeter.operators import chains as CH
from goldmeter.operators import matching as M
from goldmeter.operators import review as RV
from goldmeter.operators import scoring as S
from goldmeter.operators import statistics as ST

SF = "/root/testdata/sf0.001"
MATCHED = ["tp_keys", "fp_keys", "fn_keys"]


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def query_plan(spark, name):
    return optimized(entry.queries()[name](spark, SF))


@pytest.fixture(scope="module")
def corpus(spark):
    gold = gold_frames(
        spark, [("d1", 0, "levetiracetam", "500", "mg", "twice daily"), ("d1", 1, "lamotrigine", "", "", "")],
        [("d1", 0, "2 per 1 month", "2", "1", "month", "focal seizure", "", "two per month"), ("d4", 0, "1 per 1 day", "1", "1", "day", "", "", "daily")],
        [("d1", 0, "focal seizure"), ("d1", 1, "dizzy turns"), ("d4", 0, ""), ("d5", 0, "unknown seizure type")], [("d1", "normal", None)], [("d1", 0, "epilepsy")],
        [("d1", "medications", 0, 3, 9, "Prescription", "Keppra"), ("d1", "diagnosis", 1, 30, 38, "Diagnosis", "epilepsy"), ("d4", "eeg", 2, 0, 4, "EEG", "")])
    good = record("d1", [med("Keppra", "500", "mg", "bd", ev("on Keppra"))], scalar("two per month", ev("two per month"), temporal_scope="current", seizure_type="focal"),
                  [scalar("focal seizures", ev("focal"))], inv("normal", ev("EEG normal", 0, 4)), None, scalar("focal epilepsy", ev("not there")))
    poor = record("d1", [med("Keppra", "250", "mg", "bd"), med("Keppra", "250", "mg", "bd", ev("on  Keppra"), status="previous")],
                  scalar("daily", temporal_scope="current", seizure_type=None), [scalar("absence")])
    vague = record("d5", types=[scalar("seizures")])
    rows = [("A", "d1", good, "on Keppra, two per month, focal"), ("B", "d1", poor, "on Keppra"), ("A", "d2", record("d2"), ""),
            ("A", "d4", poor | {"document_id": "d4"}, None), ("A", "d5", vague, "x"), ("B", "d5", record("d5", types=[scalar("absence")]), "x")]
    expected = spark.createDataFrame([(s, d) for s in "AB" for d in ("d1", "d2", "d4", "d5", "d6")], "system string, document_id string")
    return records_frame(spark, rows), gold, expected


def told(corpus, *only):
    records, gold, _ = corpus
    side = CH.record_side(records, predictions=False) if "sets" in only else CH.record_side(records, facts=False)
    return CH.score_sides(side, CH.gold_side(gold), list(only))


def by_joins(corpus):
    """Facts, set rows, flags and scalar rows as the general operators tell them."""
    records, gold, _ = corpus
    flags = S.set_score_flags(records, gold)
    facts = S.document_facts(records)
    return facts, S.set_scores(records, flags), flags, S.scalar_long(S.scalar_scores(facts, gold))


def same(got, want):
    def rounded(rows):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)

    assert rounded(got.select(*want.columns).collect()) == rounded(want.collect())


def test_document_utility_is_told_inside_the_row(spark, corpus):
    facts, sets, _, _ = by_joins(corpus)
    from pyspark.sql import functions as F
    want = ST.document_utility(sets.select("system", "document_id", F.col("f1").alias("utility")), facts.withColumn("available", F.lit(True)))
    same(CH.document_utility(told(corpus, "sets", *CH.QUALITY)), want)
    plan = query_plan(spark, "document_utility")
    assert plan.count("Join ") == 1 and V.EVERY_PATTERN not in plan


def test_error_budget_joins_once(spark, corpus):
    from pyspark.sql import functions as F
    facts, sets, _, scalars = by_joins(corpus)
    expected, metrics = corpus[2], ["medication_name", "seizure_type"]
    found = M.expected_available(expected, facts.select(*CH.KEY, "schema_valid", (F.col("quotes") - F.col("valid_quotes")).alias("invalid_quotes")), CH.KEY)
    want = ST.error_budget(S.utilities(expected, S.document_scores(sets, scalars), metrics), found)
    same(CH.error_budget(expected, told(corpus, "sets", *CH.QUALITY), metrics), want)
    plan = query_plan(spark, "error_budget")
    assert plan.count("Join ") == 2 and V.EVERY_PATTERN not in plan


def test_failure_tags_are_told_inside_the_row(spark, corpus):
    from pyspark.sql import functions as F
    facts, sets, _, _ = by_joins(corpus)
    rows = sets.select(*CH.KEY, "metric", F.lit("set").alias("kind"), "fp", "fn", F.lit(None).cast("boolean").alias("correct"))
    same(CH.failure_tags(told(corpus, "sets", *CH.QUALITY)), RV.failure_tags(rows, facts.withColumn("available", F.lit(True))))
    assert query_plan(spark, "failure_tags").count("Join ") == 1


def test_field_table_is_one_pass(spark, corpus):
    _, _, flags, scalars = by_joins(corpus)
    wanted = S.SCALAR_METRICS[:4]
    same(CH.field_table(told(corpus, *MATCHED, *CH.columns_for(wanted)), wanted), S.field_table(flags, scalars))
    assert query_plan(spark, "field_precision_recall").count("Join ") == 1


def test_failure_modes_look_for_no_quotes(spark, corpus):
    plan = query_plan(spark, "frequency_failure_modes")
    assert V.FORMULATION_PATTERN not in plan and "Medication:" not in plan


def test_abstention_needs_seizure_types_only(spark, corpus):
    records, gold, _ = corpus
    flags = S.set_score_flags(records, gold)
    got = CH.abstention(CH.score_sides(CH.type_side(records), CH.gold_side(gold), MATCHED))
    same(got, S.abstention(flags, records))
    assert {(r.system, r.document_id): r.category for r in got.collect()}["B", "d5"] == "unsupported_specificity"
    plan = query_plan(spark, "abstention_rates")
    assert plan.count("Join ") == 1 and V.FORMULATION_PATTERN not in plan


def test_errors_are_attributed_from_keys_alone(spark, corpus):
    flags = S.set_score_flags(corpus[0], corpus[1])
    same(RV.attribute_errors(CH.key_flags(told(corpus, *MATCHED)), None, "B"), RV.attribute_errors(flags, None, "B"))
    assert V.EVERY_PATTERN not in query_plan(spark, "failure_pareto")


def test_claims_meet_gold_in_one_pass(spark, corpus):
    records, gold, _ = corpus
    want = S.evidence_support(records, gold, CH.score_sides(CH.record_side(records), CH.gold_side(gold)))
    assert {"supported", "invalid_quote", "no_quote"} <= {r.status for r in want.collect()}
    same(CH.evidence_support(records, gold), want)
    plan = query_plan(spark, "evidence_support")
    assert plan.count("Join ") == 1 and plan.count("Medication:") == 2 and V.FORMULATION_PATTERN in plan


def test_support_rates_are_one_pass(spark):
    plan = query_plan(spark, "evidence_support_rates")
    assert plan.count("Join ") == 1 and plan.count(V.EVERY_PATTERN) == 6


def test_values_are_folded_once_a_mention(spark, corpus):
    from pyspark.sql import functions as F

    from goldmeter.functions import normalize as N
    from goldmeter.functions.text import norm_value
    from goldmeter.operators import records as R

    values = spark.createDataFrame([(v,) for v in ("None", " N/A ", "not-stated", "unknown type", "unknown", "", None, "n a", "Nan\n", "1.5 /d")], "v string")
    assert [r[0] for r in values.select(norm_value(F.col("v"))).collect()] == ["", "", "", "unknown type", "", "", "", "n a", "", "1.5 /d"]
    plan = optimized(values.select(N.dosing_schedule(F.col("v")).alias("s"), N.dose_unit(F.col("v")).alias("u")))
    assert plan.count("[^a-z0-9./]+") == 2
    # validity and counts without names and paths tell what the lists with them tell
    odd = corpus[0].withColumn("record", F.explode(F.array(
        "record", F.col("record").withField("fields.eeg.status", F.lit("lost")), F.col("record").withField("fields.current_seizure_frequency", F.lit(None)),
        F.col("record").withField("fields.seizure_types", F.lit(None)), F.col("record").withField("events", F.lit(None)), F.col("record").withField("fields", F.lit(None)),
        F.col("record").withField("fields.current_anti_seizure_medications", F.transform("record.fields.current_anti_seizure_medications", lambda m: m.withField("evidence", F.lit(None)))))))
    r = F.col("record")
    rows = odd.select(*[(F.size(R.violations(r, q)) == 0).alias(f"a{q}") for q in (True, False)], *[R.is_valid(r, q).alias(f"b{q}") for q in (True, False)],
                      F.transform(R.evidence_of(r), lambda e: e["quote"]).alias("quotes"), R.quotes_of(r).alias("found"),
                      F.transform(R.fields_of(r), lambda x: x["with_evidence"]).alias("w"), F.transform(R.field_flags(r), lambda x: x["with_evidence"]).alias("v")).collect()
    assert {x.aTrue for x in rows} == {True, False}
    assert all(x.aTrue == x.bTrue and x.aFalse == x.bFalse and x.quotes == x.found and x.w == x.v for x in rows)


def test_raw_scores_read_medications_for_their_keys_only(spark):
    payload = '{"medications": [{"name": "Keppra", "dose": "500", "unit": "mg", "frequency": "bd"}, "lamictal"], "seizure_types": "focal seizures"}'
    rows = spark.createDataFrame([("P", "d1", payload), ("P", "d2", None)], "system string, document_id string, payload string")
    whole, slim = CH.payload_side(rows), CH.payload_side(rows, counts=False)
    assert not any(c.startswith("raw_") for c in slim.columns) and whole.select(*slim.columns).collect() == slim.collect()
    plan = query_plan(spark, "raw_payload_scores")
    assert "pred_fine" not in plan and "_medication#" not in plan


def test_raw_summary_computes_its_verdicts_only(spark):
    plan = query_plan(spark, "raw_payload_summary")
    assert "pred_fine" not in plan and "count_hit" not in plan and "raw_medication_count" in plan
