"""Findings of round 3: values that must hold, and rows that must be computed once."""

from pyspark.sql import functions as F

from goldmeter.functions.text import find_text
from goldmeter.operators import passages as P


def test_quotes_found_through_case_folding_keep_their_own_length_and_place(spark):
    rows = spark.createDataFrame([("İİ Groß. Ende", "groẞ."), ("a İzmir b", "İZMIR"), ("abc", "x"), ("abc", "")], "t string, v string")
    got = rows.select(P.exact_quote(F.col("t"), F.col("v")).alias("q"), find_text(F.col("t"), F.col("v")).alias("at")).collect()
    assert [tuple(r) for r in got] == [("Groß.", 3), ("İzmir", 2), (None, None), (None, None)]
    upper = spark.createDataFrame([("und schß. so", "schß.")], "t string, w string").select(P.exact_quote(F.col("t"), F.upper("w")).alias("q")).first()
    assert upper["q"] in ("schß.", None)


def test_a_column_computed_once_is_not_repeated_in_filters(spark):
    from goldmeter.functions.text import computed_once

    made = computed_once(spark.range(3).select("id"), ["id"], h=F.sha2(F.col("id").cast("string"), 256)).filter(F.length("h") > 1).filter(F.col("h") != "x")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and made.count() == 3


def test_support_is_matched_inside_the_row_without_joins_on_quotes(spark):
    from fixtures import ev, gold_frames, med, record, records_frame, scalar

    from goldmeter.operators import scoring as S

    rows = [("A", "d1", record("d1", meds=[med("Keppra", evidence=ev("on Keppra")), med("clobazam", evidence=ev("absent"))], dx=scalar("epilepsy", ev("epilepsy", 20, 28))), "on Keppra today with epilepsy")]
    gold = gold_frames(spark, meds=[("d1", 0, "levetiracetam", "", "", "")], spans=[("d1", "medications", 0, 3, 9, "Prescription", ""), ("d1", "diagnosis", 1, 27, 30, "Diagnosis", "epilepsy")])
    scalars = spark.createDataFrame([("A", "d1", False, False, False, True)], "system string, document_id string, per_letter boolean, eeg_ok boolean, mri_ok boolean, dx boolean")
    out = S.evidence_support(records_frame(spark, rows), gold, scalars)
    got = {r["path"].split(".")[-1]: (r["status"], r["gold_span_count"], r["gold_overlap_count"]) for r in out.collect()}
    # an empty gold value stands in every quote, as in the containment join; offsets count before words
    assert got == {"current_anti_seizure_medications[0]": ("supported", 1, 1), "current_anti_seizure_medications[1]": ("invalid_quote", 1, 0),
                   "epilepsy_diagnosis": ("supported", 1, 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
