import pytest
from fixtures import ev, gold_frames, inv, med, record, records_frame, scalar
from pyspark.sql import functions as F

from goldmeter.operators import matching as M
from goldmeter.operators import scoring as S
from goldmeter.plans.evaluate import evaluate

TEXT = "He takes Keppra 500 mg bd. Two focal seizures per month. EEG was normal. Epilepsy is likely."


@pytest.fixture(scope="module")
def frames(spark):
    good = record(
        "d1", [med("Keppra", "500", "mg", "bd", ev("Keppra 500 mg bd", 9, 25))],
        scalar("two per month", ev("Two focal seizures per month"), temporal_scope="current", seizure_type="focal"),
        [scalar("focal seizures", ev("focal seizures", 31, 45))], inv("normal", ev("not in the letter")), None,
        scalar("focal epilepsy", ev("Epilepsy is likely", 73, 91)))
    poor = record("d1", [med("lamictal", evidence=ev("Keppra", 9, 15)), med("Keppra", "250", "mg", "bd")], None,
                  [scalar("absence", ev("seizures", 37, 45))])
    empty = record("d2")
    records = records_frame(spark, [("A", "d1", good, TEXT), ("B", "d1", poor, TEXT), ("A", "d2", empty, "nothing")])
    gold = gold_frames(
        spark, [("d1", 0, "levetiracetam", "500", "mg", "twice daily")],
        [("d1", 0, "2 per 1 month", "2", "1", "month", "focal seizure", "", "Two focal seizures per month"),
         ("d3", 0, "1 per 1 day", "1", "1", "day", "", "", "daily")],
        [("d1", 0, "focal seizure")], [("d1", "normal", None)], [("d1", 0, "epilepsy")],
        [("d1", "medications", 0, 9, 25, "Prescription", "Keppra-500-mg-bd"),
         ("d1", "seizure_frequency", 0, 27, 55, "SeizureFrequency", "two focal seizures per month"),
         ("d1", "diagnosis", 0, 73, 81, "Diagnosis", "epilepsy")])
    expected = M.expected_pairs(spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string"), ["A", "B"])
    return evaluate(records, expected, gold) | {"records": records, "expected": expected, "gold": gold}


def test_set_scores(frames):
    rows = {(r.system, r.document_id, r.metric): r for r in frames["set_scores"].collect()}
    full = rows["A", "d1", "medication_full"]
    assert (full.tp, full.fp, full.fn, full.f1) == (1, 0, 0, 1.0)
    worse = rows["B", "d1", "medication_name"]
    assert (worse.tp, worse.fp, worse.fn) == (1, 1, 0) and worse.f1 == pytest.approx(2 / 3)
    assert rows["B", "d1", "medication_full"].tp == 0 and rows["B", "d1", "medication_full"].fp == 2
    assert rows["A", "d2", "medication_name"].f1 == 1.0
    assert len(rows) == 3 * len(S.SET_METRICS)


def test_scalar_scores(frames):
    rows = {(r.system, r.document_id): r for r in frames["scalars"].collect()}
    a, b, e = rows["A", "d1"], rows["B", "d1"], rows["A", "d2"]
    assert a.loose and a.per_letter and a.relaxed and not a.exact and a.linked and a.scope_ok
    assert a.eeg_ok and a.mri_ok and a.dx and not a.dx_coarse
    assert (a.pred_coarse, a.gold_coarse) == ("frequent", "frequent")
    assert not b.per_letter and not b.scope_ok and not b.eeg_ok and b.mri_ok and not b.dx
    assert e.scope_ok and not e.per_letter and (e.pred_coarse, e.gold_coarse) == ("UNK", "UNK") and e.gold_annotations == 0


def test_support(frames):
    got = {(r.system, r.path.split(".")[-1]): (r.status, r.gold_overlap_count) for r in frames["support"].collect()}
    assert got["A", "current_anti_seizure_medications[0]"] == ("supported", 1)
    assert got["A", "current_seizure_frequency"] == ("supported", 1)
    assert got["A", "seizure_types[0]"] == ("co_located", 0)
    assert got["A", "eeg"] == ("invalid_quote", 0)
    assert got["A", "epilepsy_diagnosis"] == ("supported", 1)
    assert got["B", "current_anti_seizure_medications[0]"] == ("contradicts_gold", 1)
    assert got["B", "current_anti_seizure_medications[1]"][0] == "no_quote"
    total = S.support_summary(frames["support"], ["system"]).collect()
    assert all(r.claims == r.supported + r.contradicts_gold + r.co_located + r.ambiguous + r.invalid_quote + r.no_quote for r in total)


def test_abstention(spark, frames):
    rows = {(r.system, r.document_id): r.category for r in frames["abstention"].collect()}
    assert rows == {("A", "d1"): "specificity_match", ("B", "d1"): "specificity_error", ("A", "d2"): "non_abstention_case"}
    cases = [
        ("x1", [("u", 1, 1)], "correct_abstention"), ("x2", [("u", 0, 1), ("f", 1, 0)], "unsupported_specificity"),
        ("x3", [("u", 0, 1)], "missed_abstention"), ("x4", [("f", 0, 1), ("u", 1, 0)], "over_abstention"),
        ("x5", [("f", 0, 1)], "missing_specific_prediction"), ("x6", [("f", 0, 1), ("a", 1, 0)], "granularity_mismatch"),
    ]
    names = {"u": "unknown seizure type", "f": "focal seizure", "a": "focal aware seizure"}
    flags, docs = [], []
    for doc, keys, _ in cases:
        docs.append(("S", doc))
        for k, p, g in keys:
            flags.append(("S", doc, "seizure_type", names[k], bool(p), bool(g)))
        if doc == "x6":
            flags.append(("S", doc, "seizure_type_collapsed", "focal seizure or epilepsy", True, True))
    f = spark.createDataFrame(flags, "system string, document_id string, metric string, key string, in_pred boolean, in_gold boolean")
    got = S.abstention(f, spark.createDataFrame(docs, "system string, document_id string"))
    assert {r.document_id: r.category for r in got.collect()} == {c[0]: c[2] for c in cases}


def test_summary(frames):
    rows = {r.system: r for r in frames["summary"].collect()}
    a = rows["A"]
    assert (a.documents_expected, a.documents_available) == (3, 2)
    assert a.medication_full_f1 == 1.0 and a.quote_validity_rate == pytest.approx(4 / 5)
    assert a.quote_presence_rate == 1.0 and a.temporal_accuracy == 1.0 and a.schema_valid_rate == 1.0
    assert a.epilepsy_diagnosis_accuracy == 0.5 and a.current_seizure_frequency_pragmatic_f1 == 1.0
    assert a.evidence_support_rate == pytest.approx(3 / 5)
    assert rows["B"].schema_valid_rate == 0.0 and rows["B"].medication_name_f1 == pytest.approx(2 / 3)


def test_field_table_and_invariants(frames):
    rows = {(r.system, r.field, r.label): r for r in frames["field_table"].collect()}
    assert rows["B", "medication_name", "lamotrigine"].fp == 1
    assert rows["B", "medication_name", "__micro__"].tp == 1
    acc = rows["A", "current_seizure_frequency_per_letter", "__document_accuracy__"]
    assert (acc.tp, acc.fp, acc.recall) == (1, 1, 1.0)
    bad = frames["scalars"].filter(F.col("loose") & ~F.col("per_letter"))
    assert bad.count() == 0
    sums = frames["flags"].groupBy("system", "document_id", "metric").agg(F.count_if("in_gold").alias("g"))
    joined = frames["set_scores"].join(sums, ["system", "document_id", "metric"])
    assert joined.filter(F.col("tp") + F.col("fn") != F.col("g")).count() == 0


def test_class_report(spark):
    pairs = M.pair_counts(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "g string, p string"), "g", "p")
    rows = {r["class"]: r for r in M.class_rows(pairs).collect()}
    assert rows["a"].precision == 0.5 and rows["a"].recall == 0.5 and rows["c"].f1 == 0.0
    total = M.class_report(pairs).collect()[0]
    assert total.micro_f1 == 0.5 and total.support == 4
    assert total.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3)
