import os
import random

import pytest
from fixtures import ev, inv, med, record, records_frame, scalar
from pyspark.sql import functions as F

from goldmeter.operators import corpus_audit as CA
from goldmeter.operators import grounding as G
from goldmeter.operators import intervals as I
from goldmeter.operators import passages as P
from goldmeter.operators import records as R
from goldmeter.sources import annotations as SA
from goldmeter.sources import letters as SL


def _greedy_reference(users, gold):
    """Plain restatement of the rule: each user in order takes the best free gold of its label."""
    taken, out = set(), set()
    for doc, label, uid, s, e in users:
        best, who = 0.0, None
        for gdoc, glabel, gid, gs, ge in gold:
            if (gdoc, glabel) != (doc, label) or gid in taken:
                continue
            inter = max(0, min(e, ge) - max(s, gs))
            union = (e - s) + (ge - gs) - inter
            score = inter / union if union else 0.0
            if score > best:
                best, who = score, gid
        if who is not None and best >= 0.5:
            taken.add(who)
            out.add((doc, label, uid, who))
    return out


def test_greedy_match_equals_brute_force(spark):
    rnd = random.Random(7)

    def side(p, n):
        return [(f"d{rnd.randrange(3)}", rnd.choice("XY"), f"{p}{i}", s, s + rnd.randrange(1, 9)) for i, s in ((i, rnd.randrange(30)) for i in range(n))]

    users, gold = side("u", 120), side("g", 120)
    schema = "document_id string, label string, ann_id string, start int, end int"

    def frame(rows):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", ord int")
        return df.withColumn("attributes", F.create_map(F.lit("a"), F.lit("1")))

    u, g = frame(users), frame(gold)
    m = I.greedy_span_match(u, g)
    assert {(r.document_id, r.label, r.user_id, r.gold_id) for r in m.collect()} == _greedy_reference(users, gold)
    total = {r.label: r for r in I.span_scores(u, g, m).collect()}["__all__"]
    assert total.span_tp + total.span_fp == 120 and total.span_tp + total.span_fn == 120 and total.full_tp == total.span_tp


def test_overlap_join_equals_brute_force(spark):
    rnd = random.Random(3)
    spans = [("d", i, s, s + rnd.randrange(0, 700)) for i, s in ((i, rnd.randrange(2000)) for i in range(150))]
    left = spark.createDataFrame(spans, "document_id string, l int, l_start int, l_end int")
    right = spark.createDataFrame(spans, "document_id string, r int, r_start int, r_end int")
    got = {(r.l, r.r) for r in I.overlapping_pairs(left, right, ["document_id"]).collect()}
    assert got == {(a[1], b[1]) for a in spans for b in spans if min(a[3], b[3]) > max(a[2], b[2])}


def test_sentences(column_values):
    text = ". Lead dot. Next one! 3.5 mg? ok\n\n  Head:\tx \nNo end"
    (rows,) = column_values(P.sentence_spans, [text])
    assert [r.text for r in rows] == [". Lead dot.", "Next one!", "3.5 mg?", "ok", "Head:\tx", "No end"]
    assert all(text[r.char_start:r.char_end] == r.text for r in rows) and rows[0].sentence_id == "s0001"


LETTER = ("He takes Keppra 500mg. EEG was normal. Complex partial fits happen twice\nper month. "
          "There is a family history of absence seizures. She has juvenile–myoclonic epilepsy.")


@pytest.fixture(scope="module")
def grounded(spark):
    rec = record("d1", [med("levetiracetam"), med("warfarin")], scalar("twice per month"),
                 [scalar("focal impaired awareness seizure"), scalar("absence seizures")], inv("normal"), None,
                 scalar("juvenile-myoclonic epilepsy"))
    frame = records_frame(spark, [("A", "d1", rec, LETTER)])
    return frame, G.ground_records(frame)


def test_cascade(grounded):
    rows = {r.path: r for r in grounded[1].collect()}
    pick = {p: (r.grounded_by, r.quote) for p, r in rows.items()}
    assert pick["fields.current_anti_seizure_medications[0].name"] == ("synonym", "He takes Keppra 500mg")
    assert pick["fields.current_anti_seizure_medications[1].name"] == ("ungrounded", None)
    assert pick["fields.current_seizure_frequency.value"][0] == "normalized"
    assert pick["fields.seizure_types[0].value"][0] == "synonym"
    assert pick["fields.seizure_types[1].value"] == ("ungrounded", None)
    assert pick["fields.eeg.result"] == ("exact", "EEG was normal")
    assert pick["fields.epilepsy_diagnosis.value"][0] == "normalized"


def test_injection_changes_only_evidence(spark, grounded):
    frame, found = grounded
    new = G.inject_evidence(frame, found, ["system", "document_id"]).collect()[0].record.asDict(True)
    old = frame.collect()[0].record.asDict(True)

    def stripped(x):
        if isinstance(x, dict):
            return {k: stripped(v) for k, v in x.items() if k != "evidence"}
        return [stripped(v) for v in x] if isinstance(x, list) else x

    assert stripped(new) == stripped(old)
    assert new["fields"]["eeg"]["evidence"][0]["quote"] == "EEG was normal"
    again = G.inject_evidence(G.inject_evidence(frame, found, ["system", "document_id"]), found, ["system", "document_id"])
    assert again.collect()[0].record.asDict(True) == new


def test_quote_characters_stay_literal(column_values):
    # a curly quote in the letter is not matched by a straight one in the value; dashes are
    text = F.lit("the patient’s well–being")
    assert column_values(lambda v: P.tolerant_quote(text, v), ["patient's", "well-being"]) == [None, "well–being"]


def test_violation_rules(spark):
    bad = record("d", [med("x", evidence=ev(" ")), med("y", status="lost", evidence=ev("q"))], scalar("v"))
    row = R.check_records(records_frame(spark, [("A", "d", bad, "")]).drop("text")).collect()[0]
    assert set(row.violations) == {"current_anti_seizure_medications.evidence", "current_anti_seizure_medications.status",
                                   "current_seizure_frequency.evidence"} and not row.valid


CORPUS = os.environ.get("GOLDMETER_CORPUS")


@pytest.mark.skipif(not CORPUS, reason="set GOLDMETER_CORPUS to the folder of letters and stand-off annotations")
def test_published_corpus_numbers(spark):
    docs = SL.letters(spark, CORPUS)
    ann = SA.annotations(spark, CORPUS).cache()
    assert ann.count() == 2092
    tiers = {r.tier: r.n for r in I.conflict_counts(ann).groupBy("tier").agg(F.sum("pairs").alias("n")).collect()}
    assert (tiers["tier1_numeric_conflict"], tiers["tier2_cuiphrase_mismatch"], tiers["tier3_exact_duplicate"]) == (30, 24, 13)
    pairs = {r.tier: r.n for r in I.conflict_pairs(ann).groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert pairs == tiers
    concept = {r.c: r.n for r in CA.concept_specificity(ann).groupBy(F.col("cuiphrase_class").alias("c")).agg(F.count("*").alias("n")).collect()}
    assert concept == {"specific": 1602, "generic": 483, "missing": 7}
    rx = CA.prescriptions(ann)
    assert rx.filter("NOT has_dose").count() == 6 and rx.filter("has_dose AND NOT dose_in_span").count() == 103
    clash = I.contradiction_counts(CA.frequency_statements(ann)).agg(F.sum("pairs"), F.count("*")).collect()[0]
    assert tuple(clash) == (30, 20)
    issues = {r.i: r.n for r in CA.span_integrity(ann, docs).groupBy(F.col("issue_type").alias("i")).agg(F.count("*").alias("n")).collect()}
    assert (issues["mismatch"], issues["span_longer_than_source"], issues["partial_overlap"], issues["truncated_span"]) == (160, 72, 47, 2)
    assert CA.letter_quality(docs).filter("pronoun_mismatch").count() == 24
