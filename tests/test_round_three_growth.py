"""Findings of round 3 that name a growth: work done once a row, in one pass, and only what is asked for."""

from fixtures import ev, gold_frames, med, record, records_frame, scalar

from goldmeter.functions import vocabulary as V
from goldmeter.operators import chains as CH
from goldmeter.operators import dictionary as D
from goldmeter.operators import perturb as X
from goldmeter.operators import selection as SEL
from goldmeter.operators import statistics as ST


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def small_gold(spark):
    return gold_frames(
        spark, [("d1", 0, "levetiracetam", "500", "mg", "twice daily")], [("d1", 0, "2 per 1 month", "2", "1", "month", "focal seizure", "", "two per month")],
        [("d1", 0, "focal seizure")], [("d1", "normal", None)], [("d1", 0, "epilepsy")],
        [("d1", "medications", 4, 9, 12, "Prescription", "b"), ("d1", "medications", 4, 2, 5, "Prescription", "a"), ("d1", "diagnosis", 1, 30, 38, "Diagnosis", None)])


def test_a_candidate_is_normalised_once_before_it_is_ranked(spark):
    events = SEL.gold_events(small_gold(spark))
    assert optimized(SEL.aggregate_events(events)).count(V.FORMULATION_PATTERN) == 1
    spans = {r.id: (r.evidence.quote, r.evidence.char_start, r.evidence.char_end) for r in events.collect()}
    # the smallest place of one order number counts, an empty span value gives the value itself
    assert spans["gold_med_1"] == ("a", 2, 5) and spans["gold_dx_1"] == ("epilepsy", 30, 38)
    assert spans["gold_eeg"] == ("normal", None, None)


def test_long_scores_need_one_pass_and_only_their_columns(spark):
    gold = small_gold(spark)
    side = CH.event_side(SEL.aggregate_events(SEL.gold_events(gold)), spark.createDataFrame([("d1",), ("d2",)], "document_id string"), "oracle")
    wanted = ["medication_full", "eeg", "current_seizure_frequency_pragmatic"]
    part = CH.score_sides(side, CH.gold_side(gold), CH.columns_for(wanted))
    assert part.columns == [*CH.KEY, "sets", "pred_coarse", "gold_coarse", "eeg_ok"]
    rows = CH.long_scores(part, wanted)
    assert "Union" not in optimized(rows).split("Join")[0] and V.EVERY_PATTERN not in optimized(CH.long_scores(CH.score_sides(side, CH.gold_side(gold), ["eeg_ok"]), ["eeg"]))
    whole = CH.long_scores(CH.score_sides(side, CH.gold_side(gold)))
    assert sorted(map(str, rows.collect())) == sorted(map(str, whole.filter(whole.metric.isin(wanted)).collect()))
    assert whole.count() == 2 * 21


def test_exact_draws_are_not_grouped_by_position(spark):
    rows = spark.createDataFrame([("S", i, i % 2, i % 3) for i in range(300)], "system string, doc_id int, tp long, fp long")
    out = ST.resample_exact(rows, ["system"], "doc_id", 20, 42, ["tp", "fp"])
    plan = optimized(out)
    assert "iteration" in plan and not any("iteration" in line and "_pos" in line for line in plan.splitlines() if "Aggregate [" in line)
    assert "ShuffledHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
    got = out.collect()
    assert len(got) == 20 and all(r.n == 300 for r in got) and len({r.tp for r in got}) > 5


def test_scores_without_facts_look_for_no_quotes(spark):
    rows = [("A", "d1", record("d1", meds=[med("Keppra", "500", "mg", "bd", ev("on Keppra"))], dx=scalar("epilepsy", ev("epilepsy"))), "on Keppra")]
    records, gold = records_frame(spark, rows), CH.gold_side(small_gold(spark))
    slim = CH.score_sides(CH.record_side(records, facts=False), gold, ["sets", "exact", "dx", "pred_fine"])
    whole = CH.score_sides(CH.record_side(records), gold).select(*slim.columns)
    assert slim.collect() == whole.collect()
    sets = CH.set_rows(CH.score_sides(CH.record_side(records, facts=False), gold, ["sets"]))
    plan = optimized(sets)
    assert V.EVERY_PATTERN not in plan and "record#" in plan and "text#" not in plan.split("Generate")[1]
    assert {r.metric: r.f1 for r in sets.collect()}["medication_full"] == 1.0


def test_a_letters_claims_share_its_perturbed_text(spark):
    letters = spark.createDataFrame([(1, "On Keppra today.\n"), (2, "Nothing.")], "document_id int, text string")
    claims = spark.createDataFrame([(1, "keppra", "x"), (1, "abnormal mri", "y"), (1, "", "y"), (1, None, "y"), (2, "İ", "z")], "document_id int, value string, kind string")
    listed = [p for p in X.LETTER_PERTURBATIONS + X.LABEL_PERTURBATIONS if p.id == "negated_investigation_trap"]
    out = X.trap_audit(letters, claims, listed, ["perturbation_id", "kind"])
    assert {r.kind: (r.quotes, r.trap_quotes, r.invalid_quotes) for r in out.collect()} == {"x": (1, 0, 0), "y": (1, 1, 0), "z": (1, 0, 0)}
    # a version's text is made and folded once, not once a claim
    assert optimized(out).count("There is no report") == 1 and optimized(out).count("Join ") == 1


def test_texts_are_dealt_out_before_their_stretches_are_made(spark):
    texts = spark.createDataFrame([(1, "A tonic-clonic seizure"), (2, None), (3, "")], "document_id int, text string")
    hits = D.dictionary_hits(texts, spark.createDataFrame([("tonic clonic", "gtc"), ("seizure", "s")], "surface string, concept string"))
    assert sorted((r.word_no, r.n, r.char_start, r.char_end, r.concept) for r in hits.collect()) == [(1, 2, 2, 14, "gtc"), (3, 1, 15, 22, "s")]
    assert "RepartitionByExpression" in optimized(hits) and "posexplode" in optimized(hits)
