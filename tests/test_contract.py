"""Payload shapes against the records they mean, written by hand from the contract."""

import json

import pytest
from pyspark.sql import functions as F

from goldmeter.operators.contract import recode_tree

TAIL = {"missingness": "present", "temporality": "current", "evidence_event_ids": []}


@pytest.fixture(scope="module")
def recode(spark):
    def run(*payloads):
        rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
        out = spark.createDataFrame(rows, "i int, p string").select("i", recode_tree(F.col("p"), F.lit("D"), F.lit("P")).alias("r")).orderBy("i").collect()
        return [r["r"] and r["r"].asDict(True) for r in out]

    return run


def test_evidence_shapes(recode):
    def med(evidence):
        return {"fields": {"current_anti_seizure_medications": [{"name": "x", "dose": 500, **TAIL, **evidence}]}}

    got = recode(med({"evidence": {"text": "q", "char_start": 3}}), med({"evidence": {"quote": "q", "text": "t"}}), med({"evidence": [{"quote": "a"}, {"quote": "b"}]}),
                 med({"evidence": []}), med({"evidence": None}), med({}), med({"evidence": {}}), med({"evidence": "said"}))
    first = [r["fields"]["current_anti_seizure_medications"][0] for r in got]
    assert [[e["quote"] for e in m["evidence"] or []] for m in first] == [["q"], ["q"], ["a", "b"], [], [], [], [None], []]
    assert first[0]["evidence"][0]["char_start"] == 3 and first[0]["dose"] == "500"
    # without an evidence key an object is no field and stays present; an unreadable evidence is still one
    assert [m["missingness"] for m in first] == ["present", "present", "present", "uncertain", "uncertain", "present", "present", "present"]


def test_events(recode):
    def event(**own):
        return {"events": [{"id": "e1", "category": "medication", **own}]}

    got = recode(event(value={"medication_name": "Keppra", "dose": 250, "dose_unit": "mg"}), event(value={"value": "two", "dose": 1.5}, dose="9"), event(value={"b": 1, "a": "x"}),
                 event(medication_name="M"), event(result="negative", investigation_type="EEG"), event(value=None, medication_name="M"), event(investigation_type="CT", value="v", status="historical", temporality="previous"),
                 {"events": [{"id": "e1"}, {"id": "e2"}, {"id": "e1"}, {"id": None}, {"id": "e1"}]}, event(evidence=[{"text": "one"}, {"quote": "two"}]), event(evidence={"text": "one"}), event(evidence=[]))
    e = [r["events"][0] for r in got]
    assert (e[0]["value"], e[0]["medication_name"], e[0]["dose"], e[0]["dose_unit"]) == ("Keppra", "Keppra", "250", "mg")
    assert (e[1]["value"], e[1]["dose"]) == ("two", "9")
    assert e[2]["value"] == '{"a":"x","b":1}'
    assert (e[3]["value"], e[4]["value"], e[4]["result"], e[5]["value"]) == ("M", "normal", "normal", None)
    assert (e[6]["investigation_type"], e[6]["status"], e[6]["temporality"], e[4]["investigation_type"]) == (None, "previous", "historical", "EEG")
    assert [x["id"] for x in got[7]["events"]] == ["e1", "e2", "e1_2", None, "e1_3"]
    assert [e[8]["evidence"]["quote"], e[9]["evidence"]["quote"], e[10]["evidence"]] == ["one", "one", None]


def test_hoisted_results_and_defaults(recode):
    eeg = {"status": "planned", "result": "negative", **TAIL, "evidence": [{"quote": "q"}]}
    got = recode({"fields": {}, "eeg": eeg, "epilepsy_diagnosis": {"value": "JME"}}, {"fields": {"eeg": None}, "eeg": eeg}, {"eeg": eeg}, {"fields": {"eeg": {"status": "planned"}}},
                 {"document_id": "", "pipeline_id": "own", "metadata": {"input_tokens": None, "output_tokens": 7, "model": "m"}})
    assert (got[0]["fields"]["eeg"]["status"], got[0]["fields"]["eeg"]["result"], got[0]["fields"]["epilepsy_diagnosis"]["value"]) == ("requested", "normal", "JME")
    assert got[1]["fields"]["eeg"] is None and got[2]["fields"] is None and got[3]["fields"]["eeg"]["status"] == "planned"
    assert (got[4]["document_id"], got[4]["pipeline_id"], got[0]["document_id"], got[0]["pipeline_id"]) == ("D", "own", "D", "P")
    assert (got[4]["metadata"]["input_tokens"], got[4]["metadata"]["output_tokens"], got[0]["metadata"]["input_tokens"]) == (0.0, 7.0, 0.0)


def test_no_objects(recode):
    assert recode(None, "", "[1]", "7", "null", "{broken", '"x"') == [None] * 7
    assert recode('{"document_id": "a\nb"}')[0]["document_id"] == "a b"
