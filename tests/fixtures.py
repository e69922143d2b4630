"""Hand-made records, gold tables and letters shared by the tests."""

from __future__ import annotations

from goldmeter.sources.schemas import CANONICAL


def ev(quote, start=None, end=None):
    return [{"quote": quote, "sentence_id": None, "char_start": start, "char_end": end}]


def scalar(value, evidence=None, **more):
    there = value is not None
    return {"value": value, "missingness": "present" if there else "not_stated",
            "temporality": "current" if there else "uncertain", "evidence": evidence, "evidence_event_ids": [], **more}


def med(name, dose=None, unit=None, freq=None, evidence=None, **more):
    return {"name": name, "dose": dose, "dose_unit": unit, "frequency": freq, "status": "current",
            "missingness": "present", "temporality": "current", "evidence": evidence, "evidence_event_ids": [], **more}


def inv(result, evidence=None, status="completed"):
    there = result is not None
    return {"status": status if there else "not_stated", "result": result or "not_stated",
            "missingness": "present" if there else "not_stated", "temporality": "completed" if there else "uncertain",
            "evidence": evidence, "evidence_event_ids": []}


def record(doc, meds=(), freq=None, types=(), eeg=None, mri=None, dx=None, events=(), meta=None):
    return {
        "document_id": doc, "pipeline_id": "p",
        "fields": {
            "current_anti_seizure_medications": list(meds), "previous_anti_seizure_medications": [],
            "current_seizure_frequency": freq or scalar(None, temporal_scope=None, seizure_type=None),
            "seizure_types": list(types), "eeg": eeg or inv(None), "mri": mri or inv(None),
            "epilepsy_diagnosis": dx or scalar(None),
        },
        "events": list(events), "metadata": meta or {"latency_ms": 10.0, "input_tokens": 100.0, "output_tokens": 10.0},
    }


def records_frame(spark, rows):
    """rows: (system, document_id, record dict, text)"""
    schema = f"system string, document_id string, record {CANONICAL.simpleString()}, text string"
    return spark.createDataFrame(rows, schema)


def gold_frames(spark, meds=(), freqs=(), types=(), invs=(), dxs=(), spans=()):
    return {
        "medications": spark.createDataFrame(list(meds), "document_id string, ord int, name string, dose string, dose_unit string, frequency string"),
        "frequencies": spark.createDataFrame(list(freqs), "document_id string, ord int, value string, count string, period_count string, period_unit string, seizure_type string, temporal_scope string, surface string"),
        "types": spark.createDataFrame(list(types), "document_id string, ord int, label string"),
        "investigations": spark.createDataFrame(list(invs), "document_id string, eeg string, mri string"),
        "diagnoses": spark.createDataFrame(list(dxs), "document_id string, ord int, label string"),
        "spans": spark.createDataFrame(list(spans), "document_id string, `group` string, ord long, start int, end int, label string, value string"),
    }
