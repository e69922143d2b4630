import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from goldmeter.sources import annotations as A
from goldmeter.sources import artifacts, letters, markup, runs

LETTER = "Dear Dr\nHe takes Keppra 500 mg bd.\nTwo seizures per month."


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "D1.txt").write_bytes(LETTER.replace("\n", "\r\n").encode())
    (tmp_path / "D2.txt").write_text("Ein 😀 Text")
    ann = [
        "T1\tPrescription 17 30\tKeppra-500-mg", "A1\tDrugName T1 Keppra", "A2\tDrugDose T1 250", "A3\tDrugDose T1 500",
        "A4\tFlag T1", "T2\tSeizureFrequency 35 47;48 57\tTwo-seizures-per-month", "R1\tLink Arg1:T1 Arg2:T2", "N1\tnote",
        "broken",
    ]
    (tmp_path / "D1.ann").write_text("\n".join(ann))
    (tmp_path / "D3.ann").write_text("T1\tDiagnosis 0 3\tabc\n")
    return tmp_path


def test_letters_keep_code_points_and_unify_line_ends(spark, corpus):
    rows = {r.document_id: r for r in letters.letters(spark, str(corpus)).collect()}
    assert rows["D1"].text == LETTER and rows["D2"].text == "Ein 😀 Text" and set(rows) == {"D1", "D2"}


def test_annotations_attributes_fragments_and_missing_letter(spark, corpus):
    docs = letters.letters(spark, str(corpus))
    rows = {(r.document_id, r.ann_id): r for r in A.annotations(spark, str(corpus), docs).collect()}
    t1 = rows["D1", "T1"]
    assert t1.attributes == {"DrugName": "Keppra", "DrugDose": "500", "Flag": "true"}
    assert t1.source_text == LETTER[17:30] and t1.match_by_offset and t1.match_in_document
    assert (rows["D1", "T2"].char_start, rows["D1", "T2"].char_end) == (35, 57)
    assert rows["D3", "T1"].source_text is None
    files = letters.read_whole_files(spark, str(corpus), "*.ann")
    assert {r.ann_id for r in A.parse_annotations(files, fragments=False).filter("document_id='D1'").collect()} == {"T1"}
    assert sorted(r.kind for r in A.relation_and_note_lines(files).collect()) == ["note", "relation"]


def test_entity_export(spark, tmp_path):
    (tmp_path / "D1.json").write_text(json.dumps([
        {"entity": "Diagnosis", "start_index": "2", "end_index": "9", "text": "x", "attributes": {"CUI": "C1"}}]))
    row = A.entity_exports(spark, str(tmp_path)).collect()[0]
    assert (row.document_id, row.char_start, row.char_end, row.attributes) == ("D1", 2, 9, {"CUI": "C1"})


def test_markup_width_quotes_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('D1.txt, 1 ,2,"a, ""b""",\n\nD2.txt,x\n'.encode())
    (tmp_path / "b.csv").write_bytes("D3.txt,caf\xe9\n".encode("latin-1"))
    rows = {r.cells[0]: list(r.cells) for r in markup.markup_rows(spark, str(tmp_path)).collect()}
    assert rows["D1.txt"] == ["D1.txt", "1", "2", 'a, "b"', ""]
    assert rows["D2.txt"] == ["D2.txt", "x"] and rows["D3.txt"] == ["D3.txt", "café"]


def test_gold_tables(spark, tmp_path, corpus):
    m = tmp_path / "m"
    m.mkdir()
    (m / "MarkupPrescriptions.csv").write_text("D1.txt,17,30,C1,null,Keppra-500,500,mg,2,Keppra-500-mg\nD1.txt,1,2,short\n")
    (m / "MarkupSeizureFrequency.csv").write_text(
        "D1.txt,35,57,C2,focal-seizures,null,x,null,2,3,Months,null,Since,null\n"
        "D1.txt,0,4,C2,null,null,x,null,null,null,Week\nD1.txt,0,4,C2,seizures,seizures,x,4,null,null,null\n")
    (m / "MarkupInvestigations.csv").write_text("D1.txt,1,5,C,EEG-normal\nD1.txt,6,9,C,MRI-and-EEG-abnormal,phrase\n")
    (m / "MarkupDiagnosis.csv").write_text("D1.txt,1,5,C,x,JME,Affirmed,Epilepsy,5\nD1.txt,1,5,C,x,JME,Negated,Epilepsy,5\n")
    docs = letters.letters(spark, str(corpus))
    gold = markup.gold_tables(spark, str(m), docs, A.annotations(spark, str(corpus)))
    med = gold["medications"].collect()
    assert [(r.name, r.dose, r.dose_unit, r.frequency) for r in med] == [("levetiracetam", "500", "mg", "twice daily")]
    fr = gold["frequencies"].orderBy("ord").collect()
    assert [(r.count_, r.period_count, r.period_unit, r.value) for r in
            gold["frequencies"].withColumnRenamed("count", "count_").orderBy("ord").collect()] == [
        ("2-3", "1", "month", "2 3 per 1 month"), ("1", "1", "week", "1 per 1 week"), ("4", "", "", "4")]
    assert fr[0].surface == LETTER[35:57] and fr[0].temporal_scope == "since" and fr[0].seizure_type == "focal seizure"
    assert gold["investigations"].collect()[0].asDict() == {"document_id": "D1", "eeg": "abnormal", "mri": "abnormal"}
    assert [r.label for r in gold["diagnoses"].collect()] == ["juvenile myoclonic epilepsy"]
    groups = {r.group for r in gold["spans"].collect()}
    assert {"medications", "seizure_frequency", "eeg", "mri", "diagnosis", "Prescription", "Diagnosis"} <= groups


def test_label_examples(spark, tmp_path):
    f = tmp_path / "labels.json"
    block = {"seizure_frequency_number": ["2-3 per Month"], "reference": ["2 per month", "said so"], "analysis": "a"}
    f.write_text(json.dumps([
        {"source_row_index": 7, "clinic_date": "letter", "check__Seizure Frequency Number": block},
        {"source_row_index": 8, "check__Seizure Frequency Number": {"seizure_frequency_number": []}}]))
    row = letters.label_examples(spark, str(f)).collect()
    assert len(row) == 1 and row[0].document_id == "GAN7" and row[0].gold_label == "2 3 per month"
    assert row[0].evidence_reference == "said so"


def test_split_file(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"development": ["b", "a"], "validation": ["c"], "test": []}, indent=1))
    s = letters.split_table(spark, str(f))
    assert [r.document_id for r in letters.split_ids(s, "development", 1).collect()] == ["b"]
    with pytest.raises(ValueError):
        letters.split_ids(s, "other")


def test_canonical_scan_and_preference(spark, tmp_path):
    for system, doc, name, body in [
        ("E2", "d1", "e4_canonical.json", '{"document_id":"d1","pipeline_id":"four"}'),
        ("E2", "d1", "e2_canonical.json", '{"document_id":"d1","pipeline_id":"two"}'),
        ("E2", "d2", "e2_canonical.json", "not json"),
    ]:
        p = tmp_path / system / doc
        p.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(body)
    found = runs.canonical_files(spark, str(tmp_path), r"/(?<system>[^/]+)/(?<document>[^/]+)/(?<file>[^/]+)$")
    best = {r.document_id: r for r in runs.first_existing(found, ["e4_canonical.json", "e2_canonical.json"]).collect()}
    assert best["d1"].record.pipeline_id == "four" and best["d2"].record is None


def test_raw_responses(spark, tmp_path):
    a, b = tmp_path / "m1" / "h1" / "d1", tmp_path / "m1" / "h2" / "d2"
    for p in (a, b):
        p.mkdir(parents=True)
        (p / "raw_response.txt").write_text("{}")
    (b / "canonical_projection.json").write_text('{"document_id":"DX","metadata":{"harness_id":"HX"}}')
    got = {(r.document_id, r.harness_id, r.model_label) for r in runs.raw_responses(spark, str(tmp_path)).collect()}
    assert got == {("d1", "h1", "m1"), ("DX", "HX", "m1")}


def test_sinks_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, None)], "id int, v string")
    for fmt in ("csv", "json", "parquet"):
        artifacts.write_table(df, str(tmp_path / fmt), fmt)
    back = artifacts.read_csv_table(spark, str(tmp_path / "csv"))
    assert {(r.id, r.v) for r in back.collect()} == {("1", 'a "q"'), ("2", None)}
    log = tmp_path / "log"
    runs.append_run_log(df.select(F.lit("S2").alias("baseline"), F.col("id").cast("string").alias("document_id")), str(log))
    runs.append_run_log(df.select(F.lit("S3").alias("baseline"), F.col("id").cast("string").alias("document_id")), str(log))
    assert runs.run_log(spark, str(log)).count() == 4
    f = tmp_path / "x"
    f.mkdir()
    (f / "t.csv").write_text("h\n1\n2\n")
    (f / "t.json").write_text('{"a":1,"b":2}')
    seen = artifacts.scan_artifacts(spark, str(f))
    expected = seen.select("path").withColumn("id", F.lit("k")).union(
        spark.createDataFrame([("file:/nowhere.jsonl", "gone")], "path string, id string"))
    rows = {Path(r.path).name: r for r in artifacts.artifact_inventory(expected, seen).collect()}
    assert rows["t.csv"].row_count == 2 and rows["t.json"].row_count == 2 and not rows["nowhere.jsonl"].exists
