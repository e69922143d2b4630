"""Value tables for the Column builders; expectations are stated by hand."""

import pytest

from goldmeter.functions import frequency as Q
from goldmeter.functions import normalize as N
from goldmeter.functions import text as T

CASES = [
    (T.norm_value, {"  N/A ": "", "Not_Stated": "", "Focal-Onset  (L)": "focal onset l", "2.5/day": "2.5/day", None: ""}),
    (T.norm_text, {"a\t–\n“b”": 'a - "b"', "‘x’ ": "'x'"}),
    (T.norm_quote, {"Tonic-Clonic  Fits": "tonic clonic fits", "﻿A—B": "a b"}),
    (T.norm_label, {" 3-4  per Month ": "3 4 per month"}),
    (N.medication_name, {
        "Keppra 500mg tablets": "levetiracetam", "Epilim Chrono MR": "sodium valproate",
        "keppra and carbamazepine": "carbamazepine", "vitamin d": "vitamin d", None: "",
        "semisodium valproate 1 g": "sodium valproate",
    }),
    (N.dose_value, {"500 mg": "500", "500mg": "500", "1.5 g": "1.5", "2 x 250mg": "2x250", None: ""}),
    (N.dose_unit, {"Milligrams": "mg", "puffs": "puffs", None: ""}),
    (N.dosing_schedule, {"B.D.": "b.d.", "bd": "twice daily", "2": "twice daily", "at night": "at night"}),
    (N.singular_unit, {"Weeks": "week", "day": "day"}),
    (N.seizure_type, {
        "Absences": "generalized absence seizure", "GTC fits": "generalized tonic clonic seizure",
        "focal tonic clonic": "focal seizure", "focal to bilateral tonic-clonic events":
        "focal to bilateral tonic clonic seizure", "seizures": "unknown seizure type", "dizzy": "dizzy",
        "complex partial fit": "focal impaired awareness seizure",
    }),
    (N.coarse_seizure, {"absence": "generalized seizure or epilepsy", "dizzy": "unknown seizure or epilepsy", "": ""}),
    (N.diagnosis, {"JME": "juvenile myoclonic epilepsy", "left temporal lobe": "focal epilepsy",
                   "generalised thing": "generalized epilepsy", "syncope": "syncope"}),
    (N.coarse_diagnosis, {"jme": "generalized_epilepsy", "epilepsy": "unknown_epilepsy", "syncope": ""}),
    (N.projection_label, {
        "aura only": None, "aura with seizure": "aura with seizure", "Secondary generalised fits":
        "secondary generalized seizures", "complex partial": "focal seizure", "seizures": "unknown seizure type",
        "non-epileptic attack": "unknown seizure type", " Drop ": "Drop", None: None,
    }),
    (N.failure_label, {"focal and absence": "combined_generalized_focal", "jme": "unknown", "x": ""}),
    (N.investigation_result, {
        "No abnormality": "normal", "Abnormal": "abnormal", "normal": "normal", "awaited": "uncertain", "": "",
        "canada": "normal",
    }),
    (N.temporality, {"used to take": "historical", "plan to start": "planned", "taking": "current",
                     "soon": "soon", "": ""}),
    (N.missingness, {"": "not_stated", "possible": "uncertain", "inconsistent": "conflicting", "yes": "present",
                     "??": "not_stated"}),
    (N.concept_class, {"": "missing", "Null": "missing", "focal": "generic", "eeg": "generic",
                       "epilepsy-(x)": "malformed", "focal epilepsy": "specific", None: "missing"}),
    (Q.quantity, {"a": 1.0, "multiple": 2.0, "3 to 4": 3.5, "2-3": 2.5, "two to four": 3.0, "x": None, "1d": None,
                  "1 to 2 to 4": 2.0, "": None}),
    (Q.label_rate, {
        "3 to 4 per month": 3.5, "3-4 per month": 3.5, "2 cluster per month, 6 per cluster": 12.0,
        "seizure free for 12 month": 0.0, "unknown": 1000.0, "no seizure frequency reference": 1000.0,
        "1 per month": 1.0, "2 per month": 2.0, "1 per week": 4.0, "multiple per 2 week": 4.0, "often": 1000.0,
        "1 per 0 day": 1000.0, "x per cluster": 1000.0,
    }),
]


@pytest.mark.parametrize("builder,table", CASES, ids=[c[0].__name__ for c in CASES])
def test_value_table(column_values, builder, table):
    assert dict(zip(table, column_values(builder, list(table)))) == table


def test_frequency_parts(column_values):
    table = {
        "": ("", "", "", ""), "Seizure-free since May": ("0", "", "", "seizure_free"),
        "every few months": ("1", "3", "month", "approximate_rate"), "fortnightly": ("1", "2", "week", "rate"),
        "every couple weeks": ("1", "2", "week", "approximate_rate"), "every 3 days": ("1", "3", "day", "rate"),
        "2 to 3 seizures per month": ("2-3", "1", "month", "rate"), "2-3 per month": ("3", "1", "month", "rate"),
        "two in the last 6 months": ("2", "6", "month", "rate"), "4": ("4", "", "", "count_only"),
        "rare": ("", "", "", "unparsed"), "one per 2 weeks": ("1", "2", "week", "rate"),
    }
    got = column_values(Q.frequency_parts, list(table))
    assert {k: tuple(v) for k, v in zip(table, got)} == table


def test_ladders(spark):
    from pyspark.sql import functions as F

    xs = [0.0, 0.1, 0.17, 0.5, 1.0, 1.1, 2.0, 4.0, 10.0, 30.0, 999.5, 1000.0, 2000.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [tuple(r) for r in df.select(Q.fine_class(F.col("x")), Q.coarse_class(F.col("x"))).collect()]
    assert [g[0] for g in got] == [
        "NS", "<1/6M", "1/6M", "(1/6M,1/M)", "1/M", "1/M", "(1/M,1/W)", "1/W", "(1/W,1/D)", ">=1/D", "UNK", "UNK", "UNK"]
    assert [g[1] for g in got] == ["NS"] + ["infrequent"] * 5 + ["frequent"] * 4 + ["UNK"] * 3
