"""Explicit schemas; nothing is ever inferred from data."""

from pyspark.sql import types as T


def _s(*names):
    return [T.StructField(n, T.StringType()) for n in names]


def _i(*names):
    return [T.StructField(n, T.IntegerType()) for n in names]


EVIDENCE = T.StructType(_s("quote", "sentence_id") + _i("char_start", "char_end"))
EVIDENCE_LIST = T.ArrayType(EVIDENCE)
IDS = T.ArrayType(T.StringType())
_TAIL = [T.StructField("evidence", EVIDENCE_LIST), T.StructField("evidence_event_ids", IDS)]

SCALAR = T.StructType(_s("value", "missingness", "temporality") + _TAIL)
FREQUENCY = T.StructType(_s("value", "missingness", "temporality", "temporal_scope", "seizure_type") + _TAIL)
MEDICATION = T.StructType(
    _s("name", "dose", "dose_unit", "frequency", "status", "missingness", "temporality") + _TAIL
)
INVESTIGATION = T.StructType(_s("status", "result", "missingness", "temporality") + _TAIL)
EVENT = T.StructType(
    _s("id", "category", "temporality", "status", "value", "medication_name", "dose", "dose_unit", "frequency",
       "investigation_type", "result", "temporal_scope", "seizure_type")
    + [T.StructField("evidence", EVIDENCE)]
)
FIELDS = T.StructType([
    T.StructField("current_anti_seizure_medications", T.ArrayType(MEDICATION)),
    T.StructField("previous_anti_seizure_medications", T.ArrayType(MEDICATION)),
    T.StructField("current_seizure_frequency", FREQUENCY),
    T.StructField("seizure_types", T.ArrayType(SCALAR)),
    T.StructField("eeg", INVESTIGATION),
    T.StructField("mri", INVESTIGATION),
    T.StructField("epilepsy_diagnosis", SCALAR),
])
METADATA = T.StructType(
    _s("model", "model_label", "harness_id", "format", "projection")
    + [T.StructField(n, T.DoubleType()) for n in ("latency_ms", "input_tokens", "output_tokens", "estimated_cost_usd")]
    + [T.StructField(n, T.BooleanType()) for n in ("repair_attempted", "repair_succeeded")]
)
CANONICAL = T.StructType(
    _s("document_id", "pipeline_id")
    + [T.StructField("fields", FIELDS), T.StructField("events", T.ArrayType(EVENT)),
       T.StructField("metadata", METADATA)]
)

LABEL_EXAMPLE = T.StructType([
    T.StructField("source_row_index", T.LongType()),
    T.StructField("clinic_date", T.StringType()),
    T.StructField("row_ok", T.BooleanType()),
    T.StructField("check__Seizure Frequency Number", T.StructType([
        T.StructField("seizure_frequency_number", T.ArrayType(T.StringType())),
        T.StructField("reference", T.ArrayType(T.StringType())),
        T.StructField("analysis", T.StringType()),
    ])),
])
ENTITY_EXPORT = T.StructType(
    _s("entity", "start_index", "end_index", "text")
    + [T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]
)
PARSE_FLAGS = T.StructType(
    [T.StructField(n, T.BooleanType()) for n in ("parse_success", "repair_attempted", "repair_succeeded")]
    + _s("error")
)
RUN_LOG = T.StructType(
    _s("baseline", "pipeline", "document_id", "canonical_output_path")
    + [T.StructField("parse", PARSE_FLAGS), T.StructField("log_order", T.LongType())]
)
SPLIT_FILE = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("development", "validation", "test")])
